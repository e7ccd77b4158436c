"""Byte-level BPE by sentencepiece, from a file of ranks.

A sentencepiece model is a protocol buffer of pieces with scores. It is serialised here straight from the vocabulary, with no
training: each token's bytes are written in the printable byte alphabet, its score is its negative rank, and the normaliser
is the identity without a dummy prefix, so that nothing about a text is changed. Merging the pair of best score then is merging
the pair of lowest rank, leftmost first. Each match of the pattern is encoded by itself; one that is a token as a whole is that
token, as in the library of the rank files. Decoding is the inverse mapping, from ids to bytes.

The pattern's letters, digits and white space are those of the Unicode version that the library knows (see `letters`). The
tests compare all code points.

Defined results: a null or empty text has no ids, and decodes to no bytes. Texts of any length are read whole, in stretches
of STRETCH characters that end where no match can cross; repeated rows give repeated results, extra columns are ignored, an
empty table stays empty. The caches of encoded matches and of words between blanks are
bounded (WORDS and UNITS a worker), and hold only what can be made again.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.bpe import byte_alphabet, texts_of
from quillspark.llm.common import CACHES, map_slices
from quillspark.llm.letters import Finder

UNITS, WORDS, STRETCH, BLOCK, LONGEST = 800_000, 400_000, 1 << 18, 1 << 20, 64
#: White space before a blank: there a text can't simply be cut at its blanks.
_odd = re.compile(r"\s |\0").search


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    """A field of a protocol buffer: a length and bytes, or an unsigned number."""
    if isinstance(value, int):
        return _number(number << 3) + _number(value)
    return _number(number << 3 | 2) + _number(len(value)) + value


def model_proto(ranks: dict[bytes, int]) -> tuple[bytes, np.ndarray]:
    """A sentencepiece BPE model of the ranks, and the rank of each of its pieces; the last piece is the unknown one."""
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"single bytes without a rank: {missing[:5]}")
    chars = {byte: char for char, byte in byte_alphabet().items()}
    order = sorted(ranks.items(), key=lambda x: x[1])
    out = bytearray()
    for token, rank in order:
        piece = "".join(map(chars.__getitem__, token)).encode()
        # text, score (a float of 4 bytes, field 2), type 1: normal
        out += _field(1, _field(1, piece) + _number(2 << 3 | 5) + np.float32(-rank).tobytes() + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _number(2 << 3 | 5) + np.float32(0).tobytes() + _field(3, 2))
    unknown = len(order)
    out += _field(2, _field(3, 2) + _field(4, unknown + 1) + _field(40, unknown))  # trainer: model type BPE, size, id of the unknown piece
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))  # no prefix, white space kept and not escaped
    return bytes(out), np.array([rank for _, rank in order])


class Pieces:
    """Encodes and decodes texts; ids are held as their decimals, joined by commas."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.ranks = read_ranks(path)
        proto, order = model_proto(self.ranks)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.find = Finder(pattern)
        self.decimals = [str(r) for r in order.tolist()]
        self.chars = [chr(0)] * 256
        for char, byte in byte_alphabet().items():
            self.chars[byte] = char
        self.token = {str(rank): token for token, rank in self.ranks.items()}
        self.known: dict[str, str] = {}
        self.units: dict[str, str] = {}

    def _encode(self, matches: list[str]) -> list[str]:
        """The ids of each match: its own rank if it is a token, else by merges."""
        raw = [m.encode() for m in matches]
        whole = [self.ranks.get(b) for b in raw]
        parts = ["".join(map(self.chars.__getitem__, b)) for b, r in zip(raw, whole) if r is None]
        made = iter(self.model.encode(parts, out_type=int, num_threads=1) if parts else [])
        return [str(r) if r is not None else ",".join(map(self.decimals.__getitem__, next(made))) for r in whole]

    def stretches(self, text: str) -> Iterator[str]:
        """The text in parts that begin at white space after another character: no match reaches over such a place."""
        start = 0
        while len(text) - start > STRETCH:
            at = start + STRETCH
            while at < len(text) and not (text[at] == " " and not text[at - 1].isspace()):
                at += 1
            yield text[start:at]
            start = at
        yield text[start:]

    def _learn(self, missing: list[str], alone: bool) -> None:
        """Put new matches (alone), or new units of several matches, into their cache."""
        cut = [[u] if alone else self.find(u) for u in missing]
        known = self.known
        fresh = [m for m in set().union(*cut) if m not in known]
        known.update(zip(fresh, self._encode(fresh)))
        if not alone:
            self.units.update((u, ",".join(map(known.__getitem__, x))) for u, x in zip(missing, cut))

    def encode_all(self, texts: list[str]) -> Iterator[tuple[int, str]]:
        """(number of a text, ids of its next stretch). New units of about BLOCK characters are encoded in one call."""
        held: list = []
        size = 0
        for n, text in enumerate(texts):
            for part in self.stretches(text):
                held.append((n, part))
                size += len(part)
                if size > BLOCK:
                    yield from self._block(held)
                    held, size = [], 0
        yield from self._block(held)

    def encode(self, text: str) -> Iterator[str]:
        """The ids of each stretch of a text."""
        return (ids for _, ids in self.encode_all([text]))

    def _block(self, parts: list[tuple[int, str]]) -> Iterator[tuple[int, str]]:
        """A stretch is cut into units before its blanks, or, if white space precedes one, into matches."""
        if len(self.units) > UNITS:
            self.units.clear()
        if len(self.known) > WORDS:
            self.known.clear()
        cuts = [(n, alone, self.find(part) if alone else [u for u in part.replace(" ", "\0 ").split("\0") if u]) for n, part in parts for alone in [_odd(part) is not None]]
        missing = {alone: list({u for _, a, cut in cuts if a is alone for u in cut}.difference(cache)) for alone, cache in ((True, self.known), (False, self.units))}
        for alone, new in missing.items():
            if new:
                self._learn(new, alone)
        for n, alone, cut in cuts:
            if cut:
                yield n, ",".join(map((self.known if alone else self.units).__getitem__, cut))
        for alone, cache in ((True, self.known), (False, self.units)):
            for u in [u for u in missing[alone] if len(u) > LONGEST]:  # rarely met again
                del cache[u]

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.split(","))) if ids else b""


@lru_cache(maxsize=2)
def pieces(path: str, pattern: str) -> Pieces:
    return Pieces(path, pattern)


CACHES.append(pieces)


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of long) of each text."""

    def rows(batch):
        own = pieces(path, pattern)
        ids: list = [[] for _ in range(batch.num_rows)]
        for n, part in own.encode_all(texts_of(batch.column("text"))):
            ids[n].extend(map(int, part.split(",")))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return map_slices(_two(docs), "text", "doc_id long, ids array<long>", rows)


def decoded(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, raw (the bytes) of rows with doc_id and ids; null ids are none."""

    def run(batches):
        own = pieces(path, pattern)
        for batch in batches:
            raw = [own.decode(",".join(map(str, x or []))) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "raw"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids' decimals joined by commas, and of the bytes decoded from them."""

    def rows(batch):
        own = pieces(path, pattern)
        texts = texts_of(batch.column("text"))
        counts, ids, raw = [0] * len(texts), [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
        for n, part in own.encode_all(texts):
            ids[n].update(("," + part if counts[n] else part).encode())
            raw[n].update(own.decode(part))
            counts[n] += part.count(",") + 1
        ids_sha, raw_sha = [x.hexdigest() for x in ids], [x.hexdigest() for x in raw]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(raw_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_slices(_two(docs), "text", "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows)


def _two(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
