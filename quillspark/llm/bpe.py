"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A pretoken's symbols are the leaves' left ends: leaf i holds rank * size + i of the pair (symbol i, next symbol), or a
value beyond all ranks. The root's minimum is then the leftmost pair of lowest rank; a merge is three point updates (the
pair itself, the one before, and the one that went), each a walk to the root, until the root holds no pair. Different
pretokens of a batch go through their trees together in numpy (a row for each); a long pretoken has a tree of its own.

Results equal those of the tokenizers library for files of the two kinds used here: byte-level BPE with the usual
pattern (whose letters are those of the installed `regex`), and lower-cased BPE with word ends (see `letters`; the tests compare
all code points of both). Special tokens' strings in a text get their own ids, as in the library.

Defined results: a null or empty text has no ids and decodes to the empty text. Texts of any length are handled whole;
repeated rows give repeated results; extra columns are ignored; an empty table gives an empty table. Caches of encoded
words are bounded (WORDS and TOKENS entries a worker) and hold only what can be made again, so lost executors lose nothing.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import CACHES, map_slices
from quillspark.llm.letters import Finder, lowered

WORDS, TOKENS = 800_000, 400_000
#: Pretokens of up to this many symbols share trees in numpy.
TOGETHER, ROWS = 128, 8192
_SPACE = r"\p{White_Space}"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in for each byte in byte-level vocabularies: itself, or the next free from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Merges:
    """Pair ranks of a vocabulary, and the merging itself."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        alphabet = byte_alphabet()
        self.first, self.last = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for char, byte in alphabet.items():
            self.first[byte], self.last[byte] = vocab[char], vocab[char + suffix]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.none = len(merges)
        self.lookup = dict(zip(keys.tolist(), range(len(keys))))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def symbols(self, word: bytes) -> list[int]:
        ids = self.first[np.frombuffer(word, np.uint8)]
        if len(ids):
            ids[-1] = self.last[word[-1]]
        return ids.tolist()

    def alone(self, word: bytes) -> list[int]:
        """One tree for one pretoken."""
        ids, n = self.symbols(word), len(word)
        size = 1 << max(0, n - 1).bit_length()
        beyond, find, made = self.none * size + size, self.lookup.get, self.made
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        tree = [beyond] * (2 * size)
        for i in range(n - 1):
            if (r := find(ids[i] << 32 | ids[i + 1])) is not None:
                tree[size + i] = r * size + i
        for x in range(size - 1, 0, -1):
            tree[x] = min(tree[2 * x], tree[2 * x + 1])

        def put(i: int, value: int) -> None:
            x = size + i
            tree[x] = value
            while x > 1:
                low = min(tree[x], tree[x ^ 1])
                x >>= 1
                if tree[x] == low:
                    break
                tree[x] = low

        def pair(i: int, j: int) -> int:
            r = find(ids[i] << 32 | ids[j])
            return beyond if r is None else r * size + i

        while size > 1 and tree[1] < beyond:
            rank, i = divmod(tree[1], size)
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j] = int(made[rank]), -1
            put(j, beyond)
            if k < n:
                before[k] = i
            put(i, pair(i, k) if k < n else beyond)
            if (p := before[i]) >= 0:
                put(p, pair(p, i))
        return [x for x in ids if x >= 0]

    def together(self, words: list[bytes], size: int) -> list[bytes]:
        """A tree for each of the words (of at most `size` symbols, a power of two), walked in step."""
        rows = len(words)
        n = np.array([len(w) for w in words])
        codes = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(rows, size)
        at = np.arange(size)
        live = at[None, :] < n[:, None]
        ids = np.where(at[None, :] == n[:, None] - 1, self.last[codes], self.first[codes])
        ids[~live] = -1
        beyond = self.none * size + size
        tree = np.full((rows, 2 * size), beyond, np.int32)  # ranks * TOGETHER stay far below 2**31
        rank = np.where(live[:, 1:], self.rank(ids[:, :-1], ids[:, 1:]), self.none)
        tree[:, size : 2 * size - 1] = np.where(rank < self.none, rank * size + at[None, :-1], beyond)
        for x in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * x], tree[:, 2 * x + 1], out=tree[:, x])
        after = np.broadcast_to(at + 1, (rows, size)).copy()
        before = np.broadcast_to(at - 1, (rows, size)).copy()
        flat, tree_flat, after_f, before_f = ids.ravel(), tree.ravel(), after.ravel(), before.ravel()

        def put(r, i, value):
            x = size + i
            base = r * (2 * size)
            tree_flat[base + x] = value
            for _ in range(size.bit_length() - 1):
                low = np.minimum(tree_flat[base + x], tree_flat[base + (x ^ 1)])
                x = x >> 1
                tree_flat[base + x] = low

        open_ = np.flatnonzero(tree[:, 1] < beyond)
        while len(open_):
            root = tree[open_, 1]
            rank, i = root // size, root % size
            base = open_ * size
            j = after_f[base + i]
            k = after_f[base + j]
            after_f[base + i] = k
            flat[base + i] = self.made[rank]
            flat[base + j] = -1
            put(open_, j, beyond)
            inside = k < n[open_]
            safe = np.where(inside, k, 0)
            before_f[(base + k)[inside]] = i[inside]
            r = self.rank(flat[base + i], flat[base + safe])
            put(open_, i, np.where(inside & (r < self.none), r * size + i, beyond))
            p = before_f[base + i]
            left = p >= 0
            if left.any():
                ro, pl, il = open_[left], p[left], i[left]
                r = self.rank(flat[ro * size + pl], flat[ro * size + il])
                put(ro, pl, np.where(r < self.none, r * size + pl, beyond))
            open_ = open_[tree[open_, 1] < beyond]
        kept = ids >= 0
        stream = ids[kept].astype("<u4").tobytes()
        ends = (np.cumsum(kept.sum(axis=1)) * 4).tolist()
        return [stream[a:b] for a, b in zip([0, *ends], ends)]

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each pretoken, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        classes: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            classes.setdefault(1 << max(1, (len(w) - 1).bit_length()), []).append(i)
        for size, members in classes.items():
            if size > TOGETHER or len(members) < 16:
                for i in members:
                    out[i] = np.array(self.alone(words[i]), "<u4").tobytes()
            else:
                for s in range(0, len(members), ROWS):
                    part = members[s : s + ROWS]
                    for i, ids in zip(part, self.together([words[i] for i in part], size)):
                        out[i] = ids
        return out


class Codec:
    """Encodes and decodes texts with a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.lower = spec["normalizer"] is not None  # the kind with word ends: NFC, lower case, white space dropped
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        suffix = model["end_of_word_suffix"] or ""
        self.merges = Merges(model["vocab"], merges, suffix)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self._split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        if self.lower:
            self._mark = "\n"  # stands between stretches that are cut up together; none holds it
            self._find = Finder(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+|\n")
        else:
            self._mark = "\0"
            pattern = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|{_SPACE}+(?!\P{{White_Space}})|{_SPACE}+"
            self._find = regex.compile(pattern).findall
            self._find_marked = regex.compile("\0|" + pattern.replace("[^", "[^\0").replace("(?!\\P{White_Space})", r"(?![^\0\p{White_Space}])")).findall
        self._odd = regex.compile(rf"  | \n|\n |\0|^ | $|[^\P{{White_Space}} \n]").search
        alphabet = byte_alphabet()
        self.table = [b""] * (1 + max([*model["vocab"].values(), *self.special.values()]))
        for token, i in model["vocab"].items():
            ended = suffix and token.endswith(suffix)
            self.table[i] = bytes(alphabet[c] for c in (token[: -len(suffix)] if ended else token)) + (b" " if ended else b"")
        for token, i in self.special.items():
            self.table[i] = token.encode()
        self.words: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {}

    def _normal(self, word: str) -> str:
        if word.isascii():
            return word.lower()
        return lowered(unicodedata.normalize("NFC", word).replace("\u03a3", "\u03c3"))  # sigma does not look at its place

    def _parts(self, word: str) -> list:
        """Pretokens of a stretch without special tokens, and the ids (int) of special tokens."""
        parts: list = []
        for part in self._split.split(word) if self._split and any(s in word for s in self.special) else [word]:
            if part in self.special:
                parts.append(self.special[part])
            elif part:
                parts += [p for p in self._find(self._normal(part)) if p != "\n"] if self.lower else self._find(part)
        return parts

    def _single(self, stretch: str) -> bool:
        """Whether a stretch is one pretoken in normal form: letters, after the blank if blanks are kept."""
        if self.lower:
            return stretch.isalpha() and stretch.islower() and (stretch.isascii() or _latin1(stretch))
        return stretch[:1] == " " and stretch[1:].isalpha()

    def _learn(self, stretches: set[str]) -> None:
        """Put the ids of new stretches into the cache of words."""
        known, single = self.tokens, self._single
        alone = [w for w in stretches if single(w)]
        fresh = [w for w in alone if w not in known]
        plain, special = list(stretches.difference(alone)), []
        self.words.update(zip(fresh, self.merges.encode([w.encode() for w in fresh])))
        if len(fresh) < len(alone):
            self.words.update((w, known[w]) for w in alone if w in known)
        joined = self._mark.join(plain) + self._mark
        if any(s in joined for s in self.special):
            special = [w for w in plain if any(s in w for s in self.special)]
            plain = list(stretches.difference(alone, special))
            joined = self._mark.join(plain) + self._mark
        flat = self._find(self._normal(joined)) if self.lower else self._find_marked(joined)
        others = [self._parts(w) for w in special]
        self._merge(set(flat).union(*([p for p in x if type(p) is str] for x in others)) - {self._mark})
        between = b"\xff\xff\xff\xff"  # no id: ids are below 2**24, so these bytes cannot stand inside any
        self.tokens[self._mark] = between
        if plain:
            self.words.update(zip(plain, b"".join(map(self.tokens.__getitem__, flat)).split(between)))
        del self.tokens[self._mark]
        self.words.update((w, self._ids(x)) for w, x in zip(special, others))

    def _merge(self, pretokens: set[str]) -> None:
        known, words = self.tokens, self.words
        new = [p for p in pretokens if p not in known]
        shared = [p for p in new if p in words and self._single(p)]
        known.update((p, words[p]) for p in shared)
        new = [p for p in new if p not in known] if shared else new
        self.tokens.update(zip(new, self.merges.encode([p.encode() for p in new])))

    def _ids(self, parts: list) -> bytes:
        return b"".join([self.tokens[p] if type(p) is str else p.to_bytes(4, "little") for p in parts])

    def _stretches(self, text: str) -> list[str]:
        """Cut a text where no pretoken can cross: at single blanks between other characters."""
        if self.lower:
            if text.isascii() or _latin1(text):  # NFC changes nothing here; one case, fewer different stretches
                lowered = text.lower()
                if not any(s in lowered for s in self.special):  # specials are found before lower-casing, in their own case only
                    text = lowered
            return text.replace("\n", " ").split(" ")
        if not self._odd(text) and not any(s in text for s in self.special):
            return text.replace(" ", "\0 ").split("\0")
        return [text]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self.words) > WORDS:
            self.words = {}
        if len(self.tokens) > TOKENS:
            self.tokens = {}
        cut = [self._stretches(t) for t in texts]
        whole: dict[int, bytes] = {}
        for i, x in enumerate(cut):
            if len(x) == 1 and not self.lower:  # not kept in the cache: often long
                parts = self._parts(x[0])
                self._merge({p for p in parts if type(p) is str})
                whole[i] = self._ids(parts)
        known = self.words
        missing = {w for w in set().union(*(x for i, x in enumerate(cut) if i not in whole)) if w not in known}
        if missing:
            self._learn(missing)
        get = self.words.__getitem__
        return [whole[i] if i in whole else b"".join(map(get, x)) for i, x in enumerate(cut)]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec a worker and file."""
    return Codec(path)


CACHES.append(codec)


def texts_of(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit integers)."""

    def rows(batch):
        ids = codec(path).encode(texts_of(batch.column("text")))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return map_slices(_two(docs), "text", "doc_id long, n_tokens long, ids binary", rows)


def decoded(encoded_docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows with doc_id and ids."""

    def rows(batch):
        text = [codec(path).decode(x or b"") for x in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])

    return map_slices(encoded_docs.select("doc_id", "ids"), "ids", "doc_id long, text string", rows)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the text decoded from them."""

    def rows(batch):
        own = codec(path)
        ids = own.encode(texts_of(batch.column("text")))
        sha = lambda x: hashlib.sha256(x).hexdigest()
        columns = [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x) for x in ids]), pa.array([sha(own.decode(x).encode()) for x in ids])]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_slices(_two(docs), "text", "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows)


def _two(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
