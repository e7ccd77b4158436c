"""Byte-level BPE by sentencepiece against the library of the rank files."""

import hashlib
import random

import numpy as np
import pytest

from quillspark.llm import piecewise
from quillspark.llm.queries import vocabulary

tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
PATHS = [vocabulary("byte_bpe_multi_50k.tiktoken"), vocabulary("byte_bpe_50k.tiktoken")]


def library(path):
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=piecewise.read_ranks(path), special_tokens={})


def ids(own, text):
    return [int(i) for part in own.encode(text) for i in part.split(",")]


@pytest.mark.parametrize("path", PATHS[:1])  # the pattern is that of all files
def test_every_code_point(path):
    own, lib = piecewise.Pieces(path, public.PATTERN), library(path)
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(chars), 2000):
        text = "\n".join(f"a{c}b1{c} {c}" for c in chars[start : start + 2000])
        assert ids(own, text) == lib.encode_ordinary(text), hex(ord(chars[start]))


@pytest.mark.parametrize("path", PATHS)
def test_mixed_texts(path):
    own, lib, r = piecewise.Pieces(path, public.PATTERN), library(path), random.Random(4)
    pieces = ["the", " word", "'s", "'LL", "  ", "\n", "\t", " ", "　", "\x1c", "\x85", "é", "é", "字", "中文字", "\U0001f600", "１２", "12345", "...", "¿", "\U00010940", "꟎", "Ᲊ", "\U0001246f", "\0", "ß", "ΑΣ", "<|endoftext|>", "#", "﻿", "aaaaaaaaaaaaaaaaaaaaaaaaa", "ا", "ไทย"]
    texts = ["".join(r.choices(pieces, k=r.randint(0, 40))) for _ in range(1500)] + [x * 3000 for x in ("a", "字", " ", "ab", ". ", "é ", "\n ")]
    for text, want in zip(texts, lib.encode_ordinary_batch(texts)):
        got = ids(own, text)
        assert got == want, repr(text[:80])
        assert b"".join(own.decode(p) for p in own.encode(text)) == text.encode()


def test_every_token_is_itself():
    for path in PATHS:
        own, lib = piecewise.Pieces(path, public.PATTERN), library(path)
        text = "\n".join(t.decode("utf-8", "ignore") for t in own.ranks)
        assert ids(own, text) == lib.encode_ordinary(text)


def test_stretches_are_cut_where_no_match_crosses(monkeypatch):
    monkeypatch.setattr(piecewise, "STRETCH", 7)
    own, lib, r = piecewise.Pieces(PATHS[0], public.PATTERN), library(PATHS[0]), random.Random(5)
    for _ in range(1000):
        text = "".join(r.choices("ab1. \n\t'sé字　\x1c", k=r.randint(0, 60)))
        assert "".join(own.stretches(text)) == text and ids(own, text) == lib.encode_ordinary(text), repr(text)


def test_gaps_in_ranks_and_missing_bytes(tmp_path):
    import base64

    ranks = {bytes([b]): 3 * b for b in range(256)} | {b"ab": 1000, b"abc": 1500, b"bc": 900, b" a": 5000}
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    own, lib = piecewise.Pieces(str(path), public.PATTERN), library(str(path))
    for text in ("abc abc bca", "aabcc", " ab", ""):
        assert ids(own, text) == lib.encode_ordinary(text)
    with pytest.raises(ValueError):
        piecewise.model_proto({b"a": 0})


def test_operator_over_rows(spark, docs):
    from .conftest import clashing

    path = PATHS[0]
    lib = library(path)

    def want(rows):
        out = []
        for row in rows:
            x = lib.encode_ordinary(row.text or "")
            out.append((row.doc_id, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((row.text or "").encode()).hexdigest()))
        return sorted(out, key=str)

    got = piecewise.round_trip(clashing(docs), path, public.PATTERN)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want(docs.collect())
    assert piecewise.round_trip(docs.filter("false"), path, public.PATTERN).collect() == []
    codes = piecewise.encoded(docs, path, public.PATTERN)
    raw = {(r.doc_id, bytes(r.raw)) for r in piecewise.decoded(codes, path, public.PATTERN).collect()}
    assert raw == {(r.doc_id, (r.text or "").encode()) for r in docs.collect()}
    long = " ".join(f"w{x}" for x in np.random.default_rng(1).integers(0, 1 << 40, 150_000))
    one = piecewise.round_trip(spark.createDataFrame([(1, long)], "doc_id long, text string"), path, public.PATTERN).first()
    assert one.n_tokens == len(lib.encode_ordinary(long)) and one.decoded_sha256 == hashlib.sha256(long.encode()).hexdigest()
