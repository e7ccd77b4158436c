"""Texts made against hashes, special tokens in any case, very long texts, odd names and numbers: each held against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from quillspark.llm import components, quality, rollup, simhash, suffix
from quillspark.llm.bpe import Codec
from quillspark.llm.common import Scratch
from quillspark.llm.queries import vocabulary

tokenizers = pytest.importorskip("tokenizers")


def thue_morse(n, pair="ab"):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s.translate(str.maketrans("ab", pair))


def brute_quality(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    out = {"n_words": len(w), "n_dup_lines": len(lines) - len(set(lines))}
    for n in (3, *quality.MAX_COVERED):
        grams = Counter(zip(*[w[k:] for k in range(n)]))
        inside = {j for i in range(len(w) - n + 1) if grams[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        out["n_repeat_words" if n == 3 else f"covered_{n}"] = len(inside) if n == 3 else sum(len(w[j]) for j in inside) / max(1, sum(map(len, w)))
    return out


def test_periodic_strings_are_not_taken_for_copies():
    a, b = thue_morse(4096), thue_morse(4096, "ba")
    words = " ".join("aaaaaaa" if c == "a" else "bbbbbbb" for c in thue_morse(2048))
    cases = [f"{a}\n{b}", f"{a} {b} x y z w v u t\n{b} {a} x y z w v u t", words, words + " " + " ".join(reversed(words.split())), "x" * 17 + " " + "x" * 16 + "y " + "x" * 17, "a\0 a a\0 \0a a"]
    got = quality.measure([c.encode() for c in cases])
    for i, c in enumerate(cases):
        want = brute_quality(c)
        assert {k: got[k][i] for k in want} == pytest.approx(want), c[:40]


def test_very_long_text_has_the_counts_of_its_parts():
    rng = np.random.default_rng(1)
    text = "\n".join(" ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 9)) for _ in range(120_000))
    got = quality.measure([text.encode(), (text + "\n" + text[: text.index("\n")]).encode()])
    assert len(text) > 10_000_000 and got["n_words"].tolist() == [1_080_000, 1_080_009] and got["n_dup_lines"].tolist() == [0, 1] and got["n_repeat_words"].tolist() == [0, 18]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_special_tokens_in_any_case(name):
    t, own = tokenizers.Tokenizer.from_file(vocabulary(name)), Codec(vocabulary(name))
    t.no_padding()
    t.no_truncation()
    rng = np.random.default_rng(6)
    specials = [x.content for x in t.get_added_tokens_decoder().values()]
    pieces = [*specials, *(f(s) for s in specials for f in (str.upper, str.title, str.swapcase)), "<|StartOfText|>", " ", "  ", "\n", "a", "É", "ß", "字", "Word", "x1"]
    texts = ["".join(rng.choice(pieces, rng.integers(1, 12))) for _ in range(4000)]
    for text, ids, e in zip(texts, own.encode(texts), t.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, repr(text)


def test_counts_of_equal_texts_and_compaction(spark):
    path = vocabulary("byte_bpe_50k.json")
    rows = [(i, ["one two", "three", None, "", "<|ENDOFTEXT|> one"][i % 5], "s", "en") for i in range(60)] + [(0, "one two", "s", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(2)
    got = {r.doc_id: r.v for r in rollup.token_counts(docs, {"v": path}).collect()}
    t = tokenizers.Tokenizer.from_file(path)
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x, _, _ in rows}
    store = rollup.Rollup(spark, Scratch(spark, "test-compact").path("b"))
    for n in range(4):
        store.apply(f"b{n}", spark.createDataFrame([("s", "en", "v", 1, n)] * 2, rollup.TOTALS))
    store.compact()
    assert len(store._done()) == 1 and [tuple(r) for r in store.totals().collect()] == [("s", "en", "v", 8, 12)]
    assert not any(store.apply(f"b{n}", spark.createDataFrame([("s", "en", "v", 1, 1)], rollup.TOTALS)) for n in range(4))
    store.apply("b9", spark.createDataFrame([("s", "en", "v", -8, -12)], rollup.TOTALS))
    store.compact()
    store.compact()
    assert store.totals().count() == 0 and not store.apply("b9", spark.createDataFrame([], rollup.TOTALS)) and not store.apply("b0", spark.createDataFrame([], rollup.TOTALS))


def removed(rows):
    """Brute force: covered bytes of each document."""
    seen, out = set(), {}
    for d, t in sorted({(d, t or "") for d, t in rows}):
        b = t.encode()
        cov = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                cov[i : i + 100] = b"\1" * 100
            seen.add(w)
        out[d] = (b, bytes(cov))
    return out


def check_removal(spark, rows, **how):
    want = removed(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for r in suffix.removal_report(df, **how).collect():
        b, cov = want[r.doc_id]
        kept = bytes(x for x, c in zip(b, cov) if not c)
        assert tuple(r) == (r.doc_id, len(b), sum(cov), len([x for x in cov.split(b"\0") if x]), hashlib.sha256(kept).hexdigest()), r.doc_id


LINE = "This common line stands in nearly all documents and has more than one hundred bytes, so that it is a repeat; it goes on for a while so that its inner contexts are all alike."


def common_line(n):
    r = random.Random(n)
    word = lambda: "".join(r.choices("abcdef", k=4))
    rows = [(i, " ".join(word() for _ in range(r.randint(0, 30))) + LINE[: r.randint(90, len(LINE))] + " ".join(word() for _ in range(r.randint(0, 30)))) for i in range(n)]
    return rows + [(n + 1, LINE * 3), (n + 2, LINE[5:]), (n + 3, "x" * 700), (n + 4, "x" * 350), (n + 5, thue_morse(512) + thue_morse(512, "ba"))]


def test_long_texts_are_read_in_pieces(spark):
    r = random.Random(4)
    base = "".join(r.choices("abcdefgh ", k=1500))
    rows = [(1, base[:399]), (2, base), (3, base[200:1100] + "#" + base[:700]), (4, base * 2), (5, "ab" * 900), (6, base[1300:] + base[:120])]
    for piece in (100, 137, 300, 1400):
        check_removal(spark, rows, piece=piece)


def test_texts_over_eight_megabytes(spark):
    rng = np.random.default_rng(3)
    long = bytes(rng.integers(97, 123, suffix.PIECE + 3000, dtype=np.uint8)).decode()
    at = suffix.PIECE
    rows = [(1, long[at - 399 : at]), (2, long), (3, long[at - 60 : at + 90]), (4, long[at - 20 : at + 130]), (5, long[:200] + "-" + long[-150:])]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix.removal_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0, 0), 2: (399, 1), 3: (150, 1), 4: (150, 1), 5: (350, 2)}


@pytest.mark.parametrize("how", [{"hot": 2}, {"hot": 2, "group": 3}, {"hot": 10, "group": 5, "piece": 160}])
def test_hot_keys_are_dealt_out(spark, how):
    check_removal(spark, common_line(150), **how)


def test_fingerprint_of_very_long_text():
    rng = np.random.default_rng(2)
    words = [f"Word{x}" for x in rng.integers(0, 1 << 30, simhash.PART * 2 + 7)]
    low = [w.lower() for w in words]
    total, n = np.zeros(64, np.int64), len(low) - 3
    for i in range(n):
        h = xxhash.xxh64_intdigest(" ".join(low[i : i + 4]), seed=42)
        total += np.array([h >> b & 1 for b in range(64)]) if i % 4096 == -1 else np.unpackbits(np.array([h], "<u8").view(np.uint8), bitorder="little")
    assert simhash.fingerprint("\n".join(words).encode()) == sum(1 << b for b in range(64) if 2 * total[b] > n)


def test_components_of_hubs(spark, monkeypatch):
    """Stars and chains, with so low a bound that the hubs are hot; against a union of sets."""
    monkeypatch.setattr(components, "LEAST_HOT", 5)
    monkeypatch.setattr(components, "MOST_HOT", 20)
    r = random.Random(8)
    links = [(1000, i) for i in range(300)] + [(i, i + 1) for i in range(2000, 2040)] + [(5000 + i, 5000 + r.randrange(60)) for i in range(60)] + [(1000, 1000), (7, 1000), (None, 3), (3, None)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    want = {x: find(x) for x in up}
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len(want) and {r.node: r.component for r in got} == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_of_very_common_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(components, "LEAST_HOT", 4)
    monkeypatch.setattr(components, "MOST_HOT", 10)
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(100 + i, text) for i in range(40)] + [(300 + i, "") for i in range(30)] + [(None, "")] * 3 + [(500 + i, f"lone words {i} " * 3) for i in range(20)] + [(None, "only without id " * 4)] * 2
    got = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    fps = {}
    for r in got:
        fps.setdefault(r.fp, []).append(r)
    for group in fps.values():
        assert len({r.component_id for r in group}) == 1
    of = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert all(of[100 + i] == 100 for i in range(40)) and all(of[300 + i] == 300 for i in range(30))
    assert sum(r.component_id is None for r in got) == 2
