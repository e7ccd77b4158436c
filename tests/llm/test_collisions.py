"""Different words, n-grams and anchors that were made to share a hash are told apart."""

import numpy as np

from quillspark.llm import quality, suffix

from .test_odd_input import brute_quality

#: Different strings of the anchor's size with one key, so small a key that each is the anchor of what surrounds it.
PAIRS = [("yyiehblzlnvrjcwbvtxmownkioirosddznedincfedxyrtwidx", "gxpipaqyceaxaxjouznaeojykhxuhrcujnqsnbkgvpskrtwidx"), ("xczzrylcuwzvmijevgwylgkihgjmvxrcxvlppepiqazsmgmwhe", "gdrwjxaiztwldkgswybnpxmghxkjeunmphyxhbdlbosxmgmwhe")]


def brute_removed(rows, n=100):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        gone = set()
        for i in range(len(text) - n + 1):
            if text[i : i + n] in seen:
                gone.update(range(i, i + n))
            seen.add(text[i : i + n])
        out[doc] = len(gone)
    return out


def test_anchors_with_one_key(spark):
    rng = np.random.default_rng(5)
    letters = lambda n: bytes(rng.choice(np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8), n)).decode()
    rows = []
    for a, b in PAIRS:
        keys = {int(suffix.Rolling(suffix._BYTE[np.frombuffer(x.encode(), np.uint8)]).of(np.array([0]), np.array([suffix.K]))[0]) for x in (a, b)}
        assert len(keys) == 1 and a != b and len(a) == suffix.K
        left, right = letters(50), letters(50)
        for k in range(4):  # the same surroundings of different anchors, whole and cut in various places
            rows += [left[k * 7 :] + x + right for x in (a, b)] + [letters(9) + left[20:] + x + right[: 45 - k] + letters(5) for x in (a, b)]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_removed(rows)
    assert 0 < sum(v > 0 for v in want.values()) < len(rows)
    for group, hot in ((suffix.GROUP, suffix.HOT), (2, suffix.HOT), (3, 1)):
        assert {r.doc_id: r.n_removed for r in suffix.removal_report(docs, group=group, hot=hot).collect()} == want
    pair = [(n, left + x + right) for n, (x, left, right) in enumerate((x, letters(50), letters(50)) for x in PAIRS[0])]
    pair[1] = (1, pair[0][1][:50] + PAIRS[0][1] + pair[0][1][100:])
    assert {r.n_removed for r in suffix.removal_report(spark.createDataFrame(pair, "doc_id long, text string")).collect()} == {0}


def test_fingerprints_only_where_pieces_share_a_core(spark, monkeypatch):
    rng = np.random.default_rng(6)
    letters = lambda n: bytes(rng.choice(np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8), n)).decode()
    line, passage, made = letters(60), letters(125), []
    write = suffix.Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        if name == "repeats":
            made.append(out.filter("f2 <> 0").count())
        return out

    monkeypatch.setattr(suffix.Scratch, "write", counted)
    rows = list(enumerate(letters(120) + line + letters(120) for _ in range(60)))  # a line too short to be removed
    removed = lambda rows, **how: {r.doc_id: r.n_removed for r in suffix.removal_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **how).collect()}
    assert removed(rows, group=4) == removed(rows, hot=1) == brute_removed(rows)
    assert made == [0, 0]
    rows += list(enumerate((letters(90)[k % 7 :] + passage[k % 3 :] + letters(90) for k in range(60)), 100))
    assert removed(rows, group=4) == removed(rows, hot=1) == brute_removed(rows)
    assert min(made[2:]) > 0


def _unmixed(x: int) -> int:
    """The number that quality._mix makes into x."""
    m = 1 << 64
    unshift = lambda v, s: v ^ v >> s ^ v >> 2 * s ^ (v >> 3 * s if 3 * s < 64 else 0)
    x = unshift(x, 31) * pow(0x94D049BB133111EB, -1, m) % m
    x = unshift(x, 27) * pow(0xBF58476D1CE4E5B9, -1, m) % m
    return unshift(x, 31)


def _hash(word: str) -> int:
    data = word.encode() + b" "
    return int(quality.word_hashes(data, np.array([0]), np.array([len(word)]))[0])


def _word_of(goal: int) -> str:
    """A printable word of 16 letters with a hash."""
    m, r = 1 << 64, np.random.default_rng(9)
    salts = [int(s) for s in quality._SALTS]
    while True:
        low = bytes(r.integers(33, 127, 8, dtype=np.uint8))
        inner = int(quality._mix(np.array([(int.from_bytes(low, "little") + salts[0]) % m], np.uint64))[0])
        high = ((_unmixed(goal) - inner - 16 * salts[2]) * pow(salts[1], -1, m) % m).to_bytes(8, "little")
        if all(33 <= b < 127 for b in high):
            return (low + high).decode()


def test_words_and_grams_with_one_hash():
    one = "abcdefghqwertyui"
    other = _word_of(_hash(one))
    assert one != other and _hash(one) == _hash(other)
    # three words whose hash is that of three others: the first differs, the third makes up for it
    base, m = int(quality._BASE), 1 << 64
    a, b, c = "first", "middle", "third"
    d = _word_of((_hash(c) + (_hash(a) - _hash("other")) * base * base) % m)
    grams = [list(quality.gram_hashes(np.array([_hash(w) for w in x], np.uint64), (3,)))[0][0] for x in ((a, b, c), ("other", b, d))]
    assert grams[0] == grams[1]
    cases = [f"{one} b c d {other} b c", f"{one} b c d {one} b c {other} b c", f"{a} {b} {c} x other {b} {d}", f"{a} {b} {c} other {b} {d} {a} {b} {c}", "plain words of one plain words of one"]
    cases += ["z" * 40 + " b c " + "z" * 41 + " b c", f"{one}\n{other}\n{one}"]
    got = quality.measure([c.encode() for c in cases])
    for i, case in enumerate(cases):
        want = brute_quality(case)
        assert {k: round(float(got[k][i]), 9) for k in want} == {k: round(v, 9) for k, v in want.items()}, case
