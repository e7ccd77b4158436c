"""An independent Feistel network in plain Python: whole texts must agree, and every pseudonym must be of its kind again."""

import hashlib
import random
import unicodedata
from datetime import date, timedelta

import pytest

from quillspark.llm import pii

from .conftest import KEY

regex = pytest.importorskip("regex")
SETS = {"hex": ["0123456789", "abcdef", "ABCDEF"], "plain": ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]}
NAMES = [*SETS["plain"]]
for block in (range(0xC0, 0x250), range(0x386, 0x3CF), range(0x400, 0x460)):
    NAMES += ["".join(chr(c) for c in block if unicodedata.category(chr(c)) == "Ll" or chr(c) in "ªº"), "".join(chr(c) for c in block if unicodedata.category(chr(c)) == "Lu")]


def keyed(kind, round_, *rest):
    return int(hashlib.sha256("|".join(map(str, (KEY, kind, round_, *rest))).encode()).hexdigest()[:12], 16)


def shift(c, by, sets):
    for letters in sets:
        if c in letters:
            return letters[(letters.index(c) + by) % len(letters)]
    return c


def permute(text, kind, sets):
    half = (len(text) + 1) // 2
    sides = [text[:half], text[half:]]

    def turn(n, sign):
        move, other = (0, 1) if n % 2 else (1, 0)
        o = sides[other] if len(sides[other]) <= 64 else hashlib.sha256(sides[other].encode()).hexdigest()
        sides[move] = "".join(shift(c, sign * keyed(kind, n, i, o), sets) for i, c in enumerate(sides[move]))

    for n in range(1, 9):
        turn(n, 1)
    whole = "".join(sides)
    k = next(i for i, c in enumerate(whole) if c.isalnum())
    size = next(len(x) for x in sets if whole[k] in x)
    whole = whole[:k] + shift(whole[k], 1 + keyed(kind, 0) % (size - 1), sets) + whole[k + 1 :]
    sides = [whole[:half], whole[half:]]
    for n in range(8, 0, -1):
        turn(n, -1)
    return "".join(sides)


def permute_pair(pair, sizes, kind):
    pair = list(pair)
    for n, sign in [*((n, 1) for n in range(1, 9)), (0, 0), *((n, -1) for n in range(8, 0, -1))]:
        if n == 0:
            pair[0] = (pair[0] + 1 + keyed(kind, 0) % (sizes[0] - 1)) % sizes[0]
        else:
            k = 0 if n % 2 else 1
            pair[k] = (pair[k] + sign * keyed(kind, n, pair[1 - k])) % sizes[k]
    return pair


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(digits)))


def refill(shape, new):
    new = iter(new)
    return "".join(next(new) if c.isalnum() else c for c in shape)


def pseudonym(kind, m):
    plain = regex.sub("[^A-Za-z0-9]", "", m)
    if kind == "card":
        new = permute(plain[:-1], "card", SETS["plain"])
        return refill(m, new + str(-luhn(new + "0") % 10))
    if kind == "phone":
        return refill(m, plain[:-10] + permute(plain[-10:], "phone", SETS["plain"]))
    if kind == "iban":
        new = permute(plain[4:], "iban", SETS["plain"])
        return refill(m, plain[:2] + f"{98 - int(''.join(str(int(c, 36)) for c in new + plain[:2] + '00')) % 97:02d}" + new)
    if kind == "secret":
        return m[:4] + permute(m[4:], "access key", SETS["plain"]) if m[:4] in ("AKIA", "ASIA") else permute(m, "secret", SETS["hex"])
    if kind == "email":
        name, _, domain = m.partition("@")
        if all(c in "._%+-" or any(c in x for x in NAMES) for c in name):
            return permute(name, "email", NAMES) + "@" + domain
        o = name if len(name) <= 64 else hashlib.sha256(name.encode()).hexdigest()
        return "".join(c if c in "._%+-" else SETS["plain"][1][keyed("name", 0, i, o) % 26] for i, c in enumerate(name)) + "@" + domain
    if kind == "ip":
        a, b, c, d = map(int, m.split("."))
        x, y = permute_pair((a * 256 + b, c * 256 + d), (65536, 65536), "ip")
        return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    if kind == "ssn":
        area, group, serial = map(int, m.split("-"))
        areas = [x for x in range(1, 900) if x != 666]
        x, y = permute_pair((areas.index(area), (group - 1) * 9999 + serial - 1), (898, 989901), "ssn")
        return f"{areas[x]:03d}-{y // 9999 + 1:02d}-{y % 9999 + 1:04d}"
    day = (date.fromisoformat(m) - date(1700, 1, 1)).days
    x, y = permute_pair((day // 773, day % 773), (189, 773), "date")
    return str(date(1700, 1, 1) + timedelta(x * 773 + y))


def values(seed, n):
    r = random.Random(seed)
    digits = lambda k: "".join(r.choices("0123456789", k=k))

    def card():
        body = digits(r.randint(12, 18))
        return body + str(-luhn(body + "0") % 10)

    def iban():
        body = "".join(r.choices("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=r.randint(11, 30)))
        return f"DE{98 - int(''.join(str(int(c, 36)) for c in body + 'DE00')) % 97:02d}" + body

    def email():
        letters = r.choice(["abcxyz019._%+-", "éßüñaz.", "иванЁя", "αβΩ1", "字漢a", "éo", "ÀÝz", "a"])
        name = r.choice([c for c in letters if c.isalnum()]) + "".join(r.choices(letters, k=r.choice([0, 1, 5, 20, 90, 200])))
        return name + "@" + r.choice(["example.com", "mail.example.org", "bücher.example", ".".join(["a"] * 40) + ".net"])

    def ssn():
        return f"{r.choice([x for x in (1, 2, 665, 667, 899, r.randint(1, 665))]):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"

    def secret():
        kind = r.choice(["0123456789abcdef", "0123456789ABCDEF", "AKIA"])
        if kind == "AKIA":
            return "AKIA" + "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=16))
        return "0123" + "".join(r.choices(kind, k=r.choice([12, 30, 160, 1000]))) + kind[-1]

    made = {"card": card, "iban": iban, "email": email, "ssn": ssn, "secret": secret, "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
            "phone": lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", "date": lambda: str(date(1700, 1, 1) + timedelta(r.randrange(146097)))}
    return [(kind, make()) for kind, make in made.items() for _ in range(n)]


def test_whole_texts_agree_with_plain_python(spark):
    found = values(5, 40)
    texts = [(i, f"see {v} and ", v, kind) for i, (kind, v) in enumerate(found)]
    random.Random(1).shuffle(texts)
    rows = [(k, "Ünïcode: " + "; ".join(t[1] for t in texts[k : k + 4]) + ".") for k in range(0, len(texts), 4)]
    got = {r.doc_id: r for r in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    for k, _ in rows:
        want = "Ünïcode: " + "; ".join(f"see {pseudonym(t[3], t[2])} and " for t in texts[k : k + 4]) + "."
        assert got[k].text == want and got[k].n_pii == len(texts[k : k + 4])


def test_pseudonyms_differ_and_are_found_again(spark):
    found = values(9, 500)
    first = {r.doc_id: r for r in pii.pii_report(spark.createDataFrame([(i, v) for i, (_, v) in enumerate(found)], "doc_id long, text string").repartition(8), KEY).collect()}
    again = {r.doc_id: r for r in pii.pii_report(spark.createDataFrame([(i, r.text) for i, r in first.items()], "doc_id long, text string").repartition(8), KEY).collect()}
    for i, (kind, v) in enumerate(found):
        assert first[i].text != v and first[i][f"n_{kind}"] == 1, (kind, v)
        assert again[i][f"n_{kind}"] == 1 and again[i].text != first[i].text, (kind, v, first[i].text)


def test_whole_small_domains_are_permuted(spark):
    letters = [(i, f"{a}@x.com") for i, a in enumerate("abcdefghijklmnopqrstuvwxyz0123456789éüжЖ")]
    got = pii.pii_report(spark.createDataFrame(letters, "doc_id long, text string"), KEY).collect()
    assert len({r.text for r in got}) == len(letters) and all(r.text != dict(letters)[r.doc_id] for r in got)


def test_key_is_drawn_or_set(spark):
    assert len(pii.run_key(spark)) == 64 and pii.run_key(spark) == pii.run_key(spark)
    spark.conf.set(pii.KEY_SETTING, "mine")
    try:
        assert pii.run_key(spark) == "mine"
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_no_name_and_very_long_names(spark):
    rows = [(1, "_%+-@example.com"), (2, "x" * 20000 + "@example.com"), (3, "a" * 300000), (4, "1" * 300000), (5, "a." * 100000 + "@" + "b." * 50000)]
    got = {r.doc_id: r for r in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    assert got[1].n_pii == 0 and got[2].n_email == 1 and got[2].text != rows[1][1] and len(got[2].text) == 20012
    assert all(got[k].text == rows[k - 1][1] for k in (1, 3, 4, 5))


def mask(text):
    """A text with its valid values replaced, in plain Python."""

    def one(m):
        m = m[0]
        digits = regex.sub("[^A-Za-z0-9]", "", m)
        if "@" in m:
            return pseudonym("email", m)
        if regex.fullmatch(r"\d+(\.\d+){3}", m):
            return pseudonym("ip", m) if all(int(x) < 256 for x in m.split(".")) else m
        if regex.fullmatch(r"\d{4}-\d\d-\d\d", m):
            return pseudonym("date", m)
        if digits.isdigit() and 13 <= len(digits) <= 19 and luhn(digits) % 10 == 0:
            return pseudonym("card", m)
        return m

    return regex.sub(pii.ANY, one, text)


def test_pipeline_against_brute_force(spark, tmp_path):
    """All five stages, each in plain Python: quality, groups of near copies, repeated strings, pseudonyms, ids of the pieces."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    tokenizers = pytest.importorskip("tokenizers")
    import zlib

    import numpy as np
    from pyspark.sql import functions as F

    from quillspark.llm import quality
    from quillspark.llm.queries import vocabulary

    from .conftest import texts
    from .test_documents import brute_fingerprint
    from .test_odd_input import removed

    r = random.Random(12)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(2, 8)))
    passage = " ".join(word() for _ in range(40))
    rows = list(enumerate(texts(21, 60)))
    for i in range(100, 160):
        body = [word() for _ in range(r.randint(60, 160))]
        body[r.randrange(60)] = r.choice(["mail me@example.com", "10.20.30.40", "1999-05-17", "4845168114407329", "300.1.1.1", passage, passage])
        rows.append((i, " ".join(body)))
    rows += [(200 + k, rows[-1 - k][1]) for k in range(10)] + [(220, rows[-1][1].replace(" ", "  ", 1)), (230, None), (231, ""), (232, "x " * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text"), "fp": F.lit("clash"), "runs": F.lit("clash"), "key": F.lit("clash")})
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set(pii.KEY_SETTING, KEY)
    try:
        got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset(pii.KEY_SETTING)

    good = [(d, t) for d, t in rows if quality.measure([(t or "").encode()])["kept"][0]]
    fps = {d: brute_fingerprint(t) for d, t in good}
    group = {d: d for d in fps}
    while True:  # least id over links, until nothing changes
        new = {d: min(group[e] for e in fps if (fps[d] ^ fps[e]).bit_count() <= 4) for d in fps}
        if new == group:
            break
        group = new
    one = [(d, t) for d, t in good if group[d] == d]
    left = {}
    for d, (b, cov) in removed(one).items():
        keep = bytearray(not c for c in cov)
        for i, x in enumerate(b):  # characters stay whole
            if x & 0xC0 == 0x80:
                keep[i] = keep[i] or keep[i - 1]
        for i in range(len(b) - 1, 0, -1):
            if b[i] & 0xC0 == 0x80 and keep[i]:
                keep[i - 1] = 1
        left[d] = mask(bytes(x for x, k in zip(b, keep) if k).decode())
    assert 40 < len(left) < len(rows) and any(left[d] != t for d, t in one)
    t = tokenizers.Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()
    want = {d: t.encode(x, add_special_tokens=False).ids + [2] for d, x in left.items()}
    pieces = {}
    for p in got:
        pieces.setdefault(p.doc_id, []).append(p)
    assert set(pieces) == set(want)
    for d, ids in want.items():
        at = 0
        for p in sorted(pieces[d], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
