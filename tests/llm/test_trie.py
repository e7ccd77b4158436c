"""The prefix trie against a plain-Python one."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from quillspark.llm.trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[c].append(((turn is not None, turn or 0), tie, (role, text)))
    convs = {c: [x[2] for x in sorted(v, key=lambda x: x[:2])] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(convs.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    children, out = defaultdict(list), {}
    for p in members:
        if p:
            children[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        ends = ",".join(str(c) for c in members[p] if len(built[c]) == len(p))
        kids = [out[q] for q in children[p]]
        out[p] = (members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(kids), sum(k[5] for k in kids) or 1, (len(members[p]) - 1) * words + sum(k[6] for k in kids), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=lambda r: (r[1], r[0]))


def same(spark, rows, parts=3):
    got = prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: (r[1], r[0])) == plain_trie(rows)


def test_random_conversations(spark):
    r = random.Random(3)
    rows = []
    for c in [*range(0, 130), *range(-45, 0, 4), 10**12, 10**12 + 20]:
        rows += [(c, t, r.choice(["user", "assistant"]), r.choice(["hi", "a b", "", "c d  e\n f"])) for t in range(r.choice([1, 1, 2, 3, 5, 9, 17]))]
    same(spark, rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (5, None, None, None), (5, 1, None, ""), (5, 1, "", None), (5, 1, "a", "bc"), (5, 1, "ab", "c"), (7, 3, "u", "x" * 300_000), (7, 3, "u", "x" * 300_000), (25, 0, "u", "hi"), (45, 0, "u", "hi")]
    same(spark, rows)
    wide = spark.createDataFrame([(1, "x", "y", "z", "w", 0, "u", "hi")], "conv_id int, name string, key string, pos string, first string, turn int, role string, text string")
    assert [tuple(r)[:4] for r in prefix_trie(wide).orderBy("depth").collect()] == [(1, 0, None, 1)] + [(1, 1, 1, 1)] * (zlib.crc32(b"1") % 4 == 0)


def test_empty_and_turnless(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    alone = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4]
    same(spark, [(c, 0, "user", "hi") for c in alone])


def test_one_conversation_and_one_opening_of_most_rows(spark):
    rows = [(41, t, "user", f"turn {t % 7} of many") for t in range(700)] + [(60 + 20 * n, t, "user", "the same") for n in range(300) for t in range(2)]
    same(spark, rows, parts=5)


def test_ranges_that_are_drawn_twice(spark):
    """More rows than are sampled for the bounds of ranges, many partitions, and partitions that are not merged again."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    held = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = [(c, t, "user", f"turn {(c * 7 + t) % 11}") for c in range(0, 1200) for t in range(1 + c % 13)]
        same(spark, rows, parts=1)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
