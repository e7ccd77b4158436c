"""Neighbours and separation of sparse rows, and splits by ranges of hashes, against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.operators import blocks, retrieval, sparse, splits
from quillspark.plans import similarity


def rows_of(n, seed, terms=60):
    """Unit rows whose terms are frequent by Zipf's law; some rows are equal, some have one term."""
    r = random.Random(seed)
    out = {}
    for k in range(n):
        if k % 11 == 10:
            out[k] = dict(out[k - 3])
            continue
        found = Counter(f"t{min(int(r.paretovariate(0.7)), terms)}" for _ in range(r.choice([1, 4, 9, 20])))
        raw = {t: (1 + math.log(c)) * (1 + int(t[1:]) / 10) for t, c in found.items()}
        size = math.sqrt(sum(v * v for v in raw.values()))
        out[k] = {t: v / size for t, v in raw.items()}
    return out


def brute(rows, k):
    out = {}
    for q, a in rows.items():
        scores = [(-sum(sorted(w * b[t] for t, w in a.items() if t in b)), d) for d, b in rows.items() if d != q and set(a) & set(b)]
        out[q] = [(d, round(-s, 6)) for s, d in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("rare", [2, 12, 1000])
def test_neighbours_are_those_of_all_pairs(spark, monkeypatch, rare):
    monkeypatch.setattr(sparse, "RARE", rare)
    rows = rows_of(150, rare)
    weights = spark.createDataFrame([(q, t, w) for q, a in rows.items() for t, w in a.items()], "doc_id long, term string, w double").repartition(4)
    got = defaultdict(list)
    for r in sparse.neighbours(weights, 3).orderBy("query", "rank").collect():
        got[r["query"]].append((r.neighbour, r.score))
    assert dict(got) == {q: x for q, x in brute(rows, 3).items() if x}
    assert sparse.candidates(weights, 3).count() < 150 * 149
    assert sparse.neighbours(weights.limit(0), 3).collect() == []


def test_separation_without_pairs(spark):
    rows = rows_of(40, 3) | {100: {}}
    label = {q: "ab"[q % 2] for q in rows}
    weights = spark.createDataFrame([(q, t, w) for q, a in rows.items() for t, w in a.items()], "doc_id long, term string, w double")
    classes = spark.createDataFrame(list(label.items()), "doc_id long, label string")
    cos = {(p, q): sum(w * rows[q].get(t, 0) for t, w in rows[p].items()) for p in rows for q in rows if p < q}
    same, other = ([c for (p, q), c in cos.items() if (label[p] == label[q]) is s] for s in (True, False))
    got = sparse.separation(weights, classes, "label").first()
    a, b = sum(same) / len(same), sum(other) / len(other)
    assert (got.mean_same, got.mean_different) == (round(a, 4), round(b, 4)) and abs(got.separation - (a - b)) < 1e-4


def test_texts_compared_by_sparse_rows(spark):
    rows = [(f"{g}{i}", g, f"{w} common text {w} {w} number") for g, w in (("x", "data"), ("y", "link")) for i in range(3)] + [("z", "y", None)]
    got = similarity.compare_tfidf(spark.createDataFrame(rows, "article_id string, document_id string, text string"), "document_id", "article_id").first()
    assert got.precision_at_k == round(6 / 7, 4) and got.n_queries == 7 and got.separation > 0.2


def test_scores_that_differ_late_are_ranked_in_full(spark):
    rows = spark.createDataFrame([(1, [0.60001]), (2, [0.60004]), (3, [1.0]), (4, [0.60004])], "id int, vector array<double>")
    assert [(r.id, r.similarity) for r in retrieval.search(rows, [1.0], 3, "id").collect()] == [(3, 1.0), (2, 0.6), (4, 0.6)]
    near = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6000001, 0.1]), (2, [0.6000004, 0.1])], "id long, vector array<double>")
    found = {(r["query"], r["rank"]): (r.neighbour, r.score) for r in retrieval.neighbours(near, 1, "id").collect()}
    assert found[(0, 1)] == (2, 0.6)


def hash_of(key, seed=42):
    return hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()


@pytest.mark.parametrize("size", [1, 5, 16_384])
def test_quotas_without_sorting_a_class(spark, monkeypatch, size):
    monkeypatch.setattr(splits, "RANGE", size)
    rows = [(k, "abc"[0 if k % 3 else k % 7 % 3]) for k in range(200)]
    data = spark.createDataFrame(rows, "id long, label string").repartition(5)
    classes = defaultdict(list)
    for k, c in rows:
        classes[c].append(k)
    want = {k for c, own in classes.items() for k in sorted(own, key=lambda k: (hash_of(k), k))[: max(1, round(len(own) * 0.5))]}
    assert {r.id for r in splits.stratified_subset(data, "label", "id", 0.5).collect()} == want
    split = {r.id: r.split for r in splits.stratified_split(data, "label", "id", 0.25).collect()}
    assert len(split) == 200 and Counter(split.values())["test"] == 50
    for c, own in classes.items():
        order = [split[k] for k in sorted(own, key=lambda k: (hash_of(k), k))]
        assert order == sorted(order) and abs(order.count("test") - len(own) * 0.25) < 1
    assert splits.stratified_subset(data.limit(0), "label", "id", 0.5).collect() == []
    assert data.join(splits.stratified_subset(data.withColumn("label", F.lit(None).cast("string")), "label", "id", 0.1).select("id"), "id").count() == 20


@pytest.mark.parametrize(("rows", "groups"), [(8192, 6), (20, 3)])
def test_neighbours_of_copies_and_of_groups(spark, monkeypatch, rows, groups):
    for name, n in (("ROWS", rows), ("GROUPS", groups), ("FEW", 20), ("RARE", 5), ("WIDE", 7), ("STRIP", 300)):
        monkeypatch.setattr(sparse, name, n)
    own = rows_of(120, 4)
    for q in range(3, 120, 3):
        own[q] = dict(own[3])  # equal rows, many more than are asked for
    weights = spark.createDataFrame([(q, t, w) for q, a in own.items() for t, w in a.items()], "doc_id long, term string, w double").repartition(5)
    got = defaultdict(list)
    for r in sparse.neighbours(weights, 4).orderBy("query", "rank").collect():
        got[r["query"]].append((r.neighbour, r.score))
    assert dict(got) == {q: x for q, x in brute(own, 4).items() if x}
    different = len({tuple(sorted(a.items())) for a in own.values()})
    assert different < 90 and sparse.candidates(weights, 4).count() < different * (different - 1)  # copies are compared once


def test_rows_of_blocks_are_equal_for_equal_documents(spark):
    docs = spark.createDataFrame([(1, ["b", "a", "z", "c"]), (2, ["a", "c", "b", "z"]), (3, ["y", "a", "a"])], "doc_id long, tokens array<string>")
    counted = blocks.counted(docs.repartition(3), "doc_id")
    known = spark.createDataFrame([("a", 1.1, 0), ("b", 1.3, 1), ("c", 1.7, 2), ("z", 1.9, -1), ("y", 2.3, -1)], "term string, idf double, feature_index int")
    got = {r.doc_id: (r.indices, r["values"]) for r in blocks.sparse_rows(counted, known, ["doc_id"], sublinear=True).collect()}
    assert got[1] == got[2] and got[1][0] == [0, 1, 2] and got[3][0] == [0]
    assert abs(got[3][1][0] - (1 + math.log(2)) * 1.1 / math.hypot((1 + math.log(2)) * 1.1, 2.3)) < 1e-12


@pytest.mark.parametrize("rare", [0, 3, 1000])
def test_lists_and_dense_products_give_the_same_pairs(monkeypatch, rare):
    for name, n in (("RARE", rare), ("WIDE", 7), ("STRIP", 300)):
        monkeypatch.setattr(sparse, name, n)
    rows = rows_of(60, 8, 20)
    number = {t: i for i, t in enumerate(sorted({t for a in rows.values() for t in a}))}
    cells = {q: sorted((number[t], w) for t, w in a.items()) for q, a in rows.items()}
    table = pa.table({"mark": [b"%02d" % q for q in rows], "indices": pa.array([[t for t, _ in c] for c in cells.values()], pa.list_(pa.int32())), "values": [[w for _, w in c] for c in cells.values()], "group": pa.array([q % 2 for q in rows], pa.int32())})
    got = defaultdict(list)
    for low, high in ((0, 0), (0, 1), (1, 1)):
        own = table.filter(pa.array([q % 2 in (low, high) for q in rows]))
        for r in sparse._meet(4)((pa.scalar(low), pa.scalar(high)), own).to_pylist():
            got[int(r["query"])].append((-r["s"], int(r["other"])))
    want = {q: [x for x in found if x[1] > 0] for q, found in brute(rows, 3).items()}
    assert {q: [(d, round(-s, 6)) for s, d in sorted(x for x in got[q] if x[1] != q)[:3]] for q in rows} == want


@pytest.mark.parametrize("groups", [1, 4, 5])
def test_each_two_groups_meet_once_in_rounds(spark, monkeypatch, groups):
    monkeypatch.setattr(sparse, "SHIFTS", 1)
    rows = [(bytes([g, k]), [0, 1 + k], [0.6, 0.8], g) for g in range(groups) for k in range(2)]
    dealt = spark.createDataFrame([(bytearray(m), i, v, g) for m, i, v, g in rows], "mark binary, indices array<int>, values array<double>, group int")
    got = [(bytes(r.query), bytes(r.other), r.s) for r in sparse._in_rounds(dealt, groups, 100).collect()]
    want = [(a[0], b[0], 1.0 if a[1] == b[1] else 0.36) for a in rows for b in rows]
    assert sorted(got) == sorted(want)
