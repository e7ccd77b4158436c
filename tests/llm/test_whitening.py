"""Whitening against numpy's eigenvectors of the covariance in exact sums."""

import math

import numpy as np
import pytest

from quillspark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, wanted=4):
    kept = [(i, tuple(math.floor(256 * float(np.float32(v))) for v in e)) for i, e in rows if e and all(v is not None and math.isfinite(v) for v in e)]
    distinct = sorted({x for _, x in kept})
    n, width = len(distinct), len(distinct[0])
    sums = [sum(x[d] for x in distinct) for d in range(width)]
    z = np.array([[n * v - s for v, s in zip(x, sums)] for x in distinct], float) / n
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1][:wanted], vectors[:, ::-1][:, :wanted]
    trace = sum(sum((n * v - s) ** 2 for v, s in zip(x, sums)) for x in distinct) / n**3
    out = {}
    for i, x in kept:
        d = [n * v - s for v, s in zip(x, sums)]
        out.setdefault(i, []).append((sum(v * v for v in d), np.array(d, float) / n @ vectors / np.sqrt(values)))
    return n, values / trace, out


def compare(got, rows):
    n, shares, want = plain(rows)
    signs = {}
    for r in got.orderBy("vec_id", "component").collect():
        deviation, w = want[r.vec_id][0]
        c = r.component - 1
        if abs(w[c]) > 1e-3:
            signs.setdefault(c, np.sign(w[c] * r.whitened))
        assert r.n == n and r.deviation == deviation and abs(r.explained - shares[c]) < 1e-9 * shares[c] and r.identity_error < 1e-9
        assert abs(signs.get(c, 1) * r.whitened - w[c]) < 1e-8
    assert got.count() == 4 * sum(map(len, want.values()))


def test_rows_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((400, 40)) * np.linspace(2, 0.1, 40)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500 + i, x[3].tolist()) for i in range(200)]
    rows += [(900, None), (901, []), (902, [None] + [0.5] * 39), (903, [float("nan")] + [0.5] * 39), (904, [float("inf")] * 40), (905, [0.0] * 40)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("vec_id", "id").selectExpr("id as vec_id", "embedding", "'x' as x", "1 as n").repartition(7)
    compare(whitening.whiten(df, whitening.fit(df)), rows)


def test_tables_without_variance_or_rows(spark):
    for rows in ([], [(1, None)], [(1, [0.5, 1.0]), (2, [0.5, 1.0])]):
        df = spark.createDataFrame(rows, SCHEMA)
        assert whitening.whiten(df, whitening.fit(df)).collect() == []
    df = spark.createDataFrame([(1, [0.5, 1.0, 0.0]), (2, [0.5, 3.0, 0.0]), (3, [0.5]), (None, [0.5, 2.0, 0.0])], SCHEMA)
    got = whitening.whiten(df, whitening.fit(df)).collect()
    assert sorted((r.vec_id or 0, r.component, round(abs(r.whitened), 9), r.explained) for r in got) == [(0, 1, 0, 1.0), (1, 1, round(1.5**0.5, 9), 1.0), (2, 1, round(1.5**0.5, 9), 1.0)]


def test_huge_entries_are_exact_or_null(spark):
    rows = [(1, [1e12, 1.0]), (2, [-1e12, 2.0]), (3, [0.0, 7.0]), (4, [1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(df, whitening.fit(df)).collect()
    assert {r.vec_id: r.deviation for r in got} == {1: None, 2: None, 3: (3 * 256 * 7 - 256 * 10) ** 2} and {r.vec_id for r in got} == {1, 2, 3}
    assert whitening.squares(whitening.differences(np.array([[1 << 52, 5]]), 1 << 20, [3, 4])) == [((1 << 72) - 3) ** 2 + (5 * (1 << 20) - 4) ** 2]


@pytest.mark.parametrize("width,rank,block", [(30, 30, 4), (200, 200, 8), (200, 5, 8), (64, 64, 16), (3, 3, 16), (50, 1, 3)])
def test_lanczos_with_breakdowns_and_equal_values(width, rank, block):
    rng = np.random.default_rng(width + rank)
    q = np.linalg.qr(rng.standard_normal((width, width)))[0]
    values = np.zeros(width)
    values[:rank] = np.sort(rng.uniform(1, 100, rank))[::-1]
    values[1:3][: rank - 1] = values[1] if rank > 1 else 0  # a double one
    a = (q * values) @ q.T
    found, vectors, calls = whitening.lanczos(lambda x: a @ x, width, 4, block)
    k = min(4, width)
    assert np.allclose(found, np.sort(values)[::-1][:k], atol=1e-9) and np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-10)
    assert np.allclose(a @ vectors, vectors * found, atol=1e-8) and calls <= -(-width // block) + 1
