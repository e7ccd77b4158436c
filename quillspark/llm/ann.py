"""Approximate nearest neighbours with shifted space-filling curves.

Every vector gets a Hilbert key in each of several orderings: an own random projection to a few dimensions and an own
shift. The rows are range-partitioned by (ordering, key) into parts of part_rows rows, PARTS an ordering at least. A query
goes to its own part of each ordering and to the neighbouring parts on either side; there it is compared with whole parts,
and the lists from all orderings are merged and reranked by the exact inner product.

How many orderings and how many parts on either side is fitted on a bounded sample: SAMPLE queries are compared with all
rows, and of the choices that find TARGET of their neighbours the one is taken that compares the least. So clustered
vectors get narrow windows. Vectors without any structure have no ordering that keeps their neighbours together: the least
is then one ordering with a window of all its parts, where each query meets each row once. The same rule decides at every
size.

A task holds one part and a bounded number of queries; queries, not parts, are copied. A group of equal vectors is parted
by vec_id in the range order. Lists travel as one row for each query and part.

Defined results: vectors that are null, empty, zero, of another length than most (of lengths as frequent, the greatest
counts), or that hold null or non-finite components take no part, neither as queries nor as candidates. Rows that share a
vec_id count as one candidate, with the best score, and none of them is a candidate for a query of that vec_id. Ties go to
the smaller vec_id. With fewer candidates than k, all are returned. Extra columns are ignored. An empty table gives an
empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillspark.llm.common import Scratch
from quillspark.llm.hilbert import hilbert_keys, quantised

ORDERINGS, DIMENSIONS, BITS = 4, 4, 15
PART_ROWS, PARTS, SAMPLE, TARGET = 4096, 32, 64, 0.95
ASKED = 512  # queries compared with a part at once


def valid_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, vec of the vectors that take part."""
    v = F.col("embedding")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vec"), fine.alias("fine")).filter("vec_id is not null and fine").drop("fine")
    most = own.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return own.filter(F.size("vec") == (most["n"] if most else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _keys(orderings: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vec"))
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            for o in range(orderings):
                rng = np.random.default_rng(100 + o)
                plane = np.linalg.qr(rng.standard_normal((x.shape[1], min(DIMENSIONS, x.shape[1]))))[0]
                shift = rng.uniform(-0.5, 0.5, plane.shape[1])
                keys = hilbert_keys(quantised(x @ plane * math.sqrt(x.shape[1]) + shift, BITS), BITS)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), o, np.int32)), pa.array(keys), batch.column("vec_id"), batch.column("vec")], names=["ord", "curve_key", "vec_id", "vec"])

    return run


def _best(ids: np.ndarray, data: np.ndarray, asked: np.ndarray, asked_ids: np.ndarray, k: int):
    """For each query its k best of the rows (ids ascending): exact scores, ties to the smaller id."""
    near = asked @ data.T
    near[asked_ids[:, None] == ids[None, :]] = -np.inf
    slack = 1e-9 * (1 + np.abs(near[np.isfinite(near)]).max(initial=0))
    for q, row in enumerate(near):
        floor = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
        at = np.flatnonzero((row >= floor - slack) & np.isfinite(row))
        exact = (data[at] * asked[q]).sum(axis=1)  # the same order of sums for each pair
        order = np.lexsort((ids[at], -exact))[:k]
        yield ids[at][order], exact[order]


LISTS = "query_id long, ids array<long>, scores array<double>"


def _lists(query: list, found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array([i for i, _ in found], pa.list_(pa.int64())), pa.array([s for _, s in found], pa.list_(pa.float64()))], names=["query_id", "ids", "scores"])


def _compare(k: int):
    """Over rows sorted by (ord, pos, kind): a part's rows, then the queries that visit it."""

    def run(batches):
        at, parts, data, ids, pending = None, [], None, None, []

        def answer():
            nonlocal pending
            if data is not None and len(ids) and pending:
                asked_ids = np.concatenate([i for i, _ in pending])
                asked = np.concatenate([v for _, v in pending])
                for s in range(0, len(asked), ASKED):
                    yield _lists(asked_ids[s : s + ASKED], list(_best(ids, data, asked[s : s + ASKED], asked_ids[s : s + ASKED], k)))
            pending = []

        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column("ord").to_numpy().astype(np.int64) << 40 | batch.column("pos").to_numpy().astype(np.int64)
            kind, vec_id, vec = batch.column("kind").to_numpy(), batch.column("vec_id").to_numpy(), _matrix(batch.column("vec"))
            cuts = np.flatnonzero((group[1:] != group[:-1]) | (kind[1:] != kind[:-1])) + 1
            for s, e in zip([0, *cuts], [*cuts, len(group)]):
                if group[s] != at:
                    yield from answer()
                    at, parts, data, ids = group[s], [], None, None
                if kind[s] == 0:
                    parts.append((vec_id[s:e], vec[s:e]))
                else:
                    if data is None and parts:
                        ids, data = np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts])
                        order = np.argsort(ids, kind="stable")
                        ids, data, parts = ids[order], data[order], []
                    pending.append((vec_id[s:e], vec[s:e]))
                    if sum(len(i) for i, _ in pending) >= 4 * ASKED:
                        yield from answer()
        yield from answer()

    return run


def _merge(k: int):
    """Over lists sorted by query: one ranking for each query."""

    def run(batches):
        query, best, rows = None, {}, []

        def close():
            top = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
            rows.extend((query, r, v, s) for r, (v, s) in enumerate(top, 1))

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.float64()))], names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for q, ids, scores in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if q != query:
                    if query is not None:
                        close()
                    query, best = q, {}
                for i, s in zip(ids, scores):
                    if s > best.get(i, -math.inf):
                        best[i] = s
                if len(best) > 50 * k:
                    best = dict(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])
            if len(rows) > 10000:
                yield out()
                rows = []
        if query is not None:
            close()
        if rows:
            yield out()

    return run


def _merged(lists: DataFrame, k: int) -> DataFrame:
    return lists.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")


def _window(ranged: DataFrame, parts: DataFrame, is_query: Column, k: int, orderings: int) -> tuple[int, int]:
    """Orderings, and parts on either side, that find TARGET of the neighbours of a bounded sample of queries and compare the least."""
    sample = ranged.filter("ord = 0").filter(is_query).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", F.col("vec").cast("array<double>").alias("vec")).collect()
    if not sample:
        return 1, 0
    asked_ids, asked = np.array([r[0] for r in sample]), np.array([r[1] for r in sample])

    def brute(batches):
        for batch in batches:
            if batch.num_rows:
                ids, data = batch.column("vec_id").to_numpy(), _matrix(batch.column("vec"))
                order = np.argsort(ids, kind="stable")
                yield _lists(asked_ids, list(_best(ids[order], data[order], asked, asked_ids, k)))

    true = _merged(ranged.filter("ord = 0").select("vec_id", "vec").mapInArrow(brute, LISTS), k).select("query_id", "vec_id").collect()
    placed = {}
    near = ranged.sparkSession.createDataFrame([(int(i),) for i in {r.vec_id for r in true} | set(asked_ids.tolist())], "vec_id long")
    for r in ranged.select("ord", "part", "vec_id").join(F.broadcast(near), "vec_id").join(parts, ["ord", "part"]).select("vec_id", "ord", "pos", "n_parts").collect():
        placed.setdefault(r.vec_id, {})[r.ord] = (r.pos, r.n_parts)
    # How far apart a neighbour lies from its query: in each ordering (parts in a ring), then in the best of the first ones.
    apart = np.array([[min(d := abs(placed[r.query_id][o][0] - placed[r.vec_id][o][0]), placed[r.query_id][o][1] - d) for o in range(orderings)] for r in true])
    n_parts = np.array([placed[int(asked_ids[0])][o][1] for o in range(orderings)])
    choices = []
    for used in range(1, orderings + 1):
        if len(apart):
            near_enough = np.sort(apart[:, :used].min(axis=1))
            h = int(near_enough[math.ceil(TARGET * len(near_enough)) - 1])
        else:
            h = 0
        choices.append((float((np.minimum(2 * h + 1, n_parts[:used]) / n_parts[:used]).sum()), used, h))
    whole = (1.0, 1, int(n_parts[0]))
    share, used, h = min([*choices, whole])
    return used, h


def search(rows: DataFrame, is_query: Column, k: int = 20, orderings: int = ORDERINGS, part_rows: int = PART_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which is_query (on vec_id) holds."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "ann")
    own = valid_vectors(rows)
    keyed = own.mapInArrow(_keys(orderings), f"ord int, curve_key long, vec_id long, vec {own.schema['vec'].dataType.simpleString()}")
    count = own.count()
    n_parts = orderings * max(1, min(PARTS, count), math.ceil(count / part_rows))
    ranged = scratch.write(keyed.repartitionByRange(n_parts, "ord", "curve_key", "vec_id").withColumn("part", F.spark_partition_id()), "ranged")
    by = Window.partitionBy("ord")
    parts = ranged.groupBy("ord", "part").agg(F.count(F.lit(1)).alias("n")).select("ord", "part", (F.row_number().over(by.orderBy("part")) - 1).alias("pos"), F.count(F.lit(1)).over(by).cast("int").alias("n_parts"))
    parts = scratch.write(parts, "parts")
    used, h = _window(ranged, parts, is_query, k, orderings)
    placed = ranged.filter(F.col("ord") < used).join(parts, ["ord", "part"])
    steps = F.when(F.lit(2 * h + 1) >= F.col("n_parts"), F.sequence(F.lit(0), F.col("n_parts") - 1)).otherwise(
        F.transform(F.sequence(F.col("pos") - h, F.col("pos") + h), lambda p: F.pmod(p, F.col("n_parts")))
    )
    data = placed.select("ord", "pos", F.lit(0).alias("kind"), "vec_id", "vec")
    visits = placed.filter(is_query).select("ord", F.explode(steps).alias("pos"), F.lit(1).alias("kind"), "vec_id", "vec")
    lists = data.union(visits).repartition("ord", "pos").sortWithinPartitions("ord", "pos", "kind").mapInArrow(_compare(k), LISTS)
    return _merged(lists, k)
