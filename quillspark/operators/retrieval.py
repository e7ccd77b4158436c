"""Neighbours by inner product, and how good they are."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillspark.functions.vectors import dot, element_sums, unit

#: Rows that a task holds, queries that it compares with them at once, and tasks that a small table is dealt over.
BLOCK, ASKED, TASKS = 32_768, 256, 64


def search(rows: DataFrame, query: list[float], k: int, key: str, vector: str = "vector") -> DataFrame:
    """The rows with the k greatest inner products with one query vector, ranked from 1 by the full product; `similarity` shows four digits."""
    q = F.array(*[F.lit(float(x)) for x in query])
    best = rows.withColumn("similarity", dot(F.col(vector), q)).orderBy(F.desc("similarity"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), key))).withColumn("similarity", F.round("similarity", 4))  # k rows


def _best(k: int):
    """Over rows sorted by (part, asked): a part's rows, then those that ask for their neighbours in it, a batch at a time."""

    def run(batches):
        at, held, data, ids = None, [], None, None

        def answers(queries, vectors):
            for s in range(0, len(queries), ASKED):
                q, asked = queries[s : s + ASKED], vectors[s : s + ASKED]
                near = asked @ data.T
                near[np.asarray(q)[:, None] == ids[None, :]] = -np.inf
                slack = 1e-9 * (1 + np.abs(near[np.isfinite(near)]).max(initial=0))
                found, scores = [], []
                for row, own in zip(near, asked):
                    floor = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
                    place = np.flatnonzero((row >= floor - slack) & np.isfinite(row))
                    exact = (data[place] * own).sum(axis=1)  # the same order of sums for each pair, which a matrix product has not
                    first = np.argsort(-exact, kind="stable")[:k]  # ids ascend, so ties go to the smaller one
                    found.append(ids[place[first]])
                    scores.append(exact[first])
                yield q, found, scores

        for batch in batches:
            if not batch.num_rows:
                continue
            part, asked = batch.column("part").to_numpy(), batch.column("asked").to_numpy()
            keys = np.array(batch.column("k").to_pylist())
            vectors = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (asked[1:] != asked[:-1])) + 1
            for s, e in zip([0, *cuts], [*cuts, len(part)]):
                if part[s] != at:
                    at, held, data = part[s], [], None
                if not asked[s]:
                    held.append((keys[s:e], vectors[s:e]))
                    continue
                if data is None:
                    ids, data = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
                    order = np.argsort(ids, kind="stable")
                    ids, data, held = ids[order], data[order], []
                for q, found, scores in answers(keys[s:e], vectors[s:e]):
                    yield pa.RecordBatch.from_pydict({"query": pa.array(q.tolist()), "ids": pa.array([x.tolist() for x in found]), "scores": pa.array([x.tolist() for x in scores])})

    return run


def neighbours(rows: DataFrame, k: int, key: str, vector: str = "vector") -> DataFrame:
    """(query, rank, neighbour, score to six digits): each row's k nearest others by the full inner product; rows with unique keys and vectors of one length.

    The rows lie in parts of BLOCK; each row is sent once to every part, where it is compared by matrix products, and gives
    one list of k for each part. A small table's parts are compared in several tasks, a large one's in one each. Where
    N * N products are too many there is the approximate operator of the training-data part.
    """
    n = rows.count()
    parts = max(1, math.ceil(n / BLOCK))
    groups = max(1, min(math.ceil(n / 256), TASKS // parts))
    kind = rows.schema[key].dataType.simpleString()
    own = rows.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    data = own.select((F.pmod(F.xxhash64("k"), F.lit(parts)) * groups).alias("first"), F.lit(0).alias("asked"), "k", "v")
    data = data.select(F.explode(F.sequence(F.col("first"), F.col("first") + groups - 1)).alias("part"), "asked", "k", "v")
    asking = own.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"), (F.pmod(F.xxhash64(F.lit(1), "k"), F.lit(groups))).alias("g"), "k", "v")
    asking = asking.select((F.col("p") * groups + F.col("g")).alias("part"), F.lit(1).alias("asked"), "k", "v")
    met = data.union(asking).repartition("part").sortWithinPartitions("part", "asked").mapInArrow(_best(k), f"query {kind}, ids array<{kind}>, scores array<double>")
    lists = F.zip_with("ids", "scores", lambda i, s: F.struct((-s).alias("minus"), i.alias("id")))
    merged = met.select("query", lists.alias("near")).groupBy("query").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    ranked = merged.select("query", F.posexplode("near").alias("place", "x"))
    return ranked.select("query", (F.col("place") + 1).alias("rank"), F.col("x.id").alias("neighbour"), F.round(F.lit(0.0) - F.col("x.minus"), 6).alias("score"))


def judged(found: DataFrame, classes: DataFrame, key: str, label: str, k: int) -> DataFrame:
    """One row: precision@k (of k, even where fewer were found) and hit rate@k over all queries."""
    a = classes.select(F.col(key).alias("query"), F.col(label).alias("own"))
    b = classes.select(F.col(key).alias("neighbour"), F.col(label).alias("other"))
    each = a.join(found, "query", "left").join(b, "neighbour", "left").groupBy("query").agg(F.sum(F.coalesce((F.col("own") == F.col("other")).cast("int"), F.lit(0))).alias("hits"))
    return each.agg(F.round(F.avg(F.col("hits") / k), 4).alias("precision_at_k"), F.round(F.avg((F.col("hits") > 0).cast("int")), 4).alias("hit_rate_at_k"), F.count(F.lit(1)).alias("n_queries"))


def separation(rows: DataFrame, label: str, size: int, vector: str = "vector") -> DataFrame:
    """One row: mean cosine of pairs with the same and with different labels, and the difference.

    The sum of all pairs' cosines in a group is (|sum of unit vectors|^2 - n) / 2, so no pair is ever made.
    """
    u = rows.select(label, unit(F.col(vector)).alias("u")).filter(dot(F.col("u"), F.col("u")) > 0)
    groups = u.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *element_sums(F.col("u"), size))
    s = [F.col(f"_s{i}") for i in range(size)]
    square = lambda cols: sum((c * c for c in cols[1:]), cols[0] * cols[0])
    inner = groups.withColumns({"pairs": F.col("n") * (F.col("n") - 1) / 2, "total": (square(s) - F.col("n")) / 2})
    one = inner.agg(F.sum("pairs").alias("pairs"), F.sum("total").alias("total"), F.sum("n").alias("n"), *[F.sum(c).alias(f"_t{i}") for i, c in enumerate(s)])
    t = [F.col(f"_t{i}") for i in range(size)]
    all_pairs, all_total = F.col("n") * (F.col("n") - 1) / 2, (square(t) - F.col("n")) / 2
    same, different = F.col("total") / F.nullif("pairs", F.lit(0.0)), (all_total - F.col("total")) / F.nullif(all_pairs - F.col("pairs"), F.lit(0.0))
    return one.select(F.round(same, 4).alias("mean_same"), F.round(different, 4).alias("mean_different"), F.round(same - different, 4).alias("separation"))
