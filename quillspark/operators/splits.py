"""Deterministic samples and splits, ordered by a hash of seed and key, with exact sizes."""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Rows of one range of hashes, about.
RANGE = 16_384


def shuffle_key(seed: int, *keys: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]), 256)


def balanced_pick(rows: DataFrame, group: str, size: str, key: str, low: int = 80, high: int = 250) -> DataFrame:
    """Smallest, middle and largest row of each group by (size, key), of those whose size lies in [low, high]. Groups under three rows are an error."""
    fit = rows.filter(F.col(size).between(low, high))
    w = Window.partitionBy(group)
    ranked = fit.withColumn("_rn", F.row_number().over(w.orderBy(size, F.col(key).cast("string"))) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    enough = F.when(F.col("_n") >= 3, True).otherwise(F.raise_error(F.lit("a group has under three rows")).cast("boolean"))
    picked = ranked.filter(enough & ((F.col("_rn") == 0) | (F.col("_rn") == F.floor(F.col("_n") / 2)) | (F.col("_rn") == F.col("_n") - 1)))
    return picked.drop("_rn", "_n")


def first_per_class(rows: DataFrame, label: str, order: str, n: int, strict: bool = False) -> DataFrame:
    """The first row of each class by `order`; of these the first n. Fewer than n classes are an error if strict."""
    if n < 1:
        raise ValueError("at least one row has to be picked")
    w = Window.partitionBy(label).orderBy(order)
    firsts = rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn").orderBy(order).limit(n)
    if strict and (found := firsts.count()) < n:
        raise ValueError(f"there are only {found} classes")
    return firsts


def _first_in_hash_order(rows: DataFrame, label: str, key: str, quotas: DataFrame, n: int, seed: int) -> DataFrame:
    """rows with _in: whether the row is among its class's first `_quota` by (hash of seed and key, key).

    Rows are counted by class and the first digits of their hash. Ranges of hashes are in or out as a whole, but for the one
    a class's quota cuts: only that is sorted, and it holds RANGE rows of a class or so, however many the class has.
    """
    digits = max(1, math.ceil(math.log(max(2, n / RANGE), 16)))
    hashed = rows.withColumn("_h", shuffle_key(seed, key)).withColumn("_b", F.substring("_h", 1, digits))
    counts = hashed.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # ranges, not rows
    ranges = counts.withColumn("_before", before).join(quotas, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")
    ranges = ranges.select(F.col(label).alias("_label"), F.col("_b").alias("_range"), "_before", "_k", "_quota")
    met = hashed.join(ranges, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_b") == F.col("_range"))).drop("_label", "_range")
    cut = (F.col("_before") < F.col("_quota")) & (F.col("_quota") < F.col("_before") + F.col("_k"))
    whole = met.filter(~cut).withColumn("_in", F.col("_before") < F.col("_quota"))
    place = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key))
    split = met.filter(cut).withColumn("_in", F.col("_before") + place <= F.col("_quota"))
    return whole.unionByName(split).drop("_h", "_b", "_before", "_k", "_quota")


def stratified_subset(rows: DataFrame, label: str, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Of each class the first max(1, round(n * fraction)) rows in hash order; round half to even."""
    classes = rows.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n"))
    quotas = classes.select("_label", F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(fraction)).cast("int")).alias("_quota"))
    return _first_in_hash_order(rows, label, key, quotas, rows.count(), seed).filter("_in").drop("_in")


def stratified_split(rows: DataFrame, label: str, key: str, test_share: float = 0.25, seed: int = 42) -> DataFrame:
    """rows with split = test or train: ceil(N * share) test rows in all, given to classes by largest remainder (ties by label)."""
    classes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    every = Window.partitionBy()  # a row for each class
    quota = classes.withColumn("_exact", F.col("_n") * F.ceil(F.sum("_n").over(every) * F.lit(test_share)) / F.sum("_n").over(every))
    quota = quota.withColumn("_low", F.floor("_exact")).withColumn("_left", F.ceil(F.sum("_n").over(every) * F.lit(test_share)) - F.sum("_low").over(every))
    quota = quota.withColumn("_place", F.row_number().over(Window.orderBy(F.desc(F.round(F.col("_exact") - F.col("_low"), 9)), label)))
    quota = quota.select(F.col(label).alias("_label"), (F.col("_low") + (F.col("_place") <= F.col("_left")).cast("int")).alias("_quota"))
    ranked = _first_in_hash_order(rows, label, key, quota, rows.count(), seed)
    return ranked.withColumn("split", F.when(F.col("_in"), "test").otherwise("train")).drop("_in")


def fingerprint(rows: DataFrame, order: str, *columns: str) -> DataFrame:
    """One row: SHA-256 of the columns' texts, row after row in order, and the number of rows.

    A digest of a sequence is sequential by definition: the sorted rows stream through one task, in bounded memory. It is
    meant for a few thousand texts; `content_fingerprint` is for any number.
    """
    text = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])

    def digest(batches):
        total, n = hashlib.sha256(), 0
        for batch in batches:
            n += batch.num_rows
            for x in batch.column(0).to_pylist():
                total.update(x.encode())
        yield pa.RecordBatch.from_pydict({"fingerprint": [total.hexdigest()], "n": [n]})

    return rows.select(text.alias("x"), F.col(order).alias("o")).repartition(1).sortWithinPartitions("o", "x").select("x").mapInArrow(digest, "fingerprint string, n long")


def content_fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: a digest of the set of rows, whatever their order (put the key among the columns), and their number.

    The eight 32-bit words of each row's SHA-256 are summed, so rows are combined where they lie and nothing is gathered.
    """
    row = F.sha2(F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("\1")) for c in columns]), 256)
    sums = [F.coalesce(F.sum(F.conv(F.substring("d", 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for k in range(8)]
    return rows.select(row.alias("d")).agg(F.sha2(F.concat_ws(":", *sums), 256).alias("fingerprint"), F.count(F.lit(1)).alias("n"))
