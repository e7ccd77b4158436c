"""Lemmas, parts of speech and cases from a dictionary of word forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def readings(dictionary: DataFrame) -> DataFrame:
    """One reading of each form: the smallest (lemma, pos, case), so that an ambiguous form adds no rows."""
    best = dictionary.groupBy("form").agg(F.min(F.struct("lemma", "pos", "case")).alias("reading"))
    return best.filter("form is not null")


def tag(rows: DataFrame, dictionary: DataFrame, key: str, column: str = "tokens") -> DataFrame:
    """rows with `tags`: array<struct<lemma, pos, case>> in step with the tokens; an unknown word is its own lemma, without pos and case.

    Rows have unique keys. Each document's different words, not its tokens, meet the dictionary (form, lemma, pos, case);
    whether it is broadcast or sorted is Spark's choice by size, and a hot word is split by adaptive execution.
    """
    words = rows.select(key, F.explode(F.array_distinct(column)).alias("form"))
    known = words.join(readings(dictionary), "form").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("form", "reading"))).alias("_known"))
    unknown = lambda w: F.struct(w.alias("lemma"), F.lit(None).cast("string").alias("pos"), F.lit(None).cast("string").alias("case"))
    tagged = F.transform(column, lambda w: F.coalesce(F.try_element_at("_known", w), unknown(w)))
    return rows.join(known, key, "left").withColumn("tags", tagged).drop("_known")


def tag_counts(tagged: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) over all tokens, keys of lemma, pos and case."""
    return tagged.select(F.explode("tags").alias("t")).groupBy(*[F.col("t")[k].alias(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
