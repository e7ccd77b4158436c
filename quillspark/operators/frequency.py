"""Tokens and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

TOKEN, PREFIX = r"\p{L}{2,}", 3


def term_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", pattern: str = TOKEN, *keep: str) -> DataFrame:
    """(key, *keep, term), a row for each token in lower case."""
    return docs.select(key, *keep, F.explode(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))).alias("term"))


def counts(rows: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def top(df: DataFrame, by: str, n: int, *ties: str) -> DataFrame:
    """The first n by `by`, descending; ties by other columns, so that the result is one."""
    return df.orderBy(F.desc(by), *ties).limit(n)


def top_in_groups(df: DataFrame, group: str, by: Column, n: int, *ties: str, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(group).orderBy(by.desc(), *ties)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def vocabulary(terms: DataFrame) -> DataFrame:
    """(term, feature_index): alphabetical, from 0.

    A term's place is the number of terms with a smaller beginning of PREFIX characters and its place among those with the
    same one, so no task has more than the terms of one beginning, or the list of beginnings.
    """
    rows = terms.select("term").distinct().withColumn("_head", F.substring("term", 1, PREFIX))
    before = F.sum("_n").over(Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1))
    heads = rows.groupBy("_head").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0)))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_head").orderBy("term")) - 1
    return rows.join(heads, "_head").select("term", place.cast("int").alias("feature_index"))


def cleaned_counters(tokens: DataFrame) -> DataFrame:
    """One row: tokens before and after cleaning, different words and lemmas (columns raw_word, word, lemma)."""
    return tokens.agg(
        F.count_if(F.col("raw_word").isNotNull()).alias("tokens_before"),
        F.count_if(F.col("word").isNotNull()).alias("tokens_after"),
        F.count_distinct("word").alias("unique_words"),
        F.count_distinct("lemma").alias("unique_lemmas"),
    )
