"""Bag of words and TF-IDF as long tables (doc, term, tf, w); zeros are never stored.

Vocabularies are pruned by document frequency before they meet the counts, counts are combined before the shuffle, and the
vocabulary side of the join is broadcast only when Spark finds it small.
"""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from quillspark.operators import blocks
from quillspark.session import saved


def by_document(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents dealt out by key: their texts move once, and counts and lengths by document need no more shuffle."""
    return docs.repartition(key)


def term_frequencies(rows: DataFrame, key: str = "doc_id", *keep: str) -> DataFrame:
    return rows.groupBy(key, *keep, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    """(term, df, total); tf has a row for each document and term."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))


def fit(tf: DataFrame, n_docs: int, min_df: int = 1, max_df: float = 1.0, max_features: int | None = None) -> DataFrame:
    """(term, df, total, idf): smooth idf ln((1 + N) / (1 + df)) + 1 of the terms kept."""
    return pruned(document_frequencies(tf), n_docs, min_df, max_df, max_features)


def pruned(frequencies: DataFrame, n_docs: int, min_df: int = 1, max_df: float = 1.0, max_features: int | None = None) -> DataFrame:
    """fit, from document frequencies (term, df, total)."""
    kept = frequencies.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    if max_features:
        kept = kept.orderBy(F.desc("total"), "term").limit(max_features)
    return kept.withColumn("idf", F.log(F.lit(1.0 + n_docs) / (F.col("df") + 1)) + 1)


def weigh(tf: DataFrame, vocabulary: DataFrame, key: str = "doc_id", sublinear: bool = False) -> DataFrame:
    """tf with w: tf * idf, each document's row scaled to length 1. Terms outside the vocabulary are left out."""
    raw = (F.log("tf") + 1 if sublinear else F.col("tf").cast("double")) * F.col("idf")
    weighed = tf.join(vocabulary.select("term", "idf"), "term").withColumn("raw", raw)
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return weighed.withColumn("w", F.col("raw") / length).drop("raw", "idf")


def column_means(weights: DataFrame, n_docs: int) -> DataFrame:
    """(term, score): means over all documents, zeros included."""
    return weights.groupBy("term").agg((F.sum("w") / n_docs).alias("score"))


def with_bigrams(tokens: DataFrame, key: str = "doc_id", column: str = "tokens") -> DataFrame:
    """(key, term): single tokens and neighbouring pairs of an array column."""
    t = F.col(column)
    pairs = F.zip_with(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return tokens.select(key, F.explode(F.concat(t, pairs)).alias("term"))


def distinctive(weights: DataFrame, doc_groups: DataFrame, group: str, n: int, key: str = "doc_id") -> DataFrame:
    """The n terms of each group with the greatest difference of mean weight in the group and in all others.

    A term that a group lacks has an own mean of 0 and so never beats one with a positive difference; it is not made.
    """
    sizes = doc_groups.groupBy(group).agg(F.count(F.lit(1)).alias("n_own"))
    sizes = sizes.withColumn("n_all", F.sum("n_own").over(Window.partitionBy()))  # a row for each group
    own = weights.join(doc_groups.select(key, group), key).groupBy(group, "term").agg(F.sum("w").alias("own"))
    return _most_distinctive(own, weights.groupBy("term").agg(F.sum("w").alias("total")), sizes, group, n)


def _most_distinctive(own: DataFrame, total: DataFrame, sizes: DataFrame, group: str, n: int) -> DataFrame:
    rows = own.join(total, "term").join(sizes, group)
    rows = rows.withColumn("own_mean", F.col("own") / F.col("n_own")).withColumn("other_mean", (F.col("total") - F.col("own")) / (F.col("n_all") - F.col("n_own")))
    rows = rows.withColumn("difference", F.round(F.col("own_mean") - F.col("other_mean"), 6))
    w = Window.partitionBy(group).orderBy(F.desc("difference"), "term")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select(group, "rank", "term", F.round("own_mean", 6).alias("own_mean"), F.round("other_mean", 6).alias("other_mean"), "difference")


def distinctive_in_blocks(counted: DataFrame, vocabulary: DataFrame, group: str, n: int) -> DataFrame:
    """distinctive, from blocks that keep their documents' group."""
    sizes = counted.select(F.explode(group).alias(group)).groupBy(group).agg(F.count(F.lit(1)).alias("n_own"))
    sizes = sizes.withColumn("n_all", F.sum("n_own").over(Window.partitionBy()))  # a row for each group
    own = saved(blocks.term_sums(counted, vocabulary, group).select(group, "term", F.col("s").alias("own")), "sums")
    return _most_distinctive(own, own.groupBy("term").agg(F.sum("own").alias("total")), sizes, group, n)


def idf_from_counts(tf: DataFrame, n_docs: int) -> DataFrame:
    """(term, idf) recovered from a bag of words."""
    return fit(tf, n_docs).select("term", "idf")


def sparse_vectors(weights: DataFrame, index: DataFrame, docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, vector): a sparse vector of Spark ML for each row of docs, of length 0 where it has no weighted term.

    Rows (term, w) and the index (term, feature_index) are written at `path` in the layout that vectors have there and read
    back as vectors: the fits that follow pass over them many times, and no Python makes them.
    """
    size = index.count()
    cells = weights.join(index, "term").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("feature_index", "w"))).alias("cells"))
    cells = docs.select(key).join(cells, key, "left").withColumn("cells", F.coalesce("cells", F.array().cast("array<struct<feature_index:int,w:double>>")))
    layout = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), F.col("cells.feature_index").alias("indices"), F.col("cells.w").alias("values"))
    cells.select(key, layout.alias("vector")).write.parquet(path)
    return docs.sparkSession.read.schema(T.StructType([docs.schema[key], T.StructField("vector", VectorUDT())])).parquet(path)


def written_vectors(rows: DataFrame, size: int) -> DataFrame:
    """rows with `vector`, a sparse vector of Spark ML, in place of indices and values; written as sparse_vectors writes them."""
    layout = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), "indices", "values")
    held = [f for f in rows.schema if f.name not in ("indices", "values")]
    made = rows.select(*[f.name for f in held], layout.alias("vector"))
    return saved(made, "tfidf", T.StructType([*held, T.StructField("vector", VectorUDT())]))
