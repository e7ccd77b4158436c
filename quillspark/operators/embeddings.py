"""Word vectors with Spark ML or by blocks, subword vectors, and what is asked of vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import PCA, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.vectors import cosine, dot, element_sums, gathered, unit
from quillspark.operators import skipgram
from quillspark.session import freed_shuffles


@dataclass(frozen=True)
class Trained:
    """Vectors (word, vector) trained by blocks and their losses (epoch, loss), by the getters of Spark ML's model."""

    vectors: DataFrame
    losses: DataFrame
    size: int
    epochs: int

    def getVectors(self) -> DataFrame:  # noqa: N802
        return self.vectors

    def getVectorSize(self) -> int:  # noqa: N802
        return self.size

    def getMaxIter(self) -> int:  # noqa: N802
        return self.epochs


def word2vec(docs: DataFrame, size: int = 100, window: int = 5, least: int = 3, epochs: int = 80, seed: int = 42, column: str = "tokens", partitions: int = 1, key: str | None = None):
    """A fitted skip-gram model; getVectors() gives (word, vector).

    Without `key` it is Spark ML's (hierarchical softmax): each epoch takes all vectors through the driver and into every task,
    and with more than one partition the same rows may give other vectors. With the documents' `key` blocks of words are trained
    with negative samples (skipgram.train): neither the driver nor a task holds all vectors, and all numbers come from the seed.
    """
    if key is None:
        sentences = docs.filter(F.size(column) >= 5)
        return Word2Vec(vectorSize=size, windowSize=window, minCount=least, maxIter=epochs, numPartitions=partitions, seed=seed, inputCol=column, outputCol="vector").fit(sentences)
    with freed_shuffles(docs.sparkSession):  # short chains of steps: each step of a job holds a copy of all vectors on disk
        out = skipgram.train(docs, key, size, window, least, epochs=epochs, seed=seed, column=column, chain=2)
    return Trained(out["words"], out["losses"], size, epochs)


def ngrams(word: Column, low: int = 3, high: int = 6) -> Column:
    """Character n-grams of a word in angle brackets."""
    w = F.concat(F.lit("<"), word, F.lit(">"))
    one = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(n)))
    return F.array_distinct(F.filter(F.concat(*[one(n) for n in range(low, high + 1)]), lambda g: F.length(g) >= low))


def buckets(word: Column, n: int = 50_000) -> Column:
    return F.transform(ngrams(word), lambda g: F.pmod(F.xxhash64(g), F.lit(n)))


def subword_table(vectors: DataFrame, size: int, n_buckets: int = 50_000) -> DataFrame:
    """(bucket, vector): the mean of the vectors of known words that hold an n-gram of the bucket."""
    rows = vectors.select(F.explode(buckets(F.col("word"), n_buckets)).alias("bucket"), "vector")
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *element_sums(F.col("vector"), size)).select("bucket", gathered(size, F.col("n")).alias("vector"))


def subword_vectors(words: DataFrame, table: DataFrame, size: int, n_buckets: int = 50_000) -> DataFrame:
    """(word, vector) of any words, known or not, as means over their n-grams' buckets; null without any known bucket."""
    rows = words.select("word", F.explode(buckets(F.col("word"), n_buckets)).alias("bucket")).join(table, "bucket", "left")
    sums = rows.groupBy("word").agg(F.count("vector").alias("n"), *element_sums(F.col("vector"), size))
    return sums.select("word", F.when(F.col("n") > 0, gathered(size, F.col("n"))).alias("vector"))


def most_similar(vectors: DataFrame, query: Column, n: int, exclude: tuple = (), key: str = "word", vector: str = "vector") -> DataFrame:
    """(key, cosine to four digits): the n nearest of the rows to one query vector by the full cosine; a TakeOrdered, without a join."""
    rows = vectors.filter(~F.col(key).isin(*exclude)) if exclude else vectors
    return rows.select(key, cosine(F.col(vector), query).alias("cosine")).orderBy(F.desc("cosine"), key).limit(n).withColumn("cosine", F.round("cosine", 4))


def combined(vectors: DataFrame, plus: list, minus: list, key: str = "word", vector: str = "vector") -> list[float] | None:
    """Mean of the unit vectors of a few named rows, the second list's with a minus; None if one is unknown."""
    found = {r[0]: r[1] for r in vectors.filter(F.col(key).isin(*plus, *minus)).select(key, unit(F.col(vector))).collect()}
    if any(k not in found for k in (*plus, *minus)):
        return None
    signed = [[x for x in found[k]] for k in plus] + [[-x for x in found[k]] for k in minus]
    return [sum(c) / len(signed) for c in zip(*signed)]


def weighted_means(tokens: DataFrame, vectors: DataFrame, idf: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """(key, vector): unit idf-weighted mean of the known tokens' vectors; weight 1 where a token has no idf. Rows without known tokens or of length 0 are left out.

    Tokens are counted before they meet the vectors, so a hot token is one row a document.
    """
    tf = tokens.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    rows = tf.join(vectors.select(F.col("word").alias("term"), "vector"), "term").join(idf, "term", "left")
    rows = rows.withColumn("k", F.col("tf") * F.coalesce("idf", F.lit(1.0)))
    sums = rows.groupBy(key).agg(Summarizer.mean(array_to_vector(F.col("vector").cast("array<double>")), F.col("k")).alias("v"))  # one aggregate of vectors
    return sums.select(key, vector_to_array("v").alias("vector")).filter(dot(F.col("vector"), F.col("vector")) > 0).select(key, unit(F.col("vector")).alias("vector"))


def pooled(chunks: DataFrame, size: int, key: str) -> DataFrame:
    """(key, vector): unit mean of the chunk vectors of an owner; a zero mean stays zero."""
    sums = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *element_sums(F.col("vector"), size))
    return sums.select(key, unit(gathered(size, F.col("n"))).alias("vector"))


def pca_plane(vectors: DataFrame, key: str, size: int, vector: str = "vector") -> DataFrame:
    """(key, pca_1, pca_2), centred."""
    means = vectors.agg(F.count(F.lit(1)).alias("n"), *element_sums(F.col(vector), size)).select(gathered(size, F.col("n")).alias("m"))
    rows = vectors.select(key, F.col(vector)).crossJoin(F.broadcast(means))  # one row
    ready = rows.select(key, array_to_vector(F.zip_with(F.col(vector).cast("array<double>"), "m", lambda x, m: x - m)).alias("v"))
    plane = PCA(k=2, inputCol="v", outputCol="p").fit(ready).transform(ready)
    return plane.select(key, *[vector_to_array("p")[i].alias(f"pca_{i + 1}") for i in (0, 1)])
