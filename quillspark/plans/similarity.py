"""Comparing representations of the same texts, and keeping encoded vectors under a key of what they were made of."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import retrieval, sparse, splits, tfidf
from quillspark.operators.classify import Encoder, encode_documents
from quillspark.plans.analysis import WORD
from quillspark.session import work_dir


def tfidf_weights(texts: DataFrame, key: str, pattern: str = WORD) -> DataFrame:
    """(key, term, w): sublinear TF-IDF over words and pairs of words, each text's row of length 1."""
    tokens = texts.select(key, F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0)).alias("tokens"))
    tf = tfidf.term_frequencies(tfidf.with_bigrams(tokens, key), key)
    return tfidf.weigh(tf, tfidf.fit(tf, texts.count()), key, sublinear=True).select(key, "term", "w")


def compare_tfidf(texts: DataFrame, label: str, key: str, k: int = 2, pattern: str = WORD) -> DataFrame:
    """One row: separation of labels, precision@k and hit rate@k of TF-IDF rows, none of which is ever dense."""
    spark, path = texts.sparkSession, work_dir(texts.sparkSession, "weights")
    tfidf_weights(texts, key, pattern).write.parquet(path)
    weights = spark.read.parquet(path)
    judged = retrieval.judged(sparse.neighbours(weights, k, key), texts, key, label, k)
    return sparse.separation(weights, texts, label, key).crossJoin(judged)  # one row each


def compare(texts: DataFrame, label: str, key: str, encoder: Encoder, encoder_size: int, k: int = 2) -> DataFrame:
    """A row for each representation: separation of labels, precision@k and hit rate@k."""
    v = encode_documents(texts, encoder, encoder_size, key, most=90).join(texts.select(key, label), key)
    judged = retrieval.judged(retrieval.neighbours(v, k, key), v, key, label, k)
    encoded = retrieval.separation(v, label, encoder_size).crossJoin(judged)  # one row each
    return compare_tfidf(texts, label, key, k).select(F.lit("tfidf").alias("model"), "*").unionByName(encoded.select(F.lit("encoder").alias("model"), "*"))


def cached_vectors(texts: DataFrame, encoder: Encoder, size: int, folder: str, model: str, key: str) -> tuple[DataFrame, bool]:
    """(key, vector), and whether they were found: Parquet tables named by model, number of texts and fingerprint."""
    spark = texts.sparkSession
    mark = splits.content_fingerprint(texts, key, "text").first()
    path = f"{folder.rstrip('/')}/{hashlib.sha256(f'{model}:{mark.n}:{mark.fingerprint}'.encode()).hexdigest()}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    if not found:
        encode_documents(texts, encoder, size, key).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), found
