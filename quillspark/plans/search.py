"""A saved index of articles by weighted word vectors, and searching it by text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import preview
from quillspark.operators import embeddings, retrieval
from quillspark.plans.analysis import preprocess
from quillspark.profiles import RUSSIAN, Profile
from quillspark.sources.models import load_table, save_table

TABLES = ("words", "idf", "articles", "vectors")


def save_index(folder: str, words: DataFrame, idf: DataFrame, articles: DataFrame, size: int, key: str = "article_id", lemmas: str = "lemmas") -> None:
    """Word vectors, idf weights, articles and their vectors as four tables. Articles without a known word have no vector and are not found."""
    tokens = articles.select(key, F.explode(lemmas).alias("term"))
    vectors = embeddings.weighted_means(tokens, words, idf, size, key)
    for name, df in zip(TABLES, (words, idf, articles, vectors)):
        save_table(df, f"{folder.rstrip('/')}/{name}")


def query_vector(terms: DataFrame, words: DataFrame, idf: DataFrame) -> list[float]:
    """The vector of one text's terms (a column term); an error if none is known."""
    size = len(words.select("vector").first()[0])
    found = embeddings.weighted_means(terms.select(F.lit(0).alias("q"), "term"), words, idf, size, "q").first()
    if found is None:
        raise ValueError("the query holds no known word")
    return list(found.vector)


def search(spark: SparkSession, folder: str, text: str, k: int = 5, profile: Profile = RUSSIAN, key: str = "article_id", length: int = 220) -> DataFrame:
    """The k articles nearest to a text: rank, similarity, the articles' columns and a preview."""
    if k < 1:
        raise ValueError("the number of results must be positive")
    words, idf, articles, vectors = (load_table(spark, f"{folder.rstrip('/')}/{name}") for name in TABLES)
    asked = preprocess(spark.createDataFrame([("q", text)], f"{key} string, text string"), profile, key=key)
    found = retrieval.search(vectors, query_vector(asked.select(F.explode("lemmas").alias("term")), words, idf), k, key).select(key, "similarity", "rank")
    return articles.join(found, key).withColumn("preview", preview(F.col("text"), length)).orderBy("rank")
