"""Readers with explicit schemas, checks at the edges, and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.html import act_text_column
from quillspark.functions.text import pattern_words
from quillspark.profiles import RUSSIAN, Profile

SOURCES = "id string, title string, topic string, url string"
META = "url string, fetched_at_utc string, sha256 string"
DOCUMENTS = SOURCES + ", fetched_at_utc string, sha256 string, word_count long, text string"
ARTICLES = "article_id string, document_id string, document_title string, article_number string, article_title string, text string"
PROCESSED = ARTICLES + ", clean_words array<string>, lemmas array<string>, stems array<string>, clean_word_count long"
ANALYSIS = (
    "source_file string, article_count long, candidate_count long, articles array<struct<number:string,title:string,text:string>>, "
    "candidate_requirements array<struct<article_number:string,sentence:string,markers:array<string>>>, warning string"
)
CONTROL = "sample_id string, article_id string, article_title string, expected_label string, text string, word_count long, source string"


def checked(df: DataFrame, good: Column, message: str) -> DataFrame:
    """The same rows; the query fails with `message` on the first row that is not good. It stays lazy and distributed."""
    return df.filter(F.coalesce(good, F.lit(False)) | F.raise_error(F.lit(message)).cast("boolean"))


def not_empty(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def read_sources(spark: SparkSession, path: str, host: str | None = None, path_prefix: str = "/") -> DataFrame:
    """A JSON list of sources: keys present, ids unique, https urls (of one host)."""
    df = not_empty(spark.read.schema(SOURCES).json(path, multiLine=True), "there are no sources")
    full = F.lit(True)
    for c in ("id", "title", "topic", "url"):
        full = full & (F.length(F.trim(F.coalesce(c, F.lit("")))) > 0)
    df = checked(df, full, "a source lacks id, title, topic or url")
    df = checked(df, url_ok(F.col("url"), host, path_prefix), "a url is not allowed")
    again = df.groupBy("id").count().filter("count > 1").select("id").limit(1).collect()
    if again:
        raise ValueError(f"the id {again[0].id} stands twice")
    return df


def url_ok(url: Column, host: str | None = None, path_prefix: str = "/") -> Column:
    part = lambda p: F.try_parse_url(url, F.lit(p))
    same = part("HOST") == host if host else part("HOST").isNotNull()
    return F.coalesce((part("PROTOCOL") == "https") & same & part("PATH").startswith(path_prefix), F.lit(False))


def missing_snapshots(sources: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Sources that have no saved page yet: what a fetcher has to get."""
    return sources.join(snapshots.select("id"), "id", "left_anti")


def read_snapshots(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(id, html bytes) of *.html and (id, meta) of *.meta.json in a folder."""
    name = F.regexp_extract("path", r"([^/]+?)\.(?:html|meta\.json)$", 1)
    pages = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(folder).select(name.alias("id"), F.col("content").alias("html"))
    meta = spark.read.schema(META).option("pathGlobFilter", "*.meta.json").json(folder, multiLine=True)
    meta = meta.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)\.meta\.json$", 1).alias("id"), "fetched_at_utc", "sha256")
    return pages, meta


def build_documents(sources: DataFrame, pages: DataFrame, meta: DataFrame, profile: Profile = RUSSIAN, least_words: int = 1000) -> DataFrame:
    """Documents of all sources: checksum proved, act text extracted, words counted."""
    joined = sources.join(pages, "id").join(meta, "id")
    joined = checked(joined, F.sha2("html", 256) == F.col("sha256"), "a saved page differs from its checksum")
    texts = joined.withColumn("text", act_text_column(F.decode("html", "UTF-8"), skip=profile.skip_prefixes, strict=True))
    counted = texts.withColumn("word_count", F.size(pattern_words(F.col("text"), profile.word)).cast("long"))
    counted = checked(counted, F.col("word_count") >= least_words, f"an act has under {least_words} words")
    return counted.select(*[f.name for f in T._parse_datatype_string(DOCUMENTS).fields])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENTS).json(path)


def read_processed(spark: SparkSession, path: str, least_words: int = 0) -> DataFrame:
    df = spark.read.schema(PROCESSED).json(path)
    return not_empty(df.filter(F.col("clean_word_count") >= least_words) if least_words else df, "there are no processed articles")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """source_file, text: each file whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("text"))


def read_analysis(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(ANALYSIS).json(path, multiLine=True)
    return checked(df, F.col("articles").isNotNull() & F.col("candidate_requirements").isNotNull(), "the JSON has no lists articles and candidate_requirements")


def read_control_examples(spark: SparkSession, path: str) -> DataFrame:
    """Control examples; a file that does not exist is an empty table."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], CONTROL)
    return spark.read.schema(CONTROL).json(path, multiLine=True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; a byte-order mark is taken off by the reader."""
    return spark.read.csv(path, schema=schema, header=True, encoding="UTF-8", multiLine=True, escape='"')


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Dense (id, vector) or sparse (row, term, value) matrices as Parquet."""
    return spark.read.parquet(path)


def constant(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, header: list[str] | None = None, allow_empty: bool = True) -> None:
    if not allow_empty:
        not_empty(df, "there are no rows to write")
    (df.select(*header) if header else df).write.mode("overwrite").csv(path, header=True, escape='"')


def summary_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    summary_json(df).write.mode("overwrite").text(path)


def write_matrix(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
