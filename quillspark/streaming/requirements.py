"""Requirement sentences from a stream of text files: stateless, so the batch operators are used as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.report import candidates
from quillspark.operators.sections import section_array
from quillspark.profiles import RUSSIAN, Profile


def stream_candidates(spark: SparkSession, folder: str, profile: Profile = RUSSIAN) -> DataFrame:
    """A streaming DataFrame: source_file, article_number, sentence_no, sentence, markers of files as they arrive in a folder."""
    files = spark.readStream.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("text"))
    parts = files.select("source_file", F.explode(section_array(F.col("text"), profile)).alias("a")).select("source_file", F.col("a.number").alias("article_number"), F.col("a.text").alias("text"))
    return candidates(parts, profile)


def write_once(stream: DataFrame, folder: str, checkpoint: str):
    """Handle what is there, append it as JSON lines exactly once, and stop; a later call goes on from the checkpoint."""
    return stream.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
