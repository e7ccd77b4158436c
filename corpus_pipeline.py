"""A training-corpus pipeline of five operators: quality rules, near copies, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that the caller
writes as Parquet and reads again. All but the last return the columns of `documents`, with whatever other columns there
are, whatever their names. An empty table stays empty in every stage, and texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import Scratch, table
from quillspark.llm.packing import pack
from quillspark.llm.pii import pseudonymise, run_key
from quillspark.llm.quality import quality_filter
from quillspark.llm.queries import vocabulary
from quillspark.llm.simhash import simhash_dedup
from quillspark.llm.suffix import remove_repeats


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null, empty and short texts (under 50 words) fail; equal rows share their verdict."""
    return quality_filter(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest doc_id, rows without one last; of rows that tie, that with the smallest hash."""
    return simhash_dedup(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that an earlier document (smaller doc_id) holds. Rows without a doc_id stay whole; a null text stays null."""
    return remove_repeats(docs)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal data and secrets, by the session's key. A null text stays null; equal values stay equal."""
    return pseudonymise(docs, run_key(spark))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 ids. A null or empty text is its end id alone; equal rows are packed each."""
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", keep_quality),
    ("near copies", drop_near_copies),
    ("repeated passages", cut_repeats),
    ("personal data", mask_private),
    ("packing", pack_sequences),
]

#: XXH64 of shingles, links of fingerprints and tokenizers are beyond DuckDB's SQL; tests/llm holds all stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each one's rows written in the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{n}")
        if n:
            scratch.drop(f"stage{n - 1}")
    return docs
