"""Experiment grids and their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import experiment_id

#: Learning rates with all data, shares with one rate, and the shared point.
RATES, SHARES, RATE, SHARE = (1e-5, 3e-5, 5e-5), (0.5, 0.75), 3e-5, 1.0


def grid(spark: SparkSession) -> DataFrame:
    """(experiment_id, learning_rate, fraction): rates with all data, and shares with the usual rate, each point once."""
    points = [(r, SHARE) for r in RATES] + [(RATE, s) for s in SHARES]
    rows = spark.createDataFrame(points, "learning_rate double, fraction double")
    return rows.select(experiment_id(F.col("learning_rate"), F.col("fraction")).alias("experiment_id"), "learning_rate", "fraction")


def factor(history: DataFrame, name: str, source: str) -> DataFrame:
    """Rows of the controlled runs (column source) in which only one factor changes."""
    own = history.filter(F.col("source") == source)
    return own.filter(F.col("fraction") == SHARE).orderBy("learning_rate") if name == "learning_rate" else own.filter(F.col("learning_rate") == RATE).orderBy("fraction")
