"""One place that builds sessions, so tests, bench and scripts share the settings."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group of written tables and of a batch to a Python worker, so that a task holds little of either.
GROUP = 16 << 20


def local_session(cores: int | str = 8, app: str = "quillspark", **conf: str) -> SparkSession:
    """A local session; on a cluster, pass the session that spark-submit made instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": str(cores) if str(cores).isdigit() else "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where its folder is visible to them, whatever folder the driver was started in."""
    here, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if here not in paths:
        env["PYTHONPATH"] = os.pathsep.join(p for p in [here, *paths] if p)
    return spark


def work_dir(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share; without spark.checkpoint.dir a local one, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(work_dir, "own", None)
        if found is None:
            found = work_dir.own = "file://" + tempfile.mkdtemp(prefix="quillspark-")
    path = f"{found.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


@contextmanager
def freed_shuffles(spark: SparkSession):
    """The shuffle files of each write go when it ends."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


@contextmanager
def small_batches(spark: SparkSession):
    """Python workers get batches of GROUP bytes, however long the rows are."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(GROUP))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def saved(df: DataFrame, what: str, schema=None) -> DataFrame:
    """The table, written in the shared folder and read from there, by another schema of the same layout if one is given; the
    shuffle files of the write go when it ends."""
    spark, path = df.sparkSession, work_dir(df.sparkSession, what)
    with freed_shuffles(spark), small_batches(spark):
        df.write.options(**{"compression": "zstd", "parquet.block.size": GROUP}).parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


@contextmanager
def dropped_shuffles(spark: SparkSession, seconds: float = 5.0):
    """For fits of many steps: Spark deletes the shuffle files of past steps when the driver collects garbage, so it does so every few seconds."""
    done, runtime = threading.Event(), spark.sparkContext._jvm.java.lang.System

    def collect():
        while not done.wait(seconds):
            runtime.gc()

    thread = threading.Thread(target=collect, daemon=True)
    thread.start()
    try:
        yield
    finally:
        done.set()
        thread.join()
