"""What the training-data operators share: reading, lineage cuts and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a Python worker handles at once; a longer document makes a batch of its own.
BATCH_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local one, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(shared_dir, "own", None)
        if found is None:
            found = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="quillspark-")
    return found.rstrip("/")


def fresh(name: str, df: DataFrame) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint, which survives lost executors."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def released_shuffles(spark: SparkSession):
    """Shuffle files of what is written inside go when it is written, not when the driver collects garbage."""
    setting, conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", spark.conf
    before = conf.get(setting, "false")
    conf.set(setting, "true")
    try:
        yield
    finally:
        conf.set(setting, before)


class Scratch:
    """Tables written in the shared folder; columnar, so that later passes read only the columns they use.

    They go when the application ends; a result may still be read from them until then.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        path, files = self._at(self.root)
        files.deleteOnExit(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        with released_shuffles(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def _at(self, where: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def drop(self, name: str = "") -> None:
        path, files = self._at(self.path(name) if name else self.root)
        files.delete(path, True)


#: What a Python worker keeps between tasks: functions with cache_clear.
CACHES: list = []


def release_caches() -> None:
    """Workers are reused by later stages; those that need much memory first let go of what others kept."""
    for kept in CACHES:
        kept.cache_clear()


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `limit` bytes of the column `text`, so that memory is bounded by the longest row."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(size):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        yield batch.slice(start)


def map_slices(df: DataFrame, text: str, schema: str, of: Callable[[pa.RecordBatch], pa.RecordBatch | None], limit: int = BATCH_BYTES, release: bool = False) -> DataFrame:
    """mapInArrow over bounded slices; `of` gives the rows for a slice."""

    def run(batches):
        if release:
            release_caches()
        for part in slices(batches, text, limit):
            made = of(part)
            if made is not None and made.num_rows:
                yield made

    return df.mapInArrow(run, schema)


def raw(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
