"""Delta-maintained token counts.

Totals by source, language and tokenizer version are sums of signed rows: an insert adds a document's counts, a delete
takes them away, a revision does both. A batch of changes is summed by key (combined before the shuffle, so a hot source
is a few rows a task) and written as one small table under its batch id. The commit is the rename that ends Spark's write:
a batch that was committed before is left as it is, and what a failed attempt left is replaced, so a batch counts once
however often it is applied. Totals read committed batches only. `compact` sums old batches into one, again as a commit,
and then removes the tables that it holds; the ids of their batches are kept beside it, so they are not applied again.

Texts are tokenized in one narrow stage. Equal texts are tokenized once by each worker that meets them (the counts of the
last COUNTED different texts are kept); to bring equal texts together first would shuffle every text.

Defined results: null text counts as empty, with no tokens; null sources and languages are a key of their own; ties and
repeated rows each count; a text of any length is counted whole; a key whose counts have all been taken away stays with
zeros until `compact` drops it; an empty batch is a commit without rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.bpe import codec, texts_of
from quillspark.llm.common import CACHES, Scratch, map_slices

COUNTED = 200_000
KEYS = ["source", "lang", "tokenizer"]
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


@lru_cache(maxsize=2)
def counted(vocabularies: tuple) -> dict[str, tuple[int, ...]]:
    """A worker's counts of texts, by their digest."""
    return {}


CACHES.append(counted)


def token_counts(docs: DataFrame, vocabularies: dict[str, str]) -> DataFrame:
    """doc_id, source, lang, copy_key, and for each tokenizer version (name to file) a column with the count of tokens."""
    names = list(vocabularies)

    def rows(batch):
        texts, keys, known = texts_of(batch.column("text")), batch.column("copy_key").to_pylist(), counted(tuple(vocabularies.items()))
        new = [i for k, i in {k: i for i, k in enumerate(keys)}.items() if k not in known]
        again = {k: known.pop(k) for k in set(keys).intersection(known)}  # what was met last goes last
        fresh = [texts[i] for i in new]
        again.update(zip([keys[i] for i in new], zip(*[[len(x) // 4 for x in codec(path).encode(fresh)] for path in vocabularies.values()])))
        known.update(again)
        for k in list(known)[: max(0, len(known) - COUNTED)]:
            del known[k]
        counts = [pa.array([again[k][n] for k in keys], pa.int64()) for n in range(len(names))]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "lang", "copy_key")), *counts], names=["doc_id", "source", "lang", "copy_key", *names])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")], F.sha2(F.coalesce("text", F.lit("")), 256).alias("copy_key"))
    return map_slices(own, "text", "doc_id long, source string, lang string, copy_key string, " + ", ".join(f"{n} long" for n in names), rows, 4 << 20)


def signed(groups: DataFrame, version: str, n: str, sign: int) -> DataFrame:
    """Signed rows for the documents counted in column n; column `version` holds the tokens of one of them."""
    return groups.select("source", "lang", F.lit(version).alias("tokenizer"), (F.col(n) * sign).alias("n_docs"), (F.col(version) * F.col(n) * sign).alias("n_tokens"))


class Rollup:
    """The committed batches under one folder of a store."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _done(self) -> list[str]:
        """Tables with a commit mark."""
        files, where = self._files(self.root)
        if not files.exists(where):
            return []
        names = [s.getPath().getName() for s in files.listStatus(where)]
        return sorted(n for n in names if not n.startswith("parts-") and files.exists(self._files(f"{self.root}/{n}/_SUCCESS")[1]))

    def _held(self, name: str) -> DataFrame:
        """value: the batches that a table holds."""
        if name.startswith("compact-"):
            return self.spark.read.text(f"{self.root}/parts-{name.removeprefix('compact-')}")
        return self.spark.createDataFrame([(name,)], "value string")

    def committed(self) -> list[str]:
        """The tables that count: no batch lies in two of them. What an unfinished `compact` left to remove is left out."""
        done = self._done()
        compacts = [n for n in done if n.startswith("compact-")]
        if not compacts:
            return done
        held = {n: self._held(n) for n in compacts}
        sizes = {n: held[n].count() for n in compacts}
        gone = set()
        for n in compacts:
            rest = [m for m in done if m not in compacts]
            inside = held[n].filter(F.col("value").isin(rest)).collect() if rest else []  # of the batches still there, few after a compact
            gone |= {r.value for r in inside}
            gone |= {m for m in compacts if m != n and sizes[m] < sizes[n] and held[m].join(held[n], "value", "left_anti").isEmpty()}
        return [n for n in done if n not in gone]

    def _applied(self, batch_id: str) -> bool:
        done = self._done()
        return batch_id in done or any(not self._held(n).filter(F.col("value") == batch_id).isEmpty() for n in done if n.startswith("compact-"))

    def apply(self, batch_id: str, deltas: DataFrame) -> bool:
        """Commit a batch of signed rows; False if it was committed before."""
        if not batch_id.replace("_", "").isalnum():
            raise ValueError("a batch id holds letters, digits and _ only")
        if self._applied(batch_id):
            return False
        deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.mode("overwrite").parquet(f"{self.root}/{batch_id}")
        return True

    def totals(self) -> DataFrame:
        paths = [f"{self.root}/{n}" for n in self.committed()]
        rows = self.spark.read.schema(TOTALS).parquet(*paths) if paths else self.spark.createDataFrame([], TOTALS)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def compact(self) -> None:
        """Sum all committed batches into one table and drop keys without documents and tokens. Its commit is what replaces
        them; then they are removed. Run it while nothing reads totals that were asked for before."""
        done, names = self._done(), self.committed()
        if len(names) > 1:
            name = hashlib.sha1("\n".join(names).encode()).hexdigest()
            parts = self._held(names[0])
            for n in names[1:]:
                parts = parts.union(self._held(n))
            parts.write.mode("overwrite").text(f"{self.root}/parts-{name}")
            self.totals().filter("n_docs <> 0 or n_tokens <> 0").write.mode("overwrite").parquet(f"{self.root}/compact-{name}")
        else:
            name = None
        kept = {f"compact-{name}"} if name else set(names)
        for n in done:
            if n not in kept:
                for gone in [n] + [f"parts-{n.removeprefix('compact-')}"] * n.startswith("compact-"):
                    files, where = self._files(f"{self.root}/{gone}")
                    files.delete(where, True)


def copy_groups(counts: DataFrame, versions: list[str]) -> DataFrame:
    """Documents with equal texts, source and language as one row: n of them, `left` (1 or 0) that stay when exact copies
    go, `gone` the others, and the tokens of one for each version. Of equal texts the smallest doc_id stays (null last).

    Copies are combined before the shuffle, so a hot text is a row for each source and language in a task.
    """
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    groups = counts.groupBy("copy_key", "source", "lang").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first"), *[F.max(v).alias(v) for v in versions])
    place = F.struct("first", F.coalesce("source", F.lit("")).alias("s"), F.coalesce("lang", F.lit("")).alias("l"), F.col("source").isNull().alias("sn"), F.col("lang").isNull().alias("ln"))
    groups = groups.withColumn("place", place)
    kept = groups.groupBy("copy_key").agg(F.min("place").alias("kept"))
    stays = F.col("place").eqNullSafe(F.col("kept")).cast("long")
    return groups.join(kept, "copy_key").withColumn("left", stays).withColumn("gone", F.col("n") - stays)


def maintained_totals(docs: DataFrame, vocabularies: dict[str, str]) -> DataFrame:
    """Totals after three batches: all documents inserted; exact copies deleted; counts of the first tokenizer version
    revised to the last one's for what is left. Each batch is applied twice, to the same effect."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "rollup")
    versions = list(vocabularies)
    old, new = versions[0], versions[-1]
    groups = scratch.write(copy_groups(scratch.write(token_counts(docs, vocabularies), "counts"), versions), "groups")
    rollup = Rollup(spark, scratch.path("batches"))
    batches = {
        "b1_insert": signed(groups, old, "n", 1),
        "b2_delete_copies": signed(groups, old, "gone", -1),
        "b3_revise": signed(groups, old, "left", -1).union(signed(groups, new, "left", 1)),
    }
    for name, deltas in [*batches.items(), *batches.items()]:
        rollup.apply(name, deltas)
    return rollup.totals()
