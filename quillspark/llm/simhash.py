"""SimHash near-dedup with BK-trees.

Fingerprints are made document by document. Only different fingerprints are compared. Their 64 bits are cut into six
blocks; two that differ in four bits or fewer agree on at least two whole blocks, so they share at least one of the 15
(pair of blocks, value) buckets. In each bucket the fingerprints form BK-trees of bounded size (children keyed by their
Hamming distance to the parent) and a search follows only the edges within the radius. A bucket of more than SHARD
fingerprints is cut into shards by a hash: each shard's tree goes to those tasks that hold another shard of that bucket
(a bounded piece is sent, never a table), so no group is gathered in one task and no link is lost. What belongs to a very
common fingerprint, component or bucket is brought to its rows by a broadcast of bounded size (`spread_join`), never by
dealing those rows out by that key.

Defined results: a text without words (null, empty, white space) has fingerprint zero and is linked like any other; a text
of any length is read whole, PART shingles at a time. Repeated rows and exact copies share a fingerprint. A null doc_id
keeps its fingerprint and takes part in linking; a component without any doc_id has a null component_id. A bit that is set
in exactly half the hashes is 0. `simhash_dedup` settles ties by doc_id (nulls last), then by a hash of the row.
Extra columns are ignored by `simhash_groups` and pass through `simhash_dedup`. An empty table gives an empty table.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillspark.llm.common import cut, fresh, map_slices, raw
from quillspark.llm.components import components, hot_from, spread_join

RADIUS, SHINGLE, SEED, SHARD, PART = 4, 4, 42, 2048, 65536
#: First bit and width of each of six blocks.
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0d divide
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
    n = len(starts)
    total = np.zeros(64, np.int64)
    for at in range(0, n, PART):  # bounded memory for very long texts
        part = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[at : at + PART], (ends[shingle - 1 :] - 1)[at : at + PART].tolist())), np.uint64)
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), row (the column of longs of that name, if one is given)."""

    def rows(batch):
        fps = np.array([fingerprint(t) for t in raw(batch.column("text"))], np.uint64)
        more = {} if row is None else {"row": batch.column("row")}
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(fps.view(np.int64))} | more)

    more = [] if row is None else [F.col(row).alias("row")]
    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more), "text", "doc_id long, fp long" + ", row long" * len(more), rows)


class BKTree:
    """Nodes hold a fingerprint and children by distance; search follows the edges d-radius to d+radius only."""

    def __init__(self):
        self.root = None

    def add(self, fp: int) -> None:
        if self.root is None:
            self.root = (fp, {})
            return
        node = self.root
        while d := (node[0] ^ fp).bit_count():
            child = node[1].get(d)
            if child is None:
                node[1][d] = (fp, {})
                return
            node = child

    def within(self, fp: int, radius: int):
        stack = [self.root] if self.root else []
        while stack:
            at, children = stack.pop()
            d = (at ^ fp).bit_count()
            if d <= radius:
                yield at
            if children:
                stack += [c for k, c in children.items() if d - radius <= k <= d + radius]


def _forest(links, parent: dict):
    """Of the links, those that join what was apart: as many as connect the same fingerprints."""

    def find(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for a, b in links:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[ra] = rb
            yield a, b


def _bucket_links(trees: np.ndarray, asking: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links inside one shard (asking None: as the tree grows, each asks those before it) or between two shards."""
    tree, found = BKTree(), []
    if asking is None:
        for fp in trees.tolist():
            found += [(fp, other) for other in tree.within(fp, radius)]
            tree.add(fp)
    else:
        for fp in trees.tolist():
            tree.add(fp)
        for fp in asking.tolist():
            found += [(fp, other) for other in tree.within(fp, radius)]
    return list(_forest(found, {}))


def _search(radius: int):
    """Over rows sorted by (bucket, i, j, side): i = j one shard of a bucket; i < j two shards, side 0 the tree's."""

    def run(batches):
        rest = None
        for batch in _with_end(batches):
            if batch is not None:
                cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("bucket", "i", "j", "side", "fp")]
                rest = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols)]
            if rest is None or not len(rest[0]):
                continue
            new = np.flatnonzero((rest[0][1:] != rest[0][:-1]) | (rest[1][1:] != rest[1][:-1]) | (rest[2][1:] != rest[2][:-1])) + 1
            cuts = np.concatenate(([0], new, [len(rest[0])]))
            whole = len(cuts) - 1 if batch is None else len(cuts) - 2  # the last group may go on
            a, b = [], []
            many = np.flatnonzero(np.diff(cuts[: whole + 1]) > 1)
            for g in many.tolist():
                s, e = cuts[g], cuts[g + 1]
                fps, side = rest[4][s:e].view(np.uint64), rest[3][s:e]
                for x, y in _bucket_links(fps[side == 0], None if rest[1][s] == rest[2][s] else fps[side == 1], radius):
                    a.append(x)
                    b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(v, np.uint64).view(np.int64)) for v in (a, b)], names=["a", "b"])
            rest = [x[cuts[whole] :] for x in rest]

    return run


def _with_end(batches):
    yield from batches
    yield None


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b): enough of the links between fingerprints (column fp, no repeats) to connect all that are linked."""
    keys = []
    for n, (x, y) in enumerate(combinations(range(6), 2)):
        (p, w), (q, v) = BLOCKS[x], BLOCKS[y]
        part = lambda first, width: F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))
        keys.append(F.lit(n << 24).cast("long").bitwiseOR(F.shiftleft(part(p, w), 11)).bitwiseOR(part(q, v)))
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    hot = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard).select("bucket", "n", F.ceil(F.col("n") / shard).cast("int").alias("shards"))
    very = F.col("n") > max(shard, hot_from(len(keys) * distinct.count()))  # so few that they can be broadcast
    often = F.broadcast(hot.filter(very).select("bucket", "shards"))
    rest = rows.join(often.select("bucket"), "bucket", "left_anti").join(hot.filter(~very).select("bucket", "shards"), "bucket", "left")
    own = F.pmod(F.xxhash64("fp"), F.coalesce("shards", F.lit(1))).cast("int")
    spread = (
        rows.join(often, "bucket").unionByName(rest)
        .withColumn("own", own)
        .select("bucket", "fp", "own", F.explode(F.sequence(F.lit(0), F.coalesce("shards", F.lit(1)) - 1)).alias("other"))
        .select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp")
    )
    return spread.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side").mapInArrow(_search(radius), "a long, b long")


def simhash_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that is reached over links of `radius` bits or fewer."""
    prints = cut(fingerprints(docs))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    joined = components(fingerprint_links(distinct.select("fp"), radius))
    # Each fingerprint's component, then the least document of the component. Fingerprints without links are their own.
    linked = cut(distinct.join(joined, distinct.fp == joined.node).select("fp", "least", "n", "component"))
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of = spread_join(linked.select("fp", "component", F.col("n").alias("copies")), least, "component", linked.count())
    alone = distinct.join(joined, distinct.fp == joined.node, "left_anti").select("fp", F.col("least").alias("component_id"), "n")
    named = cut(of.select("fp", "component_id", F.col("copies").alias("n")).unionByName(alone))
    return spread_join(prints, named, "fp", prints.count()).select("doc_id", "fp", "component_id")


def simhash_dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each group stays: that with the smallest doc_id, rows without one last; of rows that share it, that with the smallest hash.

    The choice is a minimum, combined before each shuffle. Rows that are the same in all columns are told apart by a row number.
    """
    id_, row, n = (fresh(x, docs) for x in ("_id", "_row", "_n"))
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    marked = docs.withColumn(id_, F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).withColumn(row, F.xxhash64(*hashed))
    prints = cut(fingerprints(marked, row))
    distinct = cut(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("idless"), "doc_id", "row")).alias("best")))
    joined = components(fingerprint_links(distinct.select("fp"), radius))
    of = distinct.join(joined, distinct.fp == joined.node, "left").select("best", F.coalesce("component", "fp").alias("component"))
    best = of.groupBy("component").agg(F.min("best").alias("best"))
    keep = best.select(F.coalesce("best.doc_id", F.lit(0)).alias(id_), F.col("best.row").alias(row))
    kept = marked.join(keep, [id_, row], "left_semi")
    return kept.withColumn(n, F.row_number().over(Window.partitionBy(id_, row).orderBy(row))).filter(F.col(n) == 1).drop(id_, row, n)
