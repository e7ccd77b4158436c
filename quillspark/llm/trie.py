"""A trie of conversation prefixes, named by prefix doubling.

Turns are named by dense numbers; a block of 2^k turns, at a multiple of 2^k, is named by the pair of its halves' names, so
blocks of all sizes take log2(longest) rounds and twice the turns in all. The prefix of d turns is composed along the binary
digits of d: the prefix up to the last set digit, then the block of that digit's size. A prefix is named by its smallest
member, which with its depth is the node itself. Every round is a grouped count, a numbering of the distinct pairs and a
join; a name that very many rows share is broadcast (`spread_join`), never gathered. Each round's table is written in the
shared folder, so a lost executor costs one round.

Subtree sums need no rounds: a conversation is the smallest member of its deeper nodes from one depth on, and these form a
chain. A node's subtree is its own chain from there on, and the whole chains of its other members.

Defined results: turns are ordered by `turn`, null first, and where it ties by the SHA-256 of role and text; null roles and
texts are empty; rows without a conv_id take no part; repeated rows are turns of their own; extra columns are ignored. An
empty table has no nodes, not even the root. Long texts are only hashed and counted, once.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch
from quillspark.llm.components import spread_join

#: Conversations whose numbers share all but the last digits of a group of this size begin alike; so many opening turns at most.
GROUP, OPENING = 20, 4
#: Bytes of a list of members that a worker holds at once.
CHUNK = 1 << 20


def words(text: str):
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def before(scratch: Scratch, df: DataFrame, by: str, order: list, sums: dict, name: str) -> DataFrame:
    """df with, for each name in `sums`, the sum of its column over the rows of the same `by` that come earlier in `order`.

    Rows are range-partitioned by group and order and summed within a partition; a group of any size spreads over many.
    Only the groups that go on from one partition to the next need an offset: one a partition, so these are broadcast.
    Bounds are drawn anew each time ranges are made, so rows are written with their partition before both sides read it.
    """
    laid = scratch.write(df.repartitionByRange(F.col(by), *order).withColumn("_pid", F.spark_partition_id()), name)
    inside = Window.partitionBy("_pid", by).orderBy(*order)
    parts = laid.groupBy(by, "_pid").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(by, "_pid", F.lag("_pid").over(Window.partitionBy(by).orderBy("_pid")).alias("_last"), *[F.sum(f"_{n}").over(earlier).alias(f"_{n}") for n in sums])
    offsets = offsets.filter("_last is not null").drop("_last")
    within = inside.rowsBetween(Window.unboundedPreceding, -1)
    joined = laid.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(n) for n, c in sums.items()]).join(F.broadcast(offsets), [by, "_pid"], "left")
    kept = [c for c in df.columns if c not in sums]
    return joined.select(*kept, *[(F.col(n) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in sums])


def numbered(scratch: Scratch, keys: DataFrame, name: str) -> DataFrame:
    """Distinct rows with a dense number, `name`, from 0 on: by partition, after the sizes of those before."""
    laid = scratch.write(keys.withColumn("_at", F.monotonically_increasing_id()), f"{name}-keys")
    pid, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = laid.groupBy(pid.alias("_pid")).agg((F.max(at) + 1).alias("_n"))  # a row a partition
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    return laid.withColumn("_pid", pid).join(F.broadcast(offsets), "_pid").withColumn(name, F.col("_offset") + at).drop("_pid", "_at", "_offset")


def named(scratch: Scratch, rows: DataFrame, key: str, name: str, total: int) -> DataFrame:
    """rows with a dense number of their `key` in its place."""
    keys = numbered(scratch, rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), name)
    return spread_join(rows, keys, key, total).drop(key)


def read_turns(scratch: Scratch, conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 0, name, words) of each turn, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    slim = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), words("text").cast("long").alias("words"))
    turns = scratch.write(slim.withColumn("one", F.lit(1).cast("long")), "slim")
    total = turns.count()
    turns = named(scratch, turns.withColumn("tie", F.col("key")), "key", "name", total)
    turns = turns.withColumn("again", F.monotonically_increasing_id())  # equal rows are told apart, so that no range is one key
    turns = scratch.write(turns, "named")
    placed = before(scratch, turns, "conv_id", [F.col("turn").asc_nulls_first(), F.col("tie"), F.col("again")], {"pos": F.col("one")}, "laid-turns")
    return scratch.write(placed.select("conv_id", "pos", "name", "words"), "turns")


def rebuilt(scratch: Scratch, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with the opening of their group's first one: (conv_id, size), and (conv_id, pos, name, words)."""
    c = F.col("conv_id")
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("conv_id", "n", (c - c % GROUP).alias("base"), (F.crc32(c.cast("string").cast("binary")) % OPENING).alias("h"))
    heads = sizes.select(c.alias("base"), F.col("n").alias("base_n"))
    plan = sizes.join(heads, "base", "left").withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0)))).drop("base_n")
    plan = scratch.write(plan.withColumn("size", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "plan")
    opening = turns.filter((F.col("pos") < OPENING - 1) & (c % GROUP == 0)).withColumnRenamed("conv_id", "base")
    lent = plan.filter("m > 0").join(opening, "base").filter("pos < h").select("conv_id", "pos", "name", "words")
    own = spread_join(turns, plan.select("conv_id", "h", "m", "n"), "conv_id", turns.count()).filter("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "name", "words")
    return plan.select("conv_id", "size"), scratch.write(lent.unionByName(own), "rebuilt")


def blocks(scratch: Scratch, turns: DataFrame, longest: int) -> list[DataFrame]:
    """(conv_id, j, name): the turns from j * 2^k on, 2^k of them, for each k with 2^k <= longest."""
    levels = [turns.select("conv_id", F.col("pos").alias("j"), "name")]
    while 2 << (len(levels) - 1) <= longest:
        k = len(levels)
        odd = F.col("j") % 2 == 1
        halves = levels[-1].groupBy("conv_id", F.shiftright("j", 1).alias("j")).agg(F.max(F.when(~odd, F.col("name"))).alias("a"), F.max(F.when(odd, F.col("name"))).alias("b"))
        pairs = scratch.write(halves.filter("b is not null").select("conv_id", "j", F.struct("a", "b").alias("pair")), f"pairs{k}")
        levels.append(scratch.write(named(scratch, pairs, "pair", "name", pairs.count()), f"blocks{k}"))
    return levels


def prefixes(scratch: Scratch, sizes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(conv_id, depth, first): of each prefix of each conversation its smallest member; depth 0 is all of them."""
    root = sizes.agg(F.min("conv_id")).first()[0]
    now = sizes.select("conv_id", F.lit(0).cast("long").alias("m"), F.lit(root).cast("long").alias("first"))
    for k in range(len(levels) - 1, -1, -1):
        even = now.withColumn("m", F.col("m") * 2)
        longer = even.join(levels[k].withColumnRenamed("j", "m"), ["conv_id", "m"])
        longer = scratch.write(longer.select("conv_id", F.struct("first", "m", "name").alias("key")), f"longer{k}")
        least = scratch.write(longer.groupBy("key").agg(F.min("conv_id").alias("first"), F.count(F.lit(1)).alias("n")), f"least{k}")
        found = spread_join(longer, least, "key", longer.count()).select("conv_id", (F.col("key.m") + 1).alias("m"), "first")
        now = scratch.write(even.unionByName(found), f"prefixes{k}")
    return now.withColumnRenamed("m", "depth")


def _joined(batches):
    """Rows sorted by node and member: the members' numbers, joined by commas, in chunks of bounded size."""
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    node, held, size, seq = None, [], 0, 0
    out: list = []

    def put():
        nonlocal held, size, seq
        if held:
            out.append((*node, pid, seq, ",".join(held)))
        held, size, seq = [], 0, seq + 1

    def made():
        columns = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns[:4]), pa.array(columns[4], pa.string())], names=["first", "depth", "pid", "seq", "ids"])

    for batch in batches:
        for first, depth, member in zip(*(batch.column(c).to_pylist() for c in ("first", "depth", "conv_id"))):
            if node != (first, depth):
                put()
                node = (first, depth)
            held.append(str(member))
            size += len(held[-1])
            if size > CHUNK:
                put()
        if out:
            yield made()
    put()
    if out:
        yield made()


def _hashed(batches):
    """Chunks sorted by node, partition and number: one running SHA-256 a node, so nothing is gathered."""
    node, sha = None, None
    for batch in batches:
        out: list = []
        for first, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("first", "depth", "ids"))):
            if node != (first, depth):
                if node:
                    out.append((*node, sha.hexdigest()))
                node, sha = (first, depth), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if out:
            yield _nodes(out)
    if node:
        yield _nodes([(*node, sha.hexdigest())])


def _nodes(rows: list) -> pa.RecordBatch:
    first, depth, sha = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(depth, pa.int64()), pa.array(sha)], names=["first", "depth", "ends_sha256"])


def ends(paths: DataFrame, sizes: DataFrame) -> DataFrame:
    """(first, depth, ends_sha256) of the nodes where a conversation ends."""
    last = paths.join(sizes.withColumnRenamed("size", "depth"), ["conv_id", "depth"])
    order = ["first", "depth", "conv_id"]
    chunks = last.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_joined, "first long, depth long, pid long, seq long, ids string")
    chunks = chunks.repartition("first", "depth").sortWithinPartitions("first", "depth", "pid", "seq")
    return chunks.mapInArrow(_hashed, "first long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    scratch = Scratch(conversations.sparkSession, "trie")
    sizes, turns = rebuilt(scratch, read_turns(scratch, conversations))
    longest = sizes.agg(F.max("size")).first()[0]
    if longest is None:
        return conversations.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    paths = prefixes(scratch, sizes, blocks(scratch, turns, longest) if longest else [])
    total = paths.count()

    # nodes: members, the longest of them, and the words of the last turn
    last = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "words")
    carried = spread_join(paths, sizes.withColumn("n", F.col("size") + 1), "conv_id", total)
    carried = carried.join(last, ["conv_id", "depth"], "left")
    nodes = carried.groupBy("first", "depth").agg(F.count(F.lit(1)).alias("n_convs"), F.max("size").alias("longest"), F.coalesce(F.max("words"), F.lit(0)).alias("words"))
    nodes = nodes.select("first", "depth", "n_convs", (F.col("longest") == F.col("depth")).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    nodes = scratch.write(nodes, "nodes")

    # chains: what a conversation's own nodes above a node sum to, and all of them
    order = [F.col("depth")]
    chain = scratch.write(before(scratch, nodes, "first", order, {"leaf_above": F.col("leaf"), "saved_above": F.col("saved")}, "laid-nodes"), "chains")
    whole = chain.groupBy("first").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saves"), F.min("depth").alias("top"), F.count(F.lit(1)).alias("n"))
    whole = scratch.write(whole, "whole")
    chain = spread_join(chain, whole, "first", total)

    # a row of each member in the nodes that are not its own brings its whole chain
    guests = paths.filter("first <> conv_id")
    owners = whole.select(F.col("first").alias("conv_id"), "leaves", "saves", "top")
    brought = spread_join(guests, owners.withColumn("n", F.col("top")).drop("top"), "conv_id", total)
    below = brought.groupBy("first", "depth").agg(F.sum("leaves").alias("leaves_below"), F.sum("saves").alias("saves_below"))

    # the parent of a chain's top is another conversation's node, all others' parents are in the chain
    tops = owners.select("conv_id", (F.col("top") - 1).alias("depth")).join(paths, ["conv_id", "depth"]).select(F.col("conv_id").alias("first"), (F.col("depth") + 1).alias("depth"), F.col("first").alias("parent"))
    found = chain.join(tops, ["first", "depth"], "left").withColumn("parent", F.when(F.col("depth") == 0, F.lit(None)).otherwise(F.coalesce("parent", "first")))
    found = scratch.write(found, "parents")
    children = found.filter("depth > 0").groupBy(F.col("parent").alias("first"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    out = found.join(children, ["first", "depth"], "left").join(below, ["first", "depth"], "left").join(ends(paths, sizes), ["first", "depth"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        F.col("first").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", zero("n_children").alias("n_children"),
        (F.col("leaves") - F.col("leaf_above") + zero("leaves_below")).alias("n_leaves"),
        (F.col("saves") - F.col("saved_above") + zero("saves_below")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
