"""Vectors of words and of their contexts, trained by rotating blocks.

Words are dealt by hash into blocks of about `terms` words, at least `blocks`, so that small tables use all cores as well.
In a step, task b trains block b of the words with block b + shift of the contexts, on the pairs between the two: no two tasks
ever share a vector. After as many steps as there are blocks each pair was met. A visit passes over its pairs `passes` times,
so that the exchange of blocks, which costs a shuffle of the state, happens once for several epochs. A task carries the
blocks it trains and nothing else, as two matrices in binary columns; a few steps make one job, which ends in the shared
folder. All numbers come from the seed, so a task that is repeated after a loss does the same again.

Batches are runs of pairs of one word. Their gradients are summed by row and divided by the root of the summed squares
(AdaGrad) with the batch's own share in it, so that a row that a batch holds many times moves by the learning rate at most.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: A row a block and side (0 words, 1 contexts, 2 a part of the n-gram vectors); `extra` holds what an objective needs of the block.
STATE = "side int, block int, part int, n int, extra binary, value binary, seen binary, losses array<double>"
#: Gradients of a row that are summed along with those of all other rows.
LEVELS = 8
#: Buckets of n-grams in one row of the state.
PART = 4096


def _sorted(rows: np.ndarray) -> np.ndarray:
    """Places of rows in stable order; numbers of 16 bits are sorted by their digits, in linear time."""
    return np.argsort(rows.astype(np.uint16) if len(rows) and rows.max() < 1 << 16 else rows, kind="stable")


def run_sums(rows: np.ndarray, weights: np.ndarray, vectors: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and gradients weights * vectors; those of the full runs that a batch begins with are one gradient a run."""
    m = len(rows) // run
    blocks = rows[: m * run].reshape(m, run)
    full = (blocks == blocks[:, :1]).all(axis=1)
    lead = m if full.all() else int(full.argmin())
    c = lead * run
    sums = np.matmul(weights[:c].reshape(lead, 1, run), vectors[:c].reshape(lead, run, vectors.shape[1]))[:, 0]
    return np.concatenate([blocks[:lead, 0], rows[c:]]), np.concatenate([sums, weights[c:, None] * vectors[c:]])


def add_up(rows: np.ndarray, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows and the sums of their gradients: the first few of each row together, the rest of frequent rows by segments."""
    order = _sorted(rows)
    ordered = rows[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    counts = np.diff(starts, append=len(rows))
    total = grads.take(order[starts], axis=0)
    left = np.arange(len(starts))
    for k in range(1, LEVELS):
        left = left[counts[left] > k]
        if not len(left):
            return ordered[starts], total
        total[left] += grads.take(order[starts[left] + k], axis=0)
    left = left[counts[left] > LEVELS]
    if len(left):
        k = counts[left] - LEVELS
        ends = np.cumsum(k)
        places = np.arange(int(ends[-1])) + np.repeat(starts[left] + LEVELS - (ends - k), k)
        total[left] += np.add.reduceat(grads.take(order[places], axis=0), ends - k, axis=0)
    return ordered[starts], total


def descend(value: np.ndarray, seen: np.ndarray, rows: np.ndarray, grads: np.ndarray, rate: float) -> None:
    """One AdaGrad step; gradients of a row that occurs more than once are summed first."""
    if len(rows):
        at, total = add_up(rows, grads)
        squares = seen.take(at, axis=0)
        squares += total * total
        seen[at] = squares
        np.sqrt(squares, out=squares)
        np.divide(total, squares, out=total)
        total *= rate
        value[at] -= total


def batches(i: np.ndarray, run: int, size: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Places of pairs in batches of about `size`: runs of up to `run` pairs of one word, in random order, a batch's full runs first."""
    if not len(i):
        return []
    order = rng.permutation(len(i))
    order = order[_sorted(i[order])]
    a = i[order]
    first = np.r_[True, a[1:] != a[:-1]]
    start = np.flatnonzero(first)
    place = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)]))
    starts = np.flatnonzero(first | (place % run == 0))
    lengths = np.diff(np.r_[starts, len(a)])
    dealt = rng.permutation(len(starts))
    starts, lengths = starts[dealt], lengths[dealt]
    ends = np.cumsum(lengths)
    cuts = np.unique(np.minimum(np.searchsorted(ends, np.arange(size, len(a), size)), len(ends) - 1)) + 1
    within = np.lexsort((lengths < run, np.repeat(np.arange(len(cuts) + 1), np.diff(np.r_[0, cuts, len(starts)]))))
    bounds = ends[cuts - 1]
    starts, lengths = starts[within], lengths[within]
    ends = np.cumsum(lengths)
    places = np.arange(len(a)) + np.repeat(starts - (ends - lengths), lengths)
    return np.split(order[places], bounds)


@dataclass
class Side:
    """A block's vectors, the sums of squares of their gradients, what the objective keeps of them, and a table for draws that all passes of a visit share."""

    block: int
    value: np.ndarray
    seen: np.ndarray
    extra: bytes
    draws: object = None


#: (pairs i, j, x; words; contexts; n-grams or None; rng): the loss of one pass over a visit's pairs, which changes the sides.
Pass = Callable[[np.ndarray, np.ndarray, np.ndarray, Side, Side, "Side | None", np.random.Generator], float]


def _visit(width: int, make: Callable[[int, int, int, np.random.Generator], np.ndarray], one_pass: Pass, seed: int, done: int, shift: int, passes: int):
    """Trains one block of words and one of contexts on the pairs between them."""

    def matrix(raw, n):
        return np.frombuffer(raw, np.float32).reshape(n, width).copy()

    def train(key, pairs: pa.Table, state: pa.Table) -> pa.Table:
        rows = sorted(state.to_pylist(), key=lambda r: (r["side"], r["part"]))
        for r in rows:
            start = r["value"] is None
            r["v"] = make(r["side"], r["block"], r["part"], np.random.default_rng([seed, r["side"], r["block"] if r["side"] < 2 else 0, r["part"]]), r["n"]) if start else matrix(r["value"], r["n"])
            r["s"] = np.ones((r["n"], width), np.float32) if start else matrix(r["seen"], r["n"])
        of = lambda side: [r for r in rows if r["side"] == side]
        sides = []
        for side in (0, 1, 2):
            own = of(side)
            if own:
                sides.append(Side(own[0]["block"], np.concatenate([r["v"] for r in own]), np.concatenate([r["s"] for r in own]), own[0]["extra"]))
            else:
                sides.append(None)
        losses = None
        if pairs.num_rows and sides[0] is not None and sides[1] is not None:
            order = pairs.select(["i", "j", "x"]).sort_by([("i", "ascending"), ("j", "ascending")])
            i, j, x = (order.column(c).to_numpy() for c in ("i", "j", "x"))
            rng = np.random.default_rng([seed, 3, done, shift, sides[0].block])
            losses = [one_pass(i, j, x.astype(np.float32), *sides, rng) for _ in range(passes)]
        out = []
        for side in (0, 1, 2):
            at = 0
            for r in of(side):
                v, s = sides[side].value[at : at + r["n"]], sides[side].seen[at : at + r["n"]]
                at += r["n"]
                told = list(r["losses"] or [])
                if side == 0 and losses:
                    told += [0.0] * (done + passes - len(told))
                    for p, loss in enumerate(losses):
                        told[done + p] += loss
                out.append((side, r["block"], r["part"], r["n"], r["extra"], v.tobytes(), s.tobytes(), told))
        columns = list(zip(*out)) if out else [()] * 8
        kinds = [pa.int32()] * 4 + [pa.binary()] * 3 + [pa.list_(pa.float64())]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in STATE.split(", ")])

    return train


def deal(words: DataFrame, blocks: int) -> DataFrame:
    """words with block and row: their place in a block, in the order of words."""
    dealt = words.withColumn("block", F.pmod(F.xxhash64("word"), F.lit(blocks)).cast("int"))
    return dealt.withColumn("row", (F.row_number().over(Window.partitionBy("block").orderBy("word")) - 1).cast("int"))  # a block is bounded


def blocks_for(n_words: int, terms: int, least: int) -> int:
    return max(1, min(least, n_words), math.ceil(n_words / terms))


def lanes(spark, blocks: int) -> list[int]:
    """A number for each block, whose hash deals it a partition of its own among as many as there are blocks."""
    found: dict[int, int] = {}
    low, step = 0, max(1024, 8 * blocks)
    while len(found) < blocks:
        rows = spark.range(low, low + step, 1, 1).select(F.col("id").cast("int").alias("n"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(blocks)).alias("p"))
        for r in rows.groupBy("p").agg(F.min("n").alias("n")).collect():  # a row a block
            found.setdefault(r.p, r.n)
        low += step
    return [found[b] for b in range(blocks)]


def rotate(places: DataFrame, pairs: DataFrame, state: DataFrame, folder: str, blocks: int, width: int, make, one_pass: Pass, epochs: int, passes: int, seed: int, chain: int, merge=None) -> DataFrame:
    """The state after `epochs` passes over all pairs (center, context, weight); `places` has word, block and row."""
    spark = pairs.sparkSession
    a = places.select(F.col("word").alias("center"), F.col("block").alias("task"), F.col("row").alias("i"))
    b = places.select(F.col("word").alias("context"), F.col("block").alias("other"), F.col("row").alias("j"))
    cells = pairs.join(a, "center").join(b, "context").select("task", F.pmod(F.col("other") - F.col("task"), F.lit(blocks)).alias("step"), "i", "j", F.col("weight").alias("x"))
    cells.repartition(blocks, "task").write.partitionBy("step").parquet(f"{folder}/cells")
    cells = spark.read.parquet(f"{folder}/cells")
    state.write.parquet(f"{folder}/state-0")
    state, last, done, steps = spark.read.parquet(f"{folder}/state-0"), f"{folder}/state-0", 0, 0
    # dealt by number, so that adaptive execution does not put small blocks into one task
    own_lane = F.array(*[F.lit(x) for x in lanes(spark, blocks)])
    laid = lambda df: df.withColumn("lane", F.element_at(own_lane, F.col("task") + 1)).repartition(blocks, "lane").groupBy("lane")
    while done < epochs:
        now = min(passes, epochs - done)
        for shift in range(blocks):
            task = F.when(F.col("side") == 1, F.pmod(F.col("block") - shift, F.lit(blocks))).otherwise(F.col("block"))
            own = cells.filter(F.col("step") == shift).select("task", "i", "j", "x")
            train = _visit(width, make, one_pass, seed, done, shift, now)
            state = laid(own).cogroup(laid(state.withColumn("task", task))).applyInArrow(train, STATE)
            steps += 1
            if shift == blocks - 1 and merge is not None:
                state = merge(state)
            if steps % chain == 0 or (shift == blocks - 1 and done + now >= epochs):
                path = f"{folder}/state-{steps}"
                state.write.parquet(path)
                state = spark.read.parquet(path)
                where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(last)
                where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
                last = path
        done += now
    return state


def vectors_of(state: DataFrame, places: DataFrame, side: int, width: int) -> DataFrame:
    """(word, vector) of one side of a trained state."""

    def rows(key, held: pa.Table, words: pa.Table) -> pa.Table:
        words = words.sort_by("row")
        raw = held.column("value")[0].as_py() if held.num_rows else b""
        flat = pa.array(np.frombuffer(raw, np.float32))
        ends = pa.array(np.arange(words.num_rows + 1, dtype=np.int32) * width)
        return pa.Table.from_arrays([words.column("word").combine_chunks(), pa.ListArray.from_arrays(ends, flat)], names=["word", "vector"])

    own = state.filter(F.col("side") == side).select("block", "value")
    return own.groupBy("block").cogroup(places.select("block", "word", "row").groupBy("block")).applyInArrow(rows, "word string, vector array<float>")


def losses_of(state: DataFrame, epochs: int, divisor: float) -> DataFrame:
    """(epoch, loss)."""
    told = state.filter("side = 0").select(F.posexplode("losses").alias("at", "loss")).groupBy("at").agg(F.sum("loss").alias("loss"))
    return told.select((F.col("at") + 1).alias("epoch"), (F.col("loss") / divisor).alias("loss"))


def start(places: DataFrame, extra=None) -> DataFrame:
    """The state before the first step: a row a block and side, without vectors; `extra` maps a block's words to bytes by side."""

    def rows(key, words):
        words = words.sort_by("row")
        out = [(side, key[0].as_py(), 0, words.num_rows, extra(side, words) if extra else None) for side in (0, 1)]
        sides, block, part, n, held = zip(*out)
        none = [pa.nulls(2, k) for k in (pa.binary(), pa.binary(), pa.list_(pa.float64()))]
        return pa.Table.from_arrays([pa.array(sides, pa.int32()), pa.array(block, pa.int32()), pa.array(part, pa.int32()), pa.array(n, pa.int32()), pa.array(held, pa.binary()), *none], names=[c.split()[0] for c in STATE.split(", ")])

    return places.groupBy("block").applyInArrow(rows, STATE)
