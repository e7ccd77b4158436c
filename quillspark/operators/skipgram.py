"""Skip-gram with negative samples, of whole words and of words with their n-grams, trained by rotating blocks.

A pair at distance d within the window counts (window + 1 - d) / window, the chance that a window of random width holds it;
frequent terms count less, by the usual subsampling. Each pair then asks for `negatives` contexts drawn from the counts to
the power 0.75. A task draws those of its block of contexts, as many as the block's share of that mass, through an alias
table; the words they are held against are drawn by their pairs. A batch's draws meet each other as two matrices.

With n-grams, a word's vector is the mean of its own and those of its n-grams' buckets. A bucket belongs to words of several
blocks: each block trains its own copy, and after each turn of all blocks the copies are joined, weighted by what the blocks'
words with the bucket count. Words outside the vocabulary are means over their n-grams' buckets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.vectors import element_sums, gathered
from quillspark.operators import rotation
from quillspark.operators.cooccurrence import cooccurrence, frequent
from quillspark.operators.rotation import PART, Side, add_up, descend
from quillspark.session import work_dir


def ngrams(word: Column, low: int = 3, high: int = 6) -> Column:
    """Character n-grams of a word in angle brackets."""
    w = F.concat(F.lit("<"), word, F.lit(">"))
    one = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(n)))
    return F.array_distinct(F.filter(F.concat(*[one(n) for n in range(low, high + 1)]), lambda g: F.length(g) >= low))


def buckets(word: Column, n: int = 50_000) -> Column:
    return F.transform(ngrams(word), lambda g: F.pmod(F.xxhash64(g), F.lit(n)))


class Alias:
    """Draws places in proportion to their masses, each draw in constant time."""

    def __init__(self, masses: np.ndarray):
        n = len(masses)
        scaled = (np.asarray(masses, float) * n / np.sum(masses, dtype=float)).tolist()
        self.keep, self.other = np.ones(n), np.arange(n)
        small, large = [k for k, v in enumerate(scaled) if v < 1], [k for k, v in enumerate(scaled) if v >= 1]
        while small and large:
            s, b = small.pop(), large[-1]
            self.keep[s], self.other[s] = scaled[s], b
            scaled[b] -= 1 - scaled[s]
            if scaled[b] < 1:
                small.append(large.pop())

    def draw(self, k: int, rng: np.random.Generator) -> np.ndarray:
        at = rng.integers(0, len(self.keep), k)
        return np.where(rng.random(k) < self.keep[at], at, self.other[at])


def gradients(u: np.ndarray, v: np.ndarray, x: np.ndarray, asked: np.ndarray, noise: np.ndarray, each: float):
    """The loss and its gradients: rows u with v, weighted by x, are pairs; each of `asked` with each of `noise` is none, weighted by `each`.

    loss = sum x log(1 + exp(-u.v)) + each * sum log(1 + exp(asked.noise)).
    """
    loss, pull, push = _slopes(u, v, x, asked, noise, each)
    return loss, pull[:, None] * v, pull[:, None] * u, push @ noise, push.T @ asked


def _slopes(u: np.ndarray, v: np.ndarray, x: np.ndarray, asked: np.ndarray, noise: np.ndarray, each: float):
    """The loss and its slopes by the products of pairs and by those of asked words with draws."""
    near, far = np.einsum("pd,pd->p", u, v), asked @ noise.T
    a, b = np.exp(-np.abs(near)), np.exp(-np.abs(far))
    loss = float(x @ (np.log1p(a) - np.minimum(near, 0))) + each * float((np.log1p(b) + np.maximum(far, 0)).sum())
    return loss, -x * np.where(near > 0, a, 1) / (1 + a), each * np.where(far > 0, 1, b) / (1 + b)


def _extra(key_mass: str, grams: bool):
    """What a block's rows need: the words' masses (and n-grams), or the contexts' masses for draws."""

    def rows(side: int, words: pa.Table) -> bytes:
        mass = words.column(key_mass if side == 0 else "noise").to_numpy().astype(np.float32)
        if side == 1 or not grams:
            return mass.tobytes()
        lists = words.column("grams").combine_chunks()
        return mass.tobytes() + np.diff(lists.offsets.to_numpy()).astype(np.int32).tobytes() + lists.flatten().to_numpy().astype(np.int32).tobytes()

    return rows


class _Words:
    """The words of a block: their masses, and their n-grams' places if they have any."""

    def __init__(self, side: Side, grams: Side | None):
        n = len(side.value)
        self.mass = np.frombuffer(side.extra, np.float32, n)
        self.side, self.grams = side, grams
        if grams is not None:
            self.count = np.frombuffer(side.extra, np.int32, n, 4 * n)
            self.flat = np.frombuffer(side.extra, np.int32, -1, 8 * n)
            self.first = np.cumsum(self.count) - self.count
        if side.draws is None and self.mass.sum() > 0:
            side.draws = Alias(self.mass)
        self.alias = side.draws

    def places(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of different rows one after another, and where each row's begin."""
        k = self.count[rows]
        ends = np.cumsum(k)
        return self.flat[np.arange(int(ends[-1])) + np.repeat(self.first[rows] - (ends - k), k)], ends - k

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        if self.grams is None:
            return self.side.value[rows]
        flat, starts = self.places(rows)
        return (self.side.value[rows] + np.add.reduceat(self.grams.value[flat], starts, axis=0)) / (1 + self.count[rows])[:, None].astype(np.float32)

    def move(self, rows: np.ndarray, grads: np.ndarray, rate: float) -> None:
        if self.grams is None:
            return descend(self.side.value, self.side.seen, rows, grads, rate)
        rows, grads = add_up(rows, grads)
        grads = grads / (1 + self.count[rows])[:, None].astype(np.float32)
        descend(self.side.value, self.side.seen, rows, grads, rate)
        flat, _ = self.places(rows)
        descend(self.grams.value, self.grams.seen, flat, np.repeat(grads, self.count[rows], axis=0), rate)


def skip_pass(negatives: int, noise_total: float, rate: float, batch: int = 4096, run: int = 8, asked: int = 256):
    """One pass over a visit's pairs; `noise_total` is the mass of all contexts' draws."""

    def train(i, j, x, main, other, grams, rng):
        words, total = _Words(main, grams), 0.0
        noise = np.frombuffer(other.extra, np.float32)
        draws = other.draws = other.draws or Alias(noise)
        mass = negatives * float(words.mass.sum(dtype=float)) * float(noise.sum(dtype=float)) / noise_total
        for part in rotation.batches(i, run, batch, rng):
            few = max(1, min(asked, len(part)))
            many = max(1, round(negatives * len(part) / few))
            rows = np.concatenate([i[part], words.alias.draw(few, rng)])
            rare = draws.draw(many, rng)
            n, held = len(part), np.concatenate([j[part], rare])
            if grams is None:
                u = main.value.take(rows, axis=0)
            else:
                different, of = np.unique(rows, return_inverse=True)
                u = words.vectors(different)[of]
            v = other.value.take(held, axis=0)
            loss, pull, push = _slopes(u[:n], v[:n], x[part], u[n:], v[n:], mass * n / len(i) / few / many)
            own, grads = rotation.run_sums(rows[:n], pull, v[:n], run)
            moved = np.empty_like(v)
            np.multiply(u[:n], pull[:, None], out=moved[:n])
            np.matmul(push.T, u[n:], out=moved[n:])
            words.move(np.concatenate([own, rows[n:]]), np.concatenate([grads, push @ v[n:]]), rate)
            descend(other.value, other.seen, held, moved, rate)
            total += loss
        return total

    return train


def _gram_rows(places: DataFrame, n_buckets: int) -> DataFrame:
    """The state of each block's copy of the buckets, in parts; extra: what the block's words with each bucket count."""
    spread = places.select("block", "mass", F.explode("grams").alias("g")).groupBy("block", "g").agg(F.sum("mass").alias("mass"))
    blocks = places.select("block").distinct()
    every = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit((n_buckets - 1) // PART))).alias("part"))
    held = spread.groupBy("block", F.floor(F.col("g") / PART).cast("int").alias("part")).agg(F.collect_list(F.struct("g", "mass")).alias("own"))  # PART at most

    def rows(frames):
        for f in frames:
            out = []
            for block, part, own in zip(f.column("block").to_pylist(), f.column("part").to_pylist(), f.column("own").to_pylist()):
                mass = np.zeros(min(PART, n_buckets - part * PART), np.float32)
                for x in own or []:
                    mass[x["g"] - part * PART] = x["mass"]
                out.append((2, block, part, len(mass), mass.tobytes(), None, None, None))
            kinds = [pa.int32()] * 4 + [pa.binary()] * 3 + [pa.list_(pa.float64())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[c.split()[0] for c in rotation.STATE.split(", ")])

    return every.join(held, ["block", "part"], "left").mapInArrow(rows, rotation.STATE)


def _joined(width: int):
    """The copies of one part of the buckets, as one: means by what the blocks' words count; buckets of no word stay."""

    def merge(key, copies):
        if key[0].as_py() < 0:  # not buckets, but a block's words or contexts
            return copies
        rows = copies.sort_by("block").to_pylist()
        mass = np.stack([np.frombuffer(r["extra"], np.float32) for r in rows])
        total = mass.sum(axis=0)
        share = np.where(total > 0, mass / np.where(total > 0, total, 1), 1 / len(rows)).astype(np.float32)
        columns = {}
        for c in ("value", "seen"):
            made = sum(s[:, None] * np.frombuffer(r[c], np.float32).reshape(-1, width) for s, r in zip(share, rows))
            columns[c] = pa.array([made.astype(np.float32).tobytes()] * len(rows), pa.binary())
        sorted_ = copies.sort_by("block")
        for c, made in columns.items():
            sorted_ = sorted_.set_column(sorted_.schema.get_field_index(c), c, made)
        return sorted_

    def join(state: DataFrame) -> DataFrame:
        apart = F.when(F.col("side") == 2, F.col("part")).otherwise(-1 - F.col("block") * 2 - F.col("side"))
        return state.withColumn("of", apart).groupBy("of").applyInArrow(lambda key, t: merge(key, t.drop_columns(["of"])), rotation.STATE)

    return join


def train(
    docs: DataFrame, key: str = "doc_id", size: int = 100, window: int = 5, least: int = 3, negatives: int = 10, epochs: int = 80, rate: float = 0.05, seed: int = 42, column: str = "tokens",
    n_buckets: int = 0, sample: float = 1e-3, shortest: int = 5, terms: int = 20_000, least_blocks: int = 8, passes: int = 20, chain: int = 8,
) -> dict[str, DataFrame]:
    """words (word, vector), losses (epoch, loss by pair) and, with `n_buckets`, buckets (bucket, vector): skip-gram vectors of tokens.

    Documents of fewer than `shortest` tokens and terms found fewer than `least` times take no part. No pairs are an error.
    """
    spark, folder = docs.sparkSession, work_dir(docs.sparkSession, "skipgram")
    own = docs.filter(F.size(column) >= shortest)
    counts = frequent(own, least, column)
    counts.write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    n_tokens = counts.agg(F.sum("n")).first()[0] or 0
    share = F.col("n") / F.lit(float(max(1, n_tokens)))
    kept = counts.select("term", F.least(F.lit(1.0), F.sqrt(F.lit(sample) / share) + F.lit(sample) / share).alias("keep")) if sample else counts.select("term", F.lit(1.0).alias("keep"))
    found = cooccurrence(own, key, window, least, column, [(window + 1 - d) / window for d in range(1, window + 1)])
    thin = found.join(kept.select(F.col("term").alias("center"), F.col("keep").alias("a")), "center").join(kept.select(F.col("term").alias("context"), F.col("keep").alias("b")), "context")
    thin.select("center", "context", (F.col("weight") * F.col("a") * F.col("b")).alias("weight")).write.parquet(f"{folder}/pairs")
    pairs = spark.read.parquet(f"{folder}/pairs")
    n_pairs = pairs.count()
    if not n_pairs:
        raise ValueError("there are no co-occurrences")
    masses = pairs.groupBy(F.col("center").alias("word")).agg(F.sum("weight").alias("mass"))
    words = counts.select(F.col("term").alias("word"), F.pow("n", F.lit(0.75)).alias("noise")).join(masses, "word", "left").fillna(0.0, ["mass"])
    if n_buckets:
        words = words.withColumn("grams", F.array_distinct(buckets(F.col("word"), n_buckets)).cast("array<int>"))
    blocks = rotation.blocks_for(counts.count(), terms, least_blocks)
    rotation.deal(words, blocks).write.parquet(f"{folder}/words")
    places = spark.read.parquet(f"{folder}/words")
    noise_total = places.agg(F.sum("noise")).first()[0]

    def make(side, block, part, rng, n):
        if side == 1:
            return np.zeros((n, size), np.float32)
        return rng.uniform(-0.5 / size, 0.5 / size, (n, size)).astype(np.float32)

    state = rotation.start(places, _extra("mass", bool(n_buckets)))
    if n_buckets:
        state = state.unionByName(_gram_rows(places, n_buckets))
    one_pass = skip_pass(negatives, noise_total, rate, run=32, asked=64) if n_buckets else skip_pass(negatives, noise_total, rate)
    state = rotation.rotate(places, pairs, state, folder, blocks, size, make, one_pass, epochs, passes, seed, chain, _joined(size) if n_buckets else None)
    out = {"words": rotation.vectors_of(state, places, 0, size), "losses": rotation.losses_of(state, epochs, n_pairs)}
    if n_buckets:
        out["buckets"] = bucket_vectors(state, size)
        out["words"] = whole_words(out["words"], out["buckets"], size, n_buckets)
    return out


def bucket_vectors(state: DataFrame, size: int) -> DataFrame:
    """(bucket, vector) of a trained state: those of n-grams that a word has."""

    def rows(batches):
        for b in batches:
            for part, mass, value in zip(b.column("part").to_pylist(), b.column("mass").to_pylist(), b.column("value").to_pylist()):
                held = np.flatnonzero(np.frombuffer(mass, np.float64) > 0)
                v = np.frombuffer(value, np.float32).reshape(-1, size)[held]
                ends = pa.array(np.arange(len(held) + 1, dtype=np.int32) * size)
                yield pa.RecordBatch.from_arrays([pa.array(held + part * PART), pa.ListArray.from_arrays(ends, pa.array(v.ravel()))], names=["bucket", "vector"])

    def once(key, copies):
        copies = copies.sort_by("block")
        mass = sum(np.frombuffer(m, np.float32).astype(float) for m in copies.column("extra").to_pylist())
        return pa.table({"part": [key[0].as_py()], "mass": pa.array([mass.tobytes()], pa.binary()), "value": pa.array([copies.column("value")[0].as_py()], pa.binary())}).cast(pa.schema([("part", pa.int32()), ("mass", pa.binary()), ("value", pa.binary())]))

    one = state.filter("side = 2").select("part", "block", "extra", "value").groupBy("part").applyInArrow(once, "part int, mass binary, value binary")
    return one.mapInArrow(rows, "bucket long, vector array<float>")


def _gram_sums(words: DataFrame, table: DataFrame, size: int, n_buckets: int) -> DataFrame:
    rows = words.select("word", F.explode(F.array_distinct(buckets(F.col("word"), n_buckets))).alias("bucket")).join(table, "bucket", "left")
    return rows.groupBy("word").agg(F.count("vector").alias("n"), *element_sums(F.col("vector"), size))


def whole_words(words: DataFrame, table: DataFrame, size: int, n_buckets: int) -> DataFrame:
    """(word, vector) of trained words: the mean of their own vector and those of their n-grams."""
    sums = _gram_sums(words, table, size, n_buckets).select("word", "n", gathered(size).alias("s"))
    both = words.join(sums, "word")
    return both.select("word", F.zip_with("vector", "s", lambda a, b: ((a + b) / (F.col("n") + 1)).cast("float")).alias("vector"))


def outside_words(words: DataFrame, table: DataFrame, size: int, n_buckets: int) -> DataFrame:
    """(word, vector) of any words, as means over their n-grams' buckets; null without any known bucket."""
    return _gram_sums(words, table, size, n_buckets).select("word", F.when(F.col("n") > 0, gathered(size, F.col("n"))).alias("vector"))
