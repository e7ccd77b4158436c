"""Co-occurrence weights, and vectors trained on them."""

from __future__ import annotations

import math
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import rotation
from quillspark.session import work_dir

#: Tokens whose pairs are summed together; hashes of either term, whose pairs are the buckets.
STEP, SIDE = 1_000_000, 16
#: Pairs of a bucket that are summed at once; pairs of one batch of results.
PAIRS, ROWS = 2_000_000, 100_000


def frequent(tokens: DataFrame, least: int = 3, column: str = "tokens") -> DataFrame:
    """(term, n) of terms found `least` times or more."""
    return tokens.select(F.explode(column).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _rare(docs: DataFrame, key: str, least: int, column: str) -> DataFrame:
    """(key, rare): for each document the terms in it that are found less than `least` times in all.

    A term found once or twice lies in the least and the greatest document that holds it, so its count brings its places
    along; only where `least` is greater than that do the documents' different terms meet the list of rare ones.
    """
    rows = docs.select(key, F.explode(column).alias("term"))
    few = rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("a"), F.max(key).alias("b")).filter(F.col("n") < least)
    if least <= 3:
        places = few.select("term", F.explode(F.array_distinct(F.array("a", "b"))).alias(key))
        # the least and the greatest key pass over documents without one
        places = places.union(rows.filter(F.col(key).isNull()).distinct().join(few.select("term"), "term").select("term", key))
    else:
        places = rows.distinct().join(few.select("term"), "term")
    return places.groupBy(key).agg(F.collect_list("term").alias("rare"))


def _scale(weights: list[float]) -> int | None:
    """The least number, up to a bound, that makes whole numbers of all weights; None if there is none."""
    scale = math.lcm(*(Fraction(w).limit_denominator(1000).denominator for w in weights))
    return scale if scale <= 1_000_000 and all(abs(w * scale - round(w * scale)) < 1e-9 for w in weights) else None


def _packed(lo_terms: pa.Array, hi_terms: pa.Array, counts: np.ndarray, steps: np.ndarray, sums: np.ndarray) -> bytes:
    """One bucket's pairs: its terms, pairs of each first term, steps between the numbers of their second terms, and sums."""
    small = lambda x: pa.array(x.astype(np.min_scalar_type(int(x.max())))) if x.dtype.kind != "f" else pa.array(x)
    columns = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (lo_terms, hi_terms, small(counts), small(steps), small(sums))]
    batch = pa.RecordBatch.from_arrays(columns, names=["lo", "hi", "counts", "steps", "sums"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _near_pairs(weights: list[float], scale: int | None):
    """Over (tokens, rare): (bucket, data), the pairs of kept tokens at most so far apart as there are weights, in alphabetical
    order, summed for STEP tokens at a time and packed by bucket."""
    window = len(weights)
    each = [round(w * scale) for w in weights] if scale else weights

    def pack(terms: pa.Array, key: np.ndarray, sums: np.ndarray):
        side = np.array([zlib.crc32(x.as_buffer()) % SIDE for x in terms.cast(pa.binary())])
        lo = (key // len(terms)).astype(np.int32)
        hi = (key % len(terms)).astype(np.int32)
        bucket = (side[lo] * SIDE + side[hi]).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        bucket, lo = bucket[order], lo[order]
        hi = hi[order]
        sums = sums[order]
        del order
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        found = []
        for s, e in zip(cuts, np.r_[cuts[1:], len(bucket)]):
            starts = np.flatnonzero(np.r_[True, lo[s + 1 : e] != lo[s : e - 1]])
            different, at = np.unique(hi[s:e], return_inverse=True)
            steps = np.diff(at, prepend=0)
            steps[starts] = at[starts]
            found.append(_packed(terms.take(pa.array(lo[s:e][starts])), terms.take(pa.array(different)), np.diff(np.r_[starts, e - s]), steps, sums[s:e]))
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int32)), pa.array(found, pa.binary())], names=["bucket", "data"])

    def run(batches):
        for tokens, rare in _joined(batches):
            size = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = tokens.flatten()
            if not len(flat):
                continue
            coded = flat.dictionary_encode()
            terms = coded.dictionary
            rank = np.empty(len(terms), np.int64)
            order = pc.sort_indices(terms)
            rank[order.to_numpy()] = np.arange(len(terms))
            code, row = rank[coded.indices.to_numpy(zero_copy_only=False)], np.repeat(np.arange(len(size)), size)
            terms = terms.take(order)
            gone = pc.index_in(rare.flatten(), terms).to_numpy(zero_copy_only=False)
            if len(gone):
                of = np.repeat(np.arange(len(size)), pc.fill_null(pc.list_value_length(rare), 0).to_numpy(zero_copy_only=False))
                kept = ~np.isin(row * len(terms) + code, of * len(terms) + gone)
                code, row = code[kept], row[kept]
            for s in range(0, len(code), STEP):
                keys = []
                for d in range(1, window + 1):
                    e = max(s, min(s + STEP, len(code) - d))  # none where so few tokens are left
                    same = row[s:e] == row[s + d : e + d]
                    a, b = code[s:e][same], code[s + d : e + d][same]
                    keys.append((np.minimum(a, b) * len(terms) + np.maximum(a, b)) * window + d - 1)
                found = np.concatenate(keys)
                del keys
                if len(found):
                    found.sort()  # by pair and distance, in place
                    value = np.array(each, np.int64 if scale else float)[found % window]
                    found //= window
                    first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
                    key, summed = found[first], np.add.reduceat(value, first)
                    del found, value, first
                    yield pack(terms, key, summed)

    return run


def _apart(batches):
    """tokens and rare, of texts that are tokens without anything between them and those tokens' sizes in bytes."""
    ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    for b in batches:
        sizes, data = b.column("sizes"), "".join(x for x in b.column("text").to_pylist() if x).encode()
        n = pc.fill_null(pc.list_value_length(sizes), 0).to_numpy(zero_copy_only=False)
        lengths = sizes.flatten().to_numpy()
        flat = pa.StringArray.from_buffers(len(lengths), ends(lengths).buffers()[1], pa.py_buffer(data))
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends(n), flat), b.column("rare")], names=["tokens", "rare"])


def _joined(batches):
    """Columns tokens and rare of batches, of about STEP tokens together."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += pc.sum(pc.list_value_length(batch.column("tokens"))).as_py() or 0
        if n >= STEP:
            yield [pa.concat_arrays([b.column(c) for b in held]) for c in ("tokens", "rare")]
            held, n = [], 0
    if held:
        yield [pa.concat_arrays([b.column(c) for b in held]) for c in ("tokens", "rare")]


def _parts(data: list[pa.Scalar]):
    """Of each packed table: its first and second terms, each pair's places among these, and sums."""
    for x in data:
        part = pa.ipc.open_stream(x.as_buffer()).read_all().combine_chunks()
        a, b, counts, steps, own = (part.column(c).combine_chunks().flatten() for c in ("lo", "hi", "counts", "steps", "sums"))
        counts, steps = counts.to_numpy().astype(np.int64), steps.to_numpy().astype(np.int64)
        starts, run_up = np.cumsum(counts) - counts, np.cumsum(steps)
        yield a, b, np.repeat(np.arange(len(a)), counts), run_up - np.repeat(run_up[starts] - steps[starts], counts), own.to_numpy()


def _whole(scale: int | None):
    """Over a bucket's packed tables: batches of (center, context, weight), both directions of their pairs. A bucket of more than
    PAIRS pairs is summed in parts by its first terms, so a task holds its packed data and one part."""

    def summed(data: list[pa.Scalar], part: int, parts: int):
        lo_terms, hi_terms, los, his, sums = [], [], [], [], []
        n_lo = n_hi = 0
        for a, b, lo, hi, own in _parts(data):
            if parts > 1:
                kept = (np.array([zlib.crc32(x.as_buffer(), 1) % parts for x in a.cast(pa.binary())]) == part)[lo]
                lo, hi, own = lo[kept], hi[kept], own[kept]
            los.append(lo + n_lo)
            his.append(hi + n_hi)
            sums.append(own)
            lo_terms.append(a)
            hi_terms.append(b)
            n_lo, n_hi = n_lo + len(a), n_hi + len(b)
        coded = pa.concat_arrays(lo_terms + hi_terms).dictionary_encode()
        terms, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        pairs, of = np.unique(code[np.concatenate(los)] * len(terms) + code[n_lo:][np.concatenate(his)], return_inverse=True)
        weight = np.bincount(of, np.concatenate(sums), len(pairs)) / (scale or 1)
        for s in range(0, len(pairs), ROWS):
            lo, hi, w = pairs[s : s + ROWS] // len(terms), pairs[s : s + ROWS] % len(terms), weight[s : s + ROWS]
            other = lo != hi
            w = np.where(other, w, 2 * w)
            take = lambda x, y: terms.take(pa.array(np.concatenate([x, y[other]])))
            yield pa.RecordBatch.from_arrays([take(lo, hi), take(hi, lo), pa.array(np.concatenate([w, w[other]]))], names=["center", "context", "weight"])

    def whole(data: list[pa.Scalar]):
        n = sum(len(x[4]) for x in _parts(data))
        parts = -(-n // PAIRS)
        for part in range(parts):
            yield from summed(data, part, parts)

    return whole


def _unpacked(scale: int | None):
    """Over a bucket's (bucket, data): (center, context, weight)."""
    whole = _whole(scale)
    return lambda key, rows: pa.Table.from_batches(list(whole(list(rows.column("data")))))


def _streamed(scale: int | None):
    """Over (bucket, data), one bucket after the other: (center, context, weight)."""
    whole = _whole(scale)

    def run(batches):
        at, held = None, []
        for batch in batches:
            for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data")):
                if held and bucket != at:
                    yield from whole(held)
                    held = []
                at = bucket
                held.append(pa.scalar(data.as_py(), pa.binary()))  # its own bytes, not the batch's
        if held:
            yield from whole(held)

    return run


def cooccurrence(docs: DataFrame, key: str = "doc_id", window: int = 5, least: int = 3, column: str = "tokens", weights: list[float] | None = None) -> DataFrame:
    """(center, context, weight): sums over pairs of tokens in a document, counted after rare terms are gone; `weights` by
    distance, 1 / distance if not given.

    The places of rare terms are few, and only they meet the documents. Pairs are made and summed inside STEP tokens, once for
    both directions, and shuffled as packed bytes in SIDE * SIDE buckets by both terms' hashes, so that a frequent term's pairs
    lie in many buckets. Weights are summed as whole numbers if a scale makes them such, so their order does not matter.
    """
    # documents move to their rare terms as text and sizes, which take less room than tokens
    rows = docs.select(F.col(key), F.array_join(column, "").alias("text"), F.transform(column, F.octet_length).alias("sizes"))
    rare = _rare(docs, key, least, column).withColumnRenamed(key, "_key")
    weights = weights or [1.0 / d for d in range(1, window + 1)]
    scale = _scale(weights)
    near = _near_pairs(weights, scale)
    both = rows.join(rare, F.col(key).eqNullSafe(F.col("_key")), "left").select("text", "sizes", "rare")
    found = both.mapInArrow(lambda batches: near(_apart(batches)), "bucket int, data binary")
    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_streamed(scale), "center string, context string, weight double")


def glove_pass(rate: float, x_max: float, power: float, batch: int = 4096, run: int = 8):
    """One pass of weighted least squares: 0.5 * min(1, (x / x_max)^power) * (u.v + biases - log x)^2, summed; the last column is the bias."""

    def train(i, j, x, main, other, _, rng):
        goal, weight, total = np.log(x), np.minimum(1.0, (x / x_max) ** power).astype(np.float32), 0.0
        for part in rotation.batches(i, run, batch, rng):
            a, b = i[part], j[part]
            u, v = main.value.take(a, axis=0), other.value.take(b, axis=0)
            gap = np.einsum("pd,pd->p", u[:, :-1], v[:, :-1]) + u[:, -1] + v[:, -1] - goal[part]
            pull = weight[part] * gap
            total += 0.5 * float(pull @ gap)
            u[:, -1] = v[:, -1] = 1.0  # now what a bias is multiplied by
            rows, grads = rotation.run_sums(a, pull, v, run)
            u *= pull[:, None]
            rotation.descend(main.value, main.seen, rows, grads, rate)
            rotation.descend(other.value, other.seen, b, u, rate)
        return total

    return train


def train_glove(
    pairs: DataFrame, size: int = 100, epochs: int = 35, rate: float = 0.05, x_max: float = 100.0, power: float = 0.75, seed: int = 42, terms: int = 20_000, least_blocks: int = 8, passes: int = 7, chain: int = 8
) -> tuple[DataFrame, DataFrame]:
    """(word, vector) and (epoch, loss): sums of word and context vectors by weighted least squares with AdaGrad, trained by rotating blocks.

    Vectors start normal with deviation 0.5 / size and biases at 0. An epoch's loss is the mean over all pairs, taken as they are trained.
    """
    spark, folder = pairs.sparkSession, work_dir(pairs.sparkSession, "glove")
    pairs.select("center", "context", "weight").write.parquet(folder + "/raw")
    raw = spark.read.parquet(folder + "/raw")  # the pairs are made once
    if raw.isEmpty():
        raise ValueError("there are no co-occurrences")
    words = raw.select(F.explode(F.array("center", "context")).alias("word")).distinct()
    blocks = rotation.blocks_for(words.count(), terms, least_blocks)
    rotation.deal(words, blocks).write.parquet(folder + "/words")
    places = spark.read.parquet(folder + "/words")

    def make(side, block, part, rng, n):
        vectors = rng.normal(0, 0.5 / size, (n, size + 1)).astype(np.float32)
        vectors[:, -1] = 0
        return vectors

    state = rotation.rotate(places, raw, rotation.start(places), folder, blocks, size + 1, make, glove_pass(rate, x_max, power), epochs, passes, seed, chain)
    a, b = (rotation.vectors_of(state, places, side, size + 1) for side in (0, 1))
    both = a.join(b.withColumnRenamed("vector", "other"), "word")
    vectors = both.select("word", F.slice(F.zip_with("vector", "other", lambda x, y: x + y), 1, size).alias("vector"))
    return vectors, rotation.losses_of(state, epochs, raw.count())
