"""Whitening of vectors by matrix-free block Lanczos.

The covariance V of the distinct vectors is never formed. A pass over the table sends a block of Q directions to the tasks,
which centre their rows x and sum (x - m)(x - m)'Q; the driver holds only arrays of the vectors' width. The blocks are
orthogonalised twice against all before them; a direction that vanishes (a breakdown) is replaced by a random one. The steps
end when the residuals of the wanted eigenpairs are below TOLERANCE of the largest eigenvalue, or when the directions span the
whole space, where they are exact. A last pass measures the whitened covariance. The trace comes from the exact deviations,
sum over dimensions of (n * x - S)^2.

Defined results: a vector that is null, empty, or has a null or non-finite entry takes no part, nor does one with an entry
whose 256-fold is beyond LARGEST, or whose width is not that of most vectors (the larger, if two tie). Equal vectors
count once in the fit, and each row gets its result; null ids are kept. Directions without variance (an eigenvalue of at most
width * 2^-52 of the trace) cannot be scaled: they are left out, so with fewer than two different vectors there are no rows. A
deviation that no long can hold is null. Extra columns are ignored. An empty table stays empty.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch

#: Entries are counted in units of 1/SCALE.
SCALE, LARGEST = 256, 1 << 52
BLOCK, SEED, TOLERANCE, COMPONENTS = 16, 7, 1e-14, 4
#: Columns of the result.
ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integral(df: DataFrame) -> DataFrame:
    """(vec_id, x): entries as whole numbers, floor(SCALE * entry), of the rows that take part, whatever their width."""
    c = F.col("embedding").cast("array<double>")
    whole = F.transform(c, lambda v: F.floor(v * F.lit(float(SCALE))).cast("long"))
    fits = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * F.lit(float(SCALE))) <= F.lit(float(LARGEST))))
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.size(c) > 0, F.when(F.coalesce(fits, F.lit(False)), whole)).alias("x")).filter("x is not null")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(df: DataFrame, of, width: int, kind: str = "<f8") -> np.ndarray:
    """The sum over all rows of `of`(rows as a matrix): an array of `width` numbers a task, added up by a tree of tasks."""

    def part(batches):
        total = np.zeros(width, kind)
        for batch in batches:
            if batch.num_rows:
                total += of(_matrix(batch.column("x"))).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["part"])

    def add(batches):
        total = np.zeros(width, kind)
        for x in sorted(x for batch in batches for x in batch.column("part").to_pylist()):  # the same order whenever a task is repeated
            total += np.frombuffer(x, kind)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["part"])

    tasks = df.rdd.getNumPartitions()
    parts = df.mapInArrow(part, "part binary")
    if tasks > 64:
        parts = parts.repartition(math.isqrt(tasks)).mapInArrow(add, "part binary")
    total = np.zeros(width, kind)
    for x in sorted(bytes(r.part) for r in parts.collect()):
        total += np.frombuffer(x, kind)
    return total


def differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly; Python's integers where no long holds them."""
    if n * int(np.abs(x).max(initial=1)) < 1 << 61 and max(map(abs, sums)) < 1 << 61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squares(d: np.ndarray) -> list[int]:
    """The exact sum of the squares of each row."""
    if d.dtype != object:
        most = int(np.abs(d).max(initial=0))
        if most * most * d.shape[1] < 1 << 63:
            return (d * d).sum(axis=1).tolist()
    return [sum(v * v for v in row) for row in d.tolist()]


@dataclass
class Whitening:
    """What a fit found: the number of distinct vectors, their sums, and unit eigenvectors by falling eigenvalue."""

    n: int
    sums: list[int]
    directions: np.ndarray  # a column each
    values: np.ndarray
    trace: float
    identity_error: float
    passes: int

    def project(self, x: np.ndarray) -> np.ndarray:
        return (differences(x, self.n, self.sums) / self.n).astype(float) @ self.directions / np.sqrt(self.values)


def _orthonormal(block: np.ndarray, basis: np.ndarray, scale: float, rng: np.random.Generator) -> np.ndarray:
    """Directions of `block` orthogonal to the basis and each other; those that vanish are replaced by random ones."""
    width, made = len(block), basis
    for column in block.T:
        if made.shape[1] == width:
            break
        least = 1e-10 * scale
        while True:
            for _ in range(2):
                column = column - made @ (made.T @ column)
            size = np.linalg.norm(column)
            if size > least:
                break
            column, least = rng.standard_normal(width), 1e-6  # breakdown: start again in a direction not seen yet
        made = np.column_stack([made, column / size])
    return made[:, basis.shape[1] :]


def lanczos(product, width: int, wanted: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, int]:
    """The `wanted` greatest eigenvalues and their unit vectors of the symmetric operator `product`, and its number of calls."""
    rng = np.random.default_rng(SEED)
    basis, images, scale, best = np.zeros((width, 0)), np.zeros((width, 0)), 0.0, []
    new = _orthonormal(rng.standard_normal((width, min(block, width))), basis, 1.0, rng)
    while True:
        image = product(new)
        basis, images = np.column_stack([basis, new]), np.column_stack([images, image])
        small = basis.T @ images
        values, inside = np.linalg.eigh((small + small.T) / 2)
        values, inside = values[::-1][:wanted], inside[:, ::-1][:, :wanted]
        found = basis @ inside
        scale = max(scale, float(np.abs(values).max(initial=0)))
        left = float(np.linalg.norm(images @ inside - found * values, axis=0).max(initial=0))
        best.append(left)
        stuck = len(best) > 4 and min(best[-4:]) > min(best[:-4]) / 2 and left <= 1e-10 * scale  # rounding, not convergence, limits it
        if basis.shape[1] == width or left <= TOLERANCE * scale and basis.shape[1] >= min(width, wanted) or stuck:
            return values, found / np.linalg.norm(found, axis=0), len(best)
        new = _orthonormal(image, basis, scale, rng)


def _rows(df: DataFrame, width: int) -> DataFrame:
    return integral(df).filter(F.size("x") == width)


def fit(df: DataFrame, wanted: int = COMPONENTS) -> Whitening | None:
    """Components of the distinct vectors of a table with vec_id and embedding; None if it has no vector."""
    scratch = Scratch(df.sparkSession, "whitening")
    whole = integral(df)
    widths = whole.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    if widths is None:
        return None
    width = widths.w
    rows = scratch.write(whole.select("x").filter(F.size("x") == width).distinct(), "distinct")
    n, low = rows.count(), (1 << 26) - 1
    halves = _summed(rows, lambda x: np.concatenate([(x >> 26).sum(axis=0), (x & low).sum(axis=0)]), 2 * width, "<i8").tolist()
    sums = [(a << 26) + b for a, b in zip(halves[:width], halves[width:])]
    trace = float(_summed(rows, lambda x: np.array([float(sum(squares(differences(x, n, sums))))]), 1)[0]) / n**3

    def product(directions: np.ndarray) -> np.ndarray:
        def of(x):
            z = (differences(x, n, sums) / n).astype(float)
            return z.T @ (z @ directions)

        return _summed(rows, of, directions.size).reshape(directions.shape) / n

    values, directions, passes = lanczos(product, width, min(wanted, width)) if trace else (np.zeros(0), np.zeros((width, 0)), 0)
    kept = values > width * 2.0**-52 * trace
    values, directions = values[kept], directions[:, kept]
    directions = directions * np.sign(directions[np.abs(directions).argmax(axis=0), range(len(values))])
    found = Whitening(n, sums, directions, values, trace, 0.0, passes)
    k = len(values)
    if k:

        def moments(x):
            w = found.project(x)
            return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

        made = _summed(rows, moments, k + k * k) / n
        found.identity_error = float(np.abs(made[k:].reshape(k, k) - np.outer(made[:k], made[:k]) - np.eye(k)).max())
    scratch.drop()
    return found


def whiten(df: DataFrame, found: Whitening | None) -> DataFrame:
    """A row for each vector of a table and each component."""
    if found is None or not len(found.values):
        return df.sparkSession.createDataFrame([], ROWS)
    k, shares = len(found.values), found.values / found.trace

    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            x = _matrix(batch.column("x"))
            deviations = [v if v < 1 << 63 else None for v in squares(differences(x, found.n, found.sums))]
            again = pa.array(np.repeat(np.arange(rows), k))
            columns = [
                batch.column("vec_id").take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, found.n)),
                pa.array(deviations, pa.int64()).take(again), pa.array(found.project(x).ravel()), pa.array(np.tile(shares, rows)), pa.array(np.full(rows * k, found.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ROWS.split(", ")])

    return _rows(df, len(found.sums)).mapInArrow(run, ROWS)
