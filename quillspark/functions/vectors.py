"""Vector functions on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def scaled(v: Column, k: Column) -> Column:
    return F.transform(doubles(v), lambda x: x * k)


def added(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def element_sums(v: Column, size: int) -> list[Column]:
    """Aggregates: the sum of each element, so that vectors are summed by partial aggregation."""
    return [F.sum(F.element_at(doubles(v), i + 1)).alias(f"_s{i}") for i in range(size)]


def gathered(size: int, divide: Column | None = None) -> Column:
    """The array of the sums that element_sums made."""
    return F.array(*[F.col(f"_s{i}") if divide is None else F.col(f"_s{i}") / divide for i in range(size)])


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    shifted = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda s, y: s + y))
