"""Vector functions over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Clipped to [-1, 1]; 0 if either vector is zero."""
    length = norm(a) * norm(b)
    return F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / length)))


def unit(a: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    length = norm(a)
    return F.when(length == 0, a).otherwise(F.transform(a, lambda x: x / length))


def weighted(vectors: list[Column], weights: list[float]) -> Column:
    """The unit vector of the weighted sum, weights scaled to sum to 1 over the vectors there are."""
    total = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in zip(vectors, weights, strict=True)), F.lit(0.0))

    def scaled(vector: Column, weight: float) -> Column:
        return F.transform(vector, lambda x: x * weight / total)

    parts = [scaled(v, w) for v, w in zip(vectors, weights, strict=True)]
    out = parts[0]
    for part in parts[1:]:
        out = F.coalesce(F.zip_with(out, part, lambda x, y: x + y), out, part)
    return unit(out)


def variance(a: Column) -> Column:
    """Population variance of the components."""
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(a)


def usable(a: Column) -> Column:
    """Not null, not empty, finite, not all near zero."""
    finite = F.forall(a, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(a.isNotNull() & (F.size(a) > 0) & finite & F.exists(a, lambda x: F.abs(x) > 1e-8), F.lit(False))
