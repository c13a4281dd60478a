"""Scores, bands and vectors as columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def weighted(weights: Mapping[str, float], bonus: Column | None = None) -> Column:
    """Weighted sum of columns, between 0 and 1; missing parts count as 0."""
    total = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    return clamp01(total if bonus is None else total + bonus)


def band(x: Column, cuts: Sequence[float], labels: Sequence) -> Column:
    """The label of the half-open interval: below the first cut the first one, from the last cut on the last one; null for null."""
    out = F.when(x < cuts[0], F.lit(labels[0]))
    for cut, label in zip(cuts[1:], labels[1:-1], strict=True):
        out = out.when(x < cut, F.lit(label))
    return F.when(x.isNotNull(), out.otherwise(F.lit(labels[-1])))


def mean_of(*dims: Column) -> Column:
    """Mean to two decimals, half up in exact arithmetic; null if one is missing."""
    total = sum((d.cast("decimal(10,4)") for d in dims[1:]), dims[0].cast("decimal(10,4)"))
    return F.round(total / len(dims), 2).cast("decimal(10,2)")


def ordinal_position(order: Column, count: Column) -> Column:
    return F.when(count <= 1, 0.0).otherwise(order / (count - 1))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, other lengths and zero norms."""
    size = norm(a) * norm(b)
    ok = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (size > 0)
    return F.when(ok, dot(a, b) / size).otherwise(0.0)


def rate(part: Column, whole: Column, empty: float | None) -> Column:
    """part / whole; what an empty whole gives is the caller's choice (1 for precision and recall, 0 for rates, None for null)."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty).cast("double"))
