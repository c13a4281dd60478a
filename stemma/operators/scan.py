"""Running values of ordered groups of any size: an associative scan over parts of one global order.

A window over a group puts all its rows in one task. Here rows are dealt by ranges of (group, order), so a group spans as many tasks as its
rows need; each part is folded by itself, and what the parts before it add up to comes in afterwards. That works for every fold that is associative: last
value, any, count, sum, least, greatest. State machines whose transitions compose to such folds are run this way too (see replay.py).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import kept

#: Folds: the running value in a window, the same of a whole part, and how two neighbouring parts' values join (all null-safe).
_FOLDS = {
    "last": (lambda c, w: F.last(c, ignorenulls=True).over(w), lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("__pos")))),
    "any": (lambda c, w: F.max(c).over(w), F.max),
    "max": (lambda c, w: F.max(c).over(w), F.max),
    "min": (lambda c, w: F.min(c).over(w), F.min),
    "sum": (lambda c, w: F.sum(c).over(w), F.sum),
    "count": (lambda c, w: F.count(c).over(w), F.count),
}
_JOIN = {"last": lambda a, b: F.coalesce(b, a), "any": lambda a, b: F.greatest(a, b), "max": lambda a, b: F.greatest(a, b), "min": lambda a, b: F.least(a, b), "sum": lambda a, b: F.coalesce(a + b, a, b), "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}


def in_order(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str], parts: int | None = None) -> DataFrame:
    """Rows with __pos, their place in the order of (group, order), and __part, the range of it that they lie in; stored, so places stay what they are.

    Ranges are cut by a sample that Spark takes of the keys. Rows equal in all keys may lie in several ranges, in any order.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.monotonically_increasing_id().alias("__tie")
    keys = [F.col(c) if isinstance(c, str) else c for c in (*group, *order)]
    dealt = rows.select("*", tie).repartitionByRange(n, *keys, "__tie").sortWithinPartitions(*keys, "__tie").drop("__tie")
    return kept(dealt.select("*", F.monotonically_increasing_id().alias("__pos"), F.spark_partition_id().alias("__part")), "ordered")


def _before(totals: DataFrame, group: Sequence[str], folds: Mapping[str, str]) -> DataFrame:
    """Of totals per (__part, group): for groups that span parts, what the parts before each add up to. At most two rows a part, however many groups there are."""
    mine = W.partitionBy(*group)
    earlier = mine.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    join = {"count": lambda c: F.sum(c).over(earlier)}
    several = totals.withColumn("__scan_rows", F.count("*").over(mine)).where("__scan_rows > 1").drop("__scan_rows")
    return several.select("__part", *group, *[join.get(kind, lambda c, k=kind: _FOLDS[k][0](c, earlier))(F.col(name)).alias(f"__before_{name}") for name, kind in folds.items()])




def running(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str], folds: Mapping[str, tuple[str, Column]], *, strict: bool = False, parts: int | None = None) -> DataFrame:
    """Rows with a running value for each of folds (name: kind and column): over the rows of their group up to them, or before them if strict.

    Kinds: last (non-null), any, max, min, sum, count (non-null). A null group is a group. Rows that tie in the order are taken in any
    order. Two exchanges of the rows, by range and by (part, group); the values of earlier parts are broadcast, two rows a part at most.
    """
    named = rows.select("*", *[c.alias(f"__v_{name}") for name, (_, c) in folds.items()])
    placed = in_order(named, group, order, parts)
    kinds = {name: kind for name, (kind, _) in folds.items()}
    totals = placed.groupBy("__part", *group).agg(*[_FOLDS[kind][1](F.col(f"__v_{name}")).alias(name) for name, kind in kinds.items()])
    before = _before(totals, group, kinds).select(F.col("__part").alias("__p"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], *[f"__before_{name}" for name in kinds])
    inside = W.partitionBy("__part", *group).orderBy("__pos").rowsBetween(W.unboundedPreceding, -1 if strict else W.currentRow)
    own = placed.select("*", *[_FOLDS[kind][0](F.col(f"__v_{name}"), inside).alias(f"__own_{name}") for name, kind in kinds.items()])
    met = F.col("__part") == F.col("__p")
    for i, g in enumerate(group):
        met &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    both = own.join(F.broadcast(before), met, "left")
    return both.select(*rows.columns, *[_JOIN[kind](F.col(f"__before_{name}"), F.col(f"__own_{name}")).alias(name) for name, kind in kinds.items()])


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str], number: str = "number", size: str | None = None, parts: int | None = None) -> DataFrame:
    """Rows numbered from 1 in their group's order and, if `size` is named, with the size of the group; no group is in one task."""
    out = running(rows, group, order, {number: ("count", F.lit(1))}, parts=parts)
    if size is None:
        return out
    sizes = rows.groupBy(*group).agg(F.count("*").alias(size)).select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], size)
    met = F.lit(True)
    for i, g in enumerate(group):
        met &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return out.join(sizes, met).select(*rows.columns, number, size)


def quantiles(rows: DataFrame, group: Sequence[str], column: str, shares: Sequence[float], parts: int | None = None) -> DataFrame:
    """Exact interpolated quantiles of each group (array `q`, and n): the values at the two places around share * (n - 1), met as rows of a global order.

    Nulls are left out. No task holds a group or its distinct values; a group sends one row per task and share.
    """
    placed = ranked(rows.where(F.col(column).isNotNull()).select(*group, column), group, [column], "__i", "__n", parts)
    at = lambda p: (F.col("__n") - 1) * F.lit(float(p))
    value = F.col(column).cast("double")
    low = [F.max(F.when(F.col("__i") - 1 == F.floor(at(p)), value)).alias(f"l{k}") for k, p in enumerate(shares)]
    high = [F.max(F.when(F.col("__i") - 1 == F.ceil(at(p)), value)).alias(f"h{k}") for k, p in enumerate(shares)]
    found = placed.groupBy(*group).agg(F.first("__n").alias("n"), *low, *high)
    # as percentile() does: both neighbours by their shares
    between = [F.when(F.floor((F.col("n") - 1) * p) == F.ceil((F.col("n") - 1) * p), F.col(f"l{k}")).otherwise((F.ceil((F.col("n") - 1) * p) - (F.col("n") - 1) * p) * F.col(f"l{k}") + ((F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p)) * F.col(f"h{k}")) for k, p in enumerate(map(float, shares))]
    return found.select(*group, "n", F.array(*between).alias("q"))
