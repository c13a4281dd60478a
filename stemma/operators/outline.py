"""Headings of running text as a hierarchy with ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parse_headings(docs: DataFrame, key: str, text: str, levels: Sequence[tuple[str, str]]) -> DataFrame:
    """Lines that match a level's pattern (level, pattern with the title as group 1; the first that fits): key, line, level, title, parent (title of the heading above of a higher level), last (line before the next heading of its level or a higher one; null: to the end).

    One pass over the lines of each document and ordered windows within it.
    """
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "s"))
    depth, title = None, None
    for d, (_, pattern) in enumerate(levels):
        hit = F.col("s").rlike(pattern)
        depth = F.when(hit, d) if depth is None else depth.when(hit, d)
        title = F.when(hit, F.regexp_extract("s", pattern, 1)) if title is None else title.when(hit, F.regexp_extract("s", pattern, 1))
    heads = lines.select(key, F.col("line").cast("long").alias("line"), depth.alias("depth"), F.trim(title).alias("title")).where("depth is not null")
    before = W.partitionBy(key).orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(key).orderBy("line").rowsBetween(1, W.unboundedFollowing)
    for d in range(len(levels)):
        heads = heads.withColumn(f"__up{d}", F.last(F.when(F.col("depth") == d, F.struct("line", "title")), ignorenulls=True).over(before))
        heads = heads.withColumn(f"__dn{d}", F.min(F.when(F.col("depth") <= d, F.col("line"))).over(after))
    # the heading of a higher level that stands last before it
    ups = F.array(*[F.when(F.col("depth") > d, F.struct(F.col(f"__up{d}.line").alias("l"), F.col(f"__up{d}.title").alias("t"))) for d in range(len(levels))])
    parent = F.array_max(F.filter(ups, lambda u: u.isNotNull() & u["l"].isNotNull()))["t"]
    stop = F.element_at(F.array(*[F.col(f"__dn{d}") for d in range(len(levels))]), F.col("depth") + 1)
    names = F.array(*[F.lit(n) for n, _ in levels])
    return heads.select(key, "line", F.element_at(names, F.col("depth") + 1).alias("level"), "title", parent.alias("parent"), (stop - 1).alias("last"))
