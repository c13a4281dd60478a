"""Ordered sequences: neighbours, gaps, as-of and range joins, splits, stitching and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scan import ranked, running


def number_flow(rows: DataFrame, group: str, page: str, number: str, order: list[str]) -> DataFrame:
    """Rows with what is odd about their number: status (OK, REVIEW, SUSPICIOUS, EXPECTED_BOOK_STRUCTURE), why, and the number before.

    number: null if it could not be read (REVIEW). A number met before in the group is REVIEW, but still the one before its successor. A
    smaller number than the one before is a chapter's start if it is at most 30 after 40 or more on another page, else REVIEW; a gap on one
    page is SUSPICIOUS, one of more than 20 across pages is expected.
    """
    canonical = F.col(number).isNotNull()
    seq = W.partitionBy(group, canonical).orderBy(*order)
    same = W.partitionBy(group, number).orderBy(*order)
    prev, prev_page = F.lag(number).over(seq), F.lag(page).over(seq)
    marked = rows.select("*", F.when(canonical, F.row_number().over(same) > 1).otherwise(False).alias("__again"), F.when(canonical, prev).alias("before"), F.when(canonical, prev_page).alias("__bp"))
    gap = F.col(number) - F.col("before")
    moved = ~F.col(page).eqNullSafe(F.col("__bp"))
    why = (
        F.when(F.col(number).isNull(), "NOT_CANONICAL")
        .when(F.col("__again"), "DUPLICATE")
        .when((gap < 0) & (F.col(number) <= 30) & (F.col("before") >= 40) & moved, "CHAPTER_RESET")
        .when(gap < 0, "REVERSED")
        .when((gap > 1) & ~moved, "GAP_ON_PAGE")
        .when((gap > 20) & moved, "UNIT_JUMP")
    )
    status = F.when(F.col("why").isin("NOT_CANONICAL", "DUPLICATE", "REVERSED"), "REVIEW").when(F.col("why") == "GAP_ON_PAGE", "SUSPICIOUS").when(F.col("why").isNotNull(), "EXPECTED_BOOK_STRUCTURE").otherwise("OK")
    return marked.withColumn("why", why).withColumn("status", status).drop("__again", "__bp")


def missing_numbers(rows: DataFrame, group: str, number: str) -> DataFrame:
    """(group, missing): whole numbers between a group's numbers that it lacks. Only gaps are spread out, so work is in proportion to the result."""
    seq = W.partitionBy(group).orderBy(number)
    gaps = rows.select(group, number).distinct().withColumn("after", F.lead(number).over(seq)).where(F.col("after") > F.col(number) + 1)
    return gaps.select(group, F.explode(F.sequence(F.col(number) + 1, F.col("after") - 1)).alias("missing"))


def reversals(rows: DataFrame, group: str, page: str, order: list[str]) -> DataFrame:
    """Rows that stand more than one page before the row ahead of them."""
    before = F.lag(page).over(W.partitionBy(group).orderBy(*order))
    return rows.withColumn("before", before).where(F.col(page) < F.col("before") - 1)


def as_of(rows: DataFrame, marks: DataFrame, key: str, at: str, value: str, out: str) -> DataFrame:
    """Rows with the value and place of the last mark of their key at or before them: one shuffle and an ordered window, no range join.

    Equal places: the mark counts. Where several marks share a place, the greatest value wins.
    """
    names = rows.columns
    one = marks.groupBy(key, at).agg(F.max(value).alias("__v"))
    both = rows.select(*names, F.lit(None).cast(one.schema["__v"].dataType).alias("__v"), F.lit(1).alias("__k")).unionByName(one.select(key, at, "__v", F.lit(0).alias("__k")), allowMissingColumns=True)
    seq = W.partitionBy(key).orderBy(at, "__k").rowsBetween(W.unboundedPreceding, W.currentRow)
    hit = F.when(F.col("__k") == 0, F.struct(F.col("__v").alias("v"), F.col(at).alias("a")))
    return both.withColumn("__h", F.last(hit, ignorenulls=True).over(seq)).where("__k = 1").select(*names, F.col("__h.v").alias(out), F.col("__h.a").alias(f"{out}_at"))


def heading_confidence(distance: Column) -> Column:
    """How far a heading carries, by pages since it; a stale one little."""
    return F.when(distance < 0, 0.22).when(distance <= 2, 0.96).when(distance <= 5, 0.78).when(distance <= 10, 0.52).when(distance.isNotNull(), 0.28)


def section_ranges(heads: DataFrame, group: str, start: str, last: Column) -> DataFrame:
    """Sections with their end: one before the next start, or `last`."""
    return heads.withColumn("end", F.coalesce(F.lead(start).over(W.partitionBy(group).orderBy(start)) - 1, last))


def in_range(rows: DataFrame, sections: DataFrame, group: str, at: str, start: str = "start", end: str = "end") -> DataFrame:
    """Rows with the first section that holds them: an as-of join on its start, then a check of its end. Sections of a group do not overlap."""
    marks = sections.select(group, F.col(start).alias(at), F.struct(F.col(start).alias("s"), F.col(end).alias("e")).alias("__sec"))
    found = as_of(rows, marks, group, at, "__sec", "__f")
    inside = F.col(at) <= F.col("__f.e")
    return found.select(*rows.columns, F.when(inside, F.col("__f.s")).alias(start), F.when(inside, F.col("__f.e")).alias(end))


def carry(rows: DataFrame, group: str, order: list[str], value: str, reset: str, out: str) -> DataFrame:
    """Values carried forward in reading order within a group; a row whose `reset` holds starts afresh (its own value counts)."""
    seq = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = rows.withColumn("__run", F.count_if(F.col(reset)).over(seq))
    inner = W.partitionBy(group, "__run").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return numbered.withColumn(out, F.last(value, ignorenulls=True).over(inner)).drop("__run")


def largest_gap(rows: DataFrame, group: str, x: str, least: float, bounds: tuple[float, float] = (0.25, 0.75)) -> DataFrame:
    """Where a page splits in two columns: the middle of the widest gap between neighbours, if wide enough and within bounds, else null."""
    gaps = rows.select(group, x, F.lag(x).over(W.partitionBy(group).orderBy(x)).alias("__b")).withColumn("__g", F.round(F.col(x) - F.col("__b"), 9))
    best = gaps.groupBy(group).agg(F.max(F.struct(F.col("__g").alias("g"), (-F.col(x)).alias("x"))).alias("m"))
    gap, mid = F.col("m.g"), -F.col("m.x") - F.col("m.g") / 2
    return best.select(group, gap.alias("gap"), F.when((gap >= least) & mid.between(*bounds), mid).alias("split"))


def next_boundary(rows: DataFrame, group: list[str], y: str, gap: float, default: float) -> DataFrame:
    """Anchors with the bottom of their region: just above the next one, or a default height down, at most the page's end."""
    below = F.lead(y).over(W.partitionBy(*group).orderBy(y))
    return rows.withColumn("bottom", F.coalesce(below - gap, F.least(F.lit(1.0), F.col(y) + default)))


def stitch(rows: DataFrame, group: str, order: list[str], joins: Column) -> DataFrame:
    """Marks rows that take in the next one and rows that are taken in: `joins` says whether a row could take its successor.

    A row that is taken in cannot take another; so in a run of rows that could, every other one does, from the first on.
    """
    seq = W.partitionBy(group).orderBy(*order)
    marked = rows.withColumn("__j", F.coalesce(joins, F.lit(False))).withColumn("__r", F.row_number().over(seq))
    # runs of rows that could, by the number of rows so far that could not
    run = marked.withColumn("__b", F.count_if(~F.col("__j")).over(seq.rowsBetween(W.unboundedPreceding, W.currentRow)))
    place = F.row_number().over(W.partitionBy(group, "__b", "__j").orderBy("__r"))
    takes = F.when(F.col("__j"), place % 2 == 1).otherwise(False)
    chosen = run.withColumn("takes_next", takes)
    return chosen.withColumn("taken", F.coalesce(F.lag("takes_next").over(seq), F.lit(False))).drop("__j", "__r", "__b")


def relative_rank(rows: DataFrame, group: list[str], order: list, name: str) -> DataFrame:
    """Rows with their place in the group from 0 to 1; 0.5 alone. Groups of any size: see scan.ranked()."""
    out = ranked(rows, group, order, "__i", "__m")
    return out.withColumn(name, F.when(F.col("__m") == 1, 0.5).otherwise((F.col("__i") - 1) / (F.col("__m") - 1))).drop("__i", "__m")


def tercile(rows: DataFrame, group: list[str], order: list, name: str) -> DataFrame:
    """Rows with their LOW, MID or HIGH third of the group by relative rank; MID in groups of fewer than three."""
    out = ranked(rows, group, order, "__i", "__m")
    t = (F.col("__i") - 1) / F.nullif(F.col("__m") - 1, F.lit(0))
    return out.withColumn(name, F.when(F.col("__m") < 3, "MID").when(t < 1 / 3, "LOW").when(t < 2 / 3, "MID").otherwise("HIGH")).drop("__i", "__m")


def chunks(order: list, size: int, group: list[str]) -> Column:
    """Number of the fixed-size batch of each row within its group."""
    return F.floor((F.row_number().over(W.partitionBy(*group).orderBy(*order)) - 1) / size)


def round_robin(rows: DataFrame, strata: list[str], order: list, n: int) -> DataFrame:
    """n rows, one from each stratum in turn: strata in the order of their keys, rows in the order given. The limit is what a sample is."""
    turn = rows.withColumn("__turn", F.row_number().over(W.partitionBy(*strata).orderBy(*order))).where(F.col("__turn") <= n)
    return turn.orderBy("__turn", *strata).limit(n).withColumnRenamed("__turn", "turn")


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows that `keys` tell apart, numbered from 1 in their order, over as many tasks as there are ranges of it (see scan.running())."""
    return running(rows, [], keys, {name: ("count", F.lit(1))})


def hold_out(rows: DataFrame, keys: list[str], every: int = 5, *, start: int | None = None, badge: str | None = None, need: tuple[str, ...] = ("LOW_BADGE", "HIGH_BADGE"), order: list[str] | None = None) -> DataFrame:
    """Rows with a split: whole groups go one way, every fifth in the order of their keys to HOLDOUT, from group number `start` on (the fifth if none is given).

    badge: a column of classes; of each in `need` that HOLDOUT lacks, the first row of TRAIN by group and `order`, which tells rows apart, goes there too.
    """
    groups = numbered(rows.select(*keys).distinct(), keys, "__g")
    held = F.pmod(F.col("__g") - (every if start is None else start), F.lit(every)) == 0
    out = rows.join(groups, keys).withColumn("split", F.when(held, "HOLDOUT").otherwise("TRAIN"))
    if badge is None:
        return out.drop("__g")
    at = F.struct("__g", *(order or keys))
    lacking = out.where(F.col(badge).isin(*need)).groupBy(F.col(badge).alias("__b")).agg(F.max(F.col("split") == "HOLDOUT").alias("__has"), F.min(at).alias("__first")).where("not __has")
    moved = F.coalesce(at == F.col("__first"), F.lit(False))
    return out.join(F.broadcast(lacking), F.col(badge) == F.col("__b"), "left").withColumn("split", F.when(moved, "HOLDOUT").otherwise(F.col("split"))).select(*rows.columns, "split")


def evenly_spaced(rows: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """At most n rows of each group, evenly spaced from first to last."""
    placed = ranked(rows, group, order, "__i", "__m").withColumn("__i", F.col("__i") - 1)
    # row i is chosen if it is the nearest to some i(m-1)/(n-1)
    spaced = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor(k * (F.col("__m") - 1) / max(1, n - 1) + 0.5))
    return placed.where((F.col("__m") <= n) | F.array_contains(spaced, F.col("__i"))).drop("__i", "__m")


def first_middle_last(rows: DataFrame, group: list[str], order: list) -> DataFrame:
    placed = ranked(rows, group, order, "__i", "__m")
    return placed.where((F.col("__i") == 1) | (F.col("__i") == F.col("__m")) | (F.col("__i") == F.floor((F.col("__m") + 1) / 2))).drop("__i", "__m")
