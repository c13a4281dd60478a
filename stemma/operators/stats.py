"""Counts, distributions, correlation, calibration and evaluation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import rate
from .scan import quantiles, ranked, running
from .sequence import numbered


def census(rows: DataFrame, reasons: str, policy: Sequence[str] = ()) -> DataFrame:
    """(reason, n, rows): how often each reason is given, and by how many rows; policy reasons are left out."""
    kept = F.array_except(F.col(reasons), F.array(*[F.lit(p) for p in policy]).cast("array<string>")) if policy else F.array_distinct(reasons)
    every = rows.select(F.explode(F.col(reasons)).alias("reason"))
    if policy:
        every = every.where(~F.col("reason").isin(*policy))
    n = every.groupBy("reason").agg(F.count("*").alias("n"))
    distinct = rows.select(F.explode(kept).alias("reason")).groupBy("reason").agg(F.count("*").alias("rows"))
    return n.join(distinct, "reason")


def histogram(rows: DataFrame, column: str, domain: Sequence, missing: str = "REVIEW") -> DataFrame:
    """Counts of every value of a fixed domain, 0 where there are none; nulls under `missing`."""
    spark = rows.sparkSession
    values = spark.createDataFrame([(str(v),) for v in [*domain, missing]], "value string")
    counts = rows.select(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    return values.join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def crosstab(rows: DataFrame, label: str, band: Column, bands: Sequence[str]) -> DataFrame:
    """Label by band, with a fixed domain and UNKNOWN for all else: one aggregation, no pivot pass over the values."""
    known = F.coalesce(band, F.lit("UNKNOWN"))
    known = F.when(known.isin(*bands), known).otherwise("UNKNOWN")
    tagged = rows.withColumn("__band", known)
    return tagged.groupBy(label).agg(*[F.count_if(F.col("__band") == b).alias(b.lower()) for b in [*bands, "UNKNOWN"]])


def describe(rows: DataFrame, group: str, column: str) -> DataFrame:
    """n, min, quartiles (interpolated), mean, max and population deviation, three decimals."""
    sums = rows.groupBy(group).agg(F.count(column).alias("n"), F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))
    cuts = quantiles(rows, [group], column, [0.25, 0.5, 0.75]).select(F.col(group).alias("__g"), "q")
    out = sums.join(cuts, F.col(group).eqNullSafe(F.col("__g")), "left")
    r = lambda c: F.coalesce(F.round(c, 3), F.lit(0.0))
    return out.select(group, "n", r(F.col("min")).alias("min"), r(F.col("q")[0]).alias("q1"), r(F.col("q")[1]).alias("median"), r(F.col("mean")).alias("mean"), r(F.col("q")[2]).alias("q3"), r(F.col("max")).alias("max"), r(F.col("std")).alias("std"))


def spearman(rows: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Rank correlation per group with average ranks for ties; null for fewer than three rows or no variance."""

    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(group, F.col(x).alias("__x"), F.col(y).alias("__y"))
    # ties share the mean of their places
    for c, out in (("__x", "rx"), ("__y", "ry")):
        known = running(known, [group], [c], {out: ("count", F.lit(1))})
        means = known.groupBy(F.col(group).alias("__g"), F.col(c).alias("__v")).agg(F.avg(out).alias("__mean"))
        known = known.join(means, F.col(group).eqNullSafe(F.col("__g")) & (F.col(c) == F.col("__v"))).withColumn(out, F.col("__mean")).drop("__g", "__v", "__mean")
    ranks = known
    out = ranks.groupBy(group).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("c"), F.stddev_pop("rx").alias("sx"), F.stddev_pop("ry").alias("sy"))
    return out.select(group, "n", F.when((F.col("n") >= 3) & (F.col("sx") > 0) & (F.col("sy") > 0), F.round("c", 3)).alias("rho"))


def confusion(rows: DataFrame, actual: Column, predicted: Column, *groups: str) -> DataFrame:
    """Confusion counts with precision and recall (1 over nothing) and the rate of false alarms (0 over nothing)."""
    out = rows.groupBy(*groups).agg(F.count_if(actual & predicted).alias("tp"), F.count_if(~actual & predicted).alias("fp"), F.count_if(actual & ~predicted).alias("fn"), F.count_if(~actual & ~predicted).alias("tn"))
    r = lambda part, whole, empty: F.round(rate(part, whole, empty), 6)
    return out.select(*groups, "tp", "fp", "fn", "tn", r(F.col("tp"), F.col("tp") + F.col("fp"), 1.0).alias("precision"), r(F.col("tp"), F.col("tp") + F.col("fn"), 1.0).alias("recall"), r(F.col("fp"), F.col("fp") + F.col("tn"), 0.0).alias("false_rate"))


def threshold_grid(rows: DataFrame, score: str, margin: str, correct: Column, thresholds: Sequence[float], margins: Sequence[float]) -> DataFrame:
    """Errors and accepted rows of every pair of thresholds, best first: fewest errors, then most accepted, then grid order.

    All cells are counted in one pass over the rows, as columns.
    """
    cells = [(i, t, m) for i, (t, m) in enumerate((t, m) for t in thresholds for m in margins)]
    takes = [(F.col(score) >= t) & (F.col(margin) >= m) for _, t, m in cells]
    counts = rows.agg(*[F.count_if(a).alias(f"a{i}") for (i, _, _), a in zip(cells, takes, strict=True)], *[F.count_if(a & ~correct).alias(f"e{i}") for (i, _, _), a in zip(cells, takes, strict=True)])
    grid = F.array(*[F.struct(F.lit(i).cast("long").alias("cell"), F.lit(t).alias("threshold"), F.lit(m).alias("margin"), F.col(f"a{i}").alias("accepted"), F.col(f"e{i}").alias("errors")) for i, t, m in cells])
    ranked = F.array_sort(F.transform(grid, lambda g: F.struct(g["errors"].alias("errors"), (-g["accepted"]).alias("n"), g["cell"].alias("cell"), g["threshold"].alias("threshold"), g["margin"].alias("margin"))))
    return counts.select(F.posexplode(ranked).alias("place", "g")).select((F.col("place") + 1).cast("long").alias("place"), "g.threshold", "g.margin", (-F.col("g.n")).alias("accepted"), "g.errors")


def nearest_rank(rows: DataFrame, group: str, column: str, order: list[str], cuts: Mapping[str, float]) -> DataFrame:
    """Values at positions round(p (n - 1)) of each group's order."""
    placed = ranked(rows.select(group, column, *[c for c in order if c not in (group, column)]), [group], order, "i", "n")
    return placed.groupBy(group).agg(*[F.max(F.when(F.col("i") - 1 == F.floor((F.col("n") - 1) * p + 0.5), F.col(column))).alias(name) for name, p in cuts.items()])


def collapsed(rows: DataFrame, group: str, value: str, most: float = 0.55) -> DataFrame:
    """The largest share of one value in each group, and whether it is too large."""
    n = rows.groupBy(group, value).count()
    out = n.groupBy(group).agg((F.max("count") / F.sum("count")).alias("s"))
    return out.select(group, F.round("s", 6).alias("top_share"), (F.col("s") >= most).alias("collapsed"))


def majority(rows: DataFrame, keys: list[str], label: str, least: int = 1) -> DataFrame:
    """The most frequent label of each key with enough votes; ties go to the smaller label."""
    votes = rows.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("votes"))
    top = votes.groupBy(*keys).agg(F.min_by(F.struct(label, "votes"), F.struct((-F.col("votes")).alias("v"), F.col(label).alias("l"))).alias("t"))
    return top.select(*keys, F.col(f"t.{label}").alias(label), "t.votes").where(F.col("votes") >= least)


def scoreboard(rows: DataFrame, engine: str, hits: Mapping[str, tuple[str, str]], verdict: str, seconds: str) -> DataFrame:
    """Per engine: hit rates as ratios of sums (null over nothing), verdict counts and mean seconds."""
    sums = [F.sum(c).alias(f"__{name}_{k}") for name, pair in hits.items() for k, c in zip("ht", pair, strict=True)]
    out = rows.groupBy(engine).agg(F.count("*").alias("samples"), *[F.count_if(F.col(verdict) == v).alias(v.lower()) for v in ("GREEN", "YELLOW", "RED")], F.round(F.avg(seconds), 3).alias("mean_seconds"), *sums)
    return out.select(engine, "samples", "green", "yellow", "red", "mean_seconds", *[F.round(rate(F.col(f"__{n}_h"), F.col(f"__{n}_t"), None), 3).alias(n) for n in hits])


def spread(rows: DataFrame, group: str, score: str) -> DataFrame:
    """n and spread of each band, stable with enough of both, and PASS, PARTIAL or FAIL."""
    out = rows.groupBy(group).agg(F.count(score).alias("n"), F.round(F.max(score) - F.min(score), 6).alias("spread"))
    enough, wide = F.col("n") >= 8, F.col("spread") >= 0.04
    return out.withColumn("verdict", F.when(enough & wide, "PASS").when(enough | wide, "PARTIAL").otherwise("FAIL"))


def cost_rollup(rows: DataFrame, text: str, *, usd_per_million: float = 0.1, cap_usd: float = 5.0) -> DataFrame:
    """Distinct texts, their tokens (half their characters, 32 at least), price and whether it is within the cap."""
    distinct = rows.where(F.trim(text) != "").select(F.xxhash64(text).alias("a"), F.sha2(text, 256).alias("b"), F.length(text).alias("n")).distinct()
    out = distinct.agg(F.count("*").alias("texts"), F.coalesce(F.sum(F.greatest(F.lit(32), F.ceil(F.col("n") / 2))), F.lit(0)).cast("long").alias("tokens"))
    return out.withColumn("usd", F.round(F.col("tokens") * usd_per_million / 1e6, 6)).withColumn("within_cap", F.col("usd") <= cap_usd)


def capped_plan(rows: DataFrame, order: list[str], price: float, calls: int, usd: float) -> DataFrame:
    """Rows, which `order` tells apart, in that order with the running cost, and whether calls and money last for them."""
    out = numbered(rows, order, "call").withColumn("cost", F.round(F.col("call") * price, 6))
    return out.withColumn("planned", (F.col("call") <= calls) & (F.col("cost") <= usd))


def assert_counts(rows: DataFrame, **expected: Column) -> DataFrame:
    """One row with the number of violations of each invariant (a condition that must hold), unknown ones included."""
    return rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in expected.items()])
