"""Pages read as layouts: regions, number anchors, runs of exercises and the role of each problem. One exchange by page; all else is windows over it and expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions.repair import glued_number


def _clamped(blocks: DataFrame, page: str) -> DataFrame:
    """One row a page: its blocks in order of pos, kept inside it."""
    limit = lambda c: F.least(F.lit(0.98), F.greatest(F.lit(0.0), F.coalesce(F.col(c), F.lit(0.0)).cast("double")))
    size = lambda c, at: F.least(1 - at, F.greatest(F.lit(0.002), F.coalesce(F.col(c), F.lit(0.0)).cast("double")))
    x, y = limit("x"), limit("y")
    one = F.struct("pos", x.alias("x"), y.alias("y"), size("w", x).alias("w"), size("h", y).alias("h"), "content")
    return blocks.groupBy(page).agg(F.sort_array(F.collect_list(one)).alias("bs"))


def page_regions(blocks: DataFrame, page: str = "page") -> DataFrame:
    """(page, layout, gap, cut, regions) of blocks (page, pos, x, y, w, h, content): see page_map(). Nulls count as 0 and no text; a page without blocks has no row."""
    return _clamped(blocks, page).select(page, L.page_map(F.col("bs")).alias("m")).select(page, "m.layout", "m.gap", "m.cut", "m.regions")


def number_anchors(blocks: DataFrame, page: str = "page") -> DataFrame:
    """Every block that begins with a number or a step: page, pos, x, y, display, value, style, kind (its class), score, region, preview, ambiguous, evidence; and bs, the blocks of its page.

    blocks: page, pos, x, y, w, h (in page units), content. A page is bounded: its blocks meet as one row, once, and windows over pages need no other exchange. Lists of
    answers and tables of contents hold no problems but those that ask for something. Null coordinates count as 0 and null
    texts are empty; repeated blocks are blocks; an empty table gives no rows.
    """
    return _anchors(blocks, page).drop("i")


def _anchors(blocks: DataFrame, page: str) -> DataFrame:
    """number_anchors() with i, the block's place on its page. A page's blocks stay with its first row while rows are sorted."""
    said = lambda b: F.coalesce(b["content"], F.lit(""))
    rows = _clamped(blocks, page).select(page, "bs", L.page_map(F.col("bs")).alias("map"), F.substring(F.array_join(F.transform("bs", said), "\n"), 1, 400).rlike(L.EXAMPLE_PAGE).alias("example_page"), (L.answer_key_like(F.col("bs")) | L.catalog_like(F.col("bs"))).alias("listed"))
    rows = rows.select("*", F.posexplode("bs").alias("i", "b")).withColumn("n", glued_number(F.col("b.content"))).withColumn("following", F.array_join(F.transform(F.slice("bs", F.col("i") + 1, 4), said), "")).withColumn("bs", F.when(F.col("i") == 0, F.col("bs")))
    # blocks without a number are neither seeds nor anchors, so they are not sorted; but a page's first one has its blocks
    rows = rows.where("n.display IS NOT NULL OR n.reason = 'step_marker' OR i = 0")
    whole = W.partitionBy(page).orderBy("i").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumn("seeds", F.collect_list(F.when(L.is_seed(F.col("n"), F.col("b.x")), F.col("n.value"))).over(whole))
    rows = rows.withColumn("n", L.number_among(F.col("n"), F.col("b.content"), F.col("seeds")))
    rows = rows.withColumn("lefts", F.collect_list(F.when(F.col("n.display").isNotNull(), F.col("b.x"))).over(whole)).withColumn("bs", F.first("bs", ignorenulls=True).over(whole)).where("n.display IS NOT NULL OR n.reason = 'step_marker'")
    n, step = F.col("n"), F.col("n.reason") == "step_marker"
    rows = rows.withColumns(L.anchor_facts(n, F.col("b.x"), F.col("b.y"), F.col("following"), F.col("map"), F.col("example_page"), F.col("seeds"), F.col("lefts")))
    rows = rows.withColumns({"score": L.anchor_score(n), "kind": L.anchor_kind(n), "preview": F.when(step, "").otherwise(F.substring("n.rest", 1, 80))})
    mute = (F.col("kind") == "PROBLEM_ANCHOR") & F.col("listed") & ~F.concat("preview", "following").rlike(L.PROBLEM_BODY)
    zeros = (F.col("kind") == "PAGE_DECORATION") & (F.length("n.display") >= 2) & n["display"].startswith("0") & (n["style"] != "4_DIGIT")
    score = F.when(step, 0.1).when(zeros, F.least(F.col("score"), F.lit(0.3))).when(mute, F.least(F.col("score"), F.lit(0.25))).otherwise(F.col("score"))
    return rows.select(page, "i", "b.pos", "b.x", "b.y", F.when(step, "STEP").otherwise(n["display"]).alias("display"), F.when(~step, n["value"]).alias("value"), "n.style", F.when(mute, "PAGE_DECORATION").otherwise(F.col("kind")).alias("kind"), score.alias("score"), "region", "preview", "n.ambiguous", L.anchor_evidence(n).alias("evidence"), "bs")


def problem_boxes(anchors: DataFrame, page: str = "page") -> DataFrame:
    """The problems of number_anchors() in reading order, with box (bx, by, bh: down to the next problem), `run` (which run of exercises, null outside) and the run's start and end.

    A run is two or more neighbours whose numbers are at most two apart and that are aligned: islands by a lag and a running sum.
    """
    order = W.partitionBy(page).orderBy("y", "x", "pos")
    after = F.lead("y").over(order)
    top = F.greatest(F.lit(L.HEADER_Y), F.col("y") - 0.004)
    bottom = F.least(F.lit(L.FOOTER_Y), F.greatest(F.col("by") + 0.04, F.coalesce(F.col("after") - 0.006, F.lit(L.FOOTER_Y - 0.01))))
    rows = anchors.where("kind = 'PROBLEM_ANCHOR'").withColumns({"after": after, "by": top, "bx": F.greatest(F.lit(0.05), F.least(F.lit(0.5), F.col("x") - 0.012)), "number": F.col("display").cast("long")})
    rows = rows.withColumn("bh", bottom - F.col("by")).withColumn("next_top", F.lead("by").over(order))
    goes_on = (F.abs(F.col("number") - F.lag("number").over(order)) <= 2) & (F.abs(F.col("bx") - F.lag("bx").over(order)) < 0.08)
    rows = rows.withColumn("fresh", F.coalesce((~goes_on).cast("int"), F.lit(1))).withColumn("run", F.sum("fresh").over(order))
    mine = W.partitionBy(page, "run").orderBy("y", "x", "pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    several = F.count("*").over(mine) > 1
    return rows.withColumns({"run_start": F.when(several, F.first("by").over(mine)), "run_end": F.when(several, F.last(F.col("by") + F.col("bh")).over(mine))}).withColumn("run", F.when(F.col("run_start").isNotNull(), F.col("run"))).drop("after", "fresh")


def exercise_runs(problems: DataFrame, page: str = "page") -> DataFrame:
    """(page, start, end, problems) of the runs of problem_boxes()."""
    return problems.where("run IS NOT NULL").groupBy(page, "run").agg(F.first("run_start").alias("start"), F.first("run_end").alias("end"), F.count("*").alias("problems")).drop("run")


def context_roles(blocks: DataFrame, page: str = "page") -> DataFrame:
    """Each problem of the pages with its box and its role by what stands around it: columns of problem_boxes() with role, role_score, confidence and role_evidence."""
    found = _anchors(blocks, page).where("kind = 'PROBLEM_ANCHOR'")
    # again a page's blocks stay with one row until all windows but the last are done
    nth = F.row_number().over(W.partitionBy(page).orderBy("i"))
    rows = problem_boxes(found.withColumn("nth", nth).withColumn("bs", F.when(F.col("nth") == 1, F.col("bs"))).drop("nth", "i"), page)
    whole = W.partitionBy(page).orderBy("y", "x", "pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumns({"numbers": F.collect_list("number").over(whole), "spans": F.collect_list(F.when(F.col("run").isNotNull(), F.struct("run_start", "run_end"))).over(whole), "bs": F.first("bs", ignorenulls=True).over(whole)})
    until = F.array_join(F.transform(F.filter("bs", lambda b: (b["y"] >= F.col("by") - 0.002) & F.coalesce(b["y"] < F.col("next_top") - 0.002, F.lit(True))), lambda b: F.coalesce(b["content"], F.lit(""))), "")
    exercise = F.exists("spans", lambda r: F.col("by").between(r["run_start"] - 0.02, r["run_end"] + 0.02))
    rows = rows.withColumns({"until": until, "exercise": exercise, "sequence": F.exists("numbers", lambda n: F.abs(n - F.col("number")) == 1)})
    rows = rows.withColumns(L.role_facts(F.col("display"), F.col("preview"), F.col("until"), F.col("bs"), F.col("bx"), F.col("by"), F.col("bh"))).withColumns(L.role_scores())
    return rows.withColumn("r", L.context_role()).select(page, "pos", "display", "region", "bx", "by", "bh", "score", "run", "r.role", F.col("r.score").alias("role_score"), "r.confidence", F.col("r.evidence").alias("role_evidence"))
