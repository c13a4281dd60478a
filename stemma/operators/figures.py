"""Figures: which problem owns each, by evidence, how well its box is cut, and whether its crop can be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import Box
from .grid import meeting

#: The scores of a clear owner, of two that share, the gap that asks for review, the margin of a crop, and overlaps of neighbours.
CLEAR, SHARED, GAP, CROP_PAD, FIGURE_OVERLAP = 0.78, 0.58, 0.12, 0.012, 0.08
#: What a problem's text says of its figure (white space left out), and what a page says of a figure for several problems.
FIGURE_REFERENCE = r"오른쪽그림|다음그림|아래그림|그림과같이|그림을보고|다음표를보고"
SHARED_CUE = r"다음\s*그림을?\s*보고|아래\s*그림을?\s*보고|그림을?\s*보고\s*\d+\s*[~～-]\s*\d"


def padded(box: Box, by: float) -> Box:
    """A box larger by a margin on each side, cut at the page's end."""
    x, y = F.greatest(F.lit(0.0), box.x - by), F.greatest(F.lit(0.0), box.y - by)
    return Box(x, y, F.least(1 - x, box.w + 2 * by), F.least(1 - y, box.h + 2 * by))


def box_quality(detected: Box, truth: Box) -> Column:
    """FULLY_CONTAINED, MINOR_EDGE_ERROR, MAJOR_CUT or WRONG_REGION: how much of the truth a detected box holds, how much of it lies near the truth, and how much larger it is."""
    contained, extra, scale = detected.coverage(truth), padded(truth, 0.08).coverage(detected), detected.area / F.greatest(F.lit(1e-6), truth.area)
    return F.when(scale > 3.2, "WRONG_REGION").when((contained >= 0.9) & (extra >= 0.55) & (scale <= 2.4), "FULLY_CONTAINED").when((contained >= 0.75) & (scale <= 2.8), "MINOR_EDGE_ERROR").when(contained >= 0.4, "MAJOR_CUT").otherwise("WRONG_REGION")


def figure_owners(figures: DataFrame, problems: DataFrame) -> DataFrame:
    """Figures (page, figure, x, y, w, h, page_text) with owner, score, confidence, status, shared, others (the next two: id and score) and evidence.

    problems: page, problem, x, y, w, h, stem. A problem's score is what the column, the height down to the next problem near its column, coverage, place and distance
    say for it and against it. UNRESOLVED below 0.42, or where the nearest leads with less than 0.55; SHARED_OWNER_ if two score high or a cue for several comes
    with a small gap; else SINGLE_OWNER_, each _HIGH or _REVIEW. A page's figures meet its problems, which are few on a page; ties of score go to the nearer, then to
    the upper one. A figure without problems on its page is UNRESOLVED; null texts are empty; boxes with null parts take no part.
    """
    whole = "x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL AND h IS NOT NULL"
    order = W.partitionBy("page").orderBy("y", "x", "problem")
    later = F.collect_list(F.struct("x", "y", "w", "h")).over(order.rowsBetween(1, W.unboundedFollowing))
    listed = problems.where(whole).withColumns({"later": later, "rank": F.row_number().over(order)}).withColumn("near", F.get(F.filter("later", lambda o: F.abs(o["x"] - F.col("x")) < 0.28), F.lit(0)))
    p = listed.select("page", "problem", "rank", *[F.col(c).alias(f"p{c}") for c in "xywh"], *[F.col(f"near.{c}").alias(f"n{c}") for c in "xywh"], F.regexp_replace(F.coalesce("stem", F.lit("")), r"\s+", "").rlike(FIGURE_REFERENCE).alias("ref"))
    f = figures.where(whole).select("page", "figure", *[F.col(c).alias(f"f{c}") for c in "xywh"])
    fig, prob, after = Box.of("f"), Box.of("p"), Box.of("n")
    (cx, cy), (px, py), (nx, ny) = fig.centre, prob.centre, after.centre
    pairs = f.join(p, "page").withColumns({"contained": padded(prob, 0.05).coverage(fig), "dist": F.hypot(cx - px, cy - py), "next_dist": F.hypot(cx - nx, cy - ny)})
    c = F.col
    vertical = (cy >= prob.y - 0.02) & (cy <= F.coalesce(after.y - 0.004, prob.y + prob.h + 0.1))
    pairs = pairs.withColumn("vertical", vertical)
    terms = [
        ((cx >= prob.x - 0.05) & (cx <= prob.x + prob.w + 0.05), 0.28, "same_column"), (c("vertical"), 0.2, "vertical_region"), (c("contained") >= 0.65, 0.32, "inside_problem_region"), ((c("contained") < 0.65) & (c("contained") > 0.2), 0.12, "partial_region"),
        ((fig.x >= prob.x + F.least(F.lit(0.12), prob.w * 0.25)) & c("vertical"), 0.1, "right_of_stem"), (c("dist") < 0.2, 0.08, "near_stem"), (c("ref"), 0.06, "text_reference_supporting"),
        (F.coalesce(c("next_dist") + 0.04 < c("dist"), F.lit(False)) & (c("contained") == 0), -0.22, "closer_to_next_not_sufficient"), ((fig.iou(prob) > 0) & (c("contained") < 0.45), -0.08, "boundary_overlap"),
    ]
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum((F.when(t, v).otherwise(0.0) for t, v, _ in terms), F.lit(0.0))))
    pairs = pairs.withColumns({"score": F.round(score, 9), "evidence": F.array_compact(F.array(*[F.when(t, n) for t, _, n in terms]))})
    best = F.slice(F.sort_array(F.collect_list(F.struct((-c("score")).alias("s"), "dist", "rank", "problem", "score", "evidence"))), 1, 3)
    top = pairs.groupBy("page", "figure").agg(best.alias("top"))
    rows = figures.join(top, ["page", "figure"], "left").withColumn("cue", F.coalesce(c("page_text").rlike(SHARED_CUE), F.lit(False)))
    one, two = F.get("top", F.lit(0)), F.get("top", F.lit(1))
    yes = lambda x: F.coalesce(x, F.lit(False))
    rows = rows.withColumns({"best": one["score"], "close": yes((F.round(F.abs(one["score"] - two["score"]), 9) < GAP) & (two["score"] >= 0.45)), "both": yes((one["score"] >= SHARED) & (two["score"] >= SHARED)), "nearest": yes((one["dist"] <= two["dist"]) & (one["score"] < 0.55))})
    low = ~yes(c("best") >= 0.42)
    open_, several = low | c("nearest"), c("both") | (c("cue") & c("close"))
    high = several & (c("best") >= CLEAR) & yes(two["score"] >= SHARED) & c("cue")
    review = c("close") | (c("best") < CLEAR)
    status = F.when(open_, "UNRESOLVED").when(high, "SHARED_OWNER_HIGH").when(several, "SHARED_OWNER_REVIEW").when(review, "SINGLE_OWNER_REVIEW").otherwise("SINGLE_OWNER_HIGH")
    confidence = F.when(open_, 0.2).when(high, 0.84).when(several, 0.48).when(review, 0.52).otherwise(0.88)
    added = F.when(open_, F.array(F.lit("unresolved"), F.when(c("nearest"), "nearest_not_hard_rule").otherwise("low_score"))).when(several, F.concat(one["evidence"], F.array(F.when(c("cue"), "shared_cue").otherwise("two_high_scores"), F.lit("shared_explicit")))).when(review, F.array_append(one["evidence"], F.when(c("close"), "owner_gap_small").otherwise("score_below_high"))).otherwise(one["evidence"])
    others = F.transform(F.slice(F.coalesce("top", F.array().cast(rows.schema["top"].dataType)), 2, 2), lambda o: F.struct(o["problem"].alias("problem"), F.round(o["score"], 3).alias("score")))
    return rows.select("page", "figure", F.when(~low, one["problem"]).alias("owner"), F.coalesce("best", F.lit(0.0)).alias("score"), confidence.alias("confidence"), status.alias("status"), F.when(open_, c("both") | c("cue")).otherwise(several).alias("shared"), others.alias("others"), added.alias("evidence"))


def figure_safety(figures: DataFrame, bodies: DataFrame, truths: DataFrame | None = None) -> DataFrame:
    """(page, figure, safety, reasons) of figures (page, figure, x, y, w, h): FIGURE_CROP_SAFE, _REVIEW, or _UNSAFE where the true figure is cut.

    bodies: page, body, x, y, w, h of other problems' texts; truths: page, figure, box of the true figure. Edges of the page, bodies that lie in a figure's
    crop and are covered by it, and other figures that overlap it speak against a crop. Neighbours are met in tiles of the page's grid.
    """
    f = figures.select("page", "figure", *[F.col(c).alias(f"f{c}") for c in "xywh"])
    fig, crop = Box.of("f"), padded(Box.of("f"), CROP_PAD)
    edges = [(fig.x < 0.004, "left_cut"), (fig.y < 0.004, "top_cut"), (fig.x + fig.w > 0.996, "right_cut"), (fig.y + fig.h > 0.996, "bottom_cut")]
    grown = f.withColumns({f"c{k}": v for k, v in zip("xywh", (crop.x, crop.y, crop.w, crop.h))})
    b = bodies.select("page", *[F.col(c).alias(f"b{c}") for c in "xywh"])
    over = Box.of("c").intersection(Box.of("b"))
    intruded = (over / F.greatest(F.lit(1e-6), fig.area) > 0.35) & (over / F.greatest(F.lit(1e-6), Box.of("b").area) > 0.12)
    by_body = meeting(grown, b, "page", Box.of("c"), Box.of("b")).where(intruded).select("page", "figure", F.lit("neighbor_body_intrusion").alias("r")).distinct()
    o = figures.select("page", F.col("figure").alias("other"), *[F.col(c).alias(f"o{c}") for c in "xywh"])
    by_figure = meeting(grown, o, "page", Box.of("c"), Box.of("o")).where((F.col("figure") != F.col("other")) & (Box.of("c").iou(Box.of("o")) > FIGURE_OVERLAP)).select("page", "figure", F.lit("neighbor_figure_intrusion").alias("r")).distinct()
    found = by_body.unionByName(by_figure)
    if truths is not None:
        t = truths.select("page", "figure", *[F.col(c).alias(f"t{c}") for c in "xywh"])
        cut = f.join(t, ["page", "figure"]).where(box_quality(fig, Box.of("t")).isin("MAJOR_CUT", "WRONG_REGION"))
        found = found.unionByName(cut.select("page", "figure", F.lit("required_figure_cut").alias("r")).distinct())
    met = found.groupBy("page", "figure").agg(F.collect_set("r").alias("rs"))
    out = f.join(met, ["page", "figure"], "left").withColumn("rs", F.coalesce("rs", F.array().cast("array<string>")))
    has = lambda n: F.array_contains("rs", n)
    later = [(has(n), n) for n in ("required_figure_cut", "neighbor_body_intrusion", "neighbor_figure_intrusion")]
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), n) for t, n in (*edges, *later)]))
    return out.select("page", "figure", F.when(has("required_figure_cut"), "FIGURE_CROP_UNSAFE").when(F.size(reasons) > 0, "FIGURE_CROP_REVIEW").otherwise("FIGURE_CROP_SAFE").alias("safety"), reasons.alias("reasons"))
