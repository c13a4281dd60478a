"""Joins of boxes on pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import Box
from .grid import meeting, tile, tiles_of


def _sides(rows: DataFrame, page: str, item: str) -> tuple[DataFrame, DataFrame]:
    left = rows.select(F.col(page), F.col(item).alias("a"), *[F.col(c).alias(f"a{c}") for c in "xywh"])
    right = rows.select(F.col(page), F.col(item).alias("b"), *[F.col(c).alias(f"b{c}") for c in "xywh"])
    return left, right


def box_pairs(rows: DataFrame, page: str = "page", item: str = "item", least: float = 0.0) -> DataFrame:
    """(page, a, b, iou) of pairs a < b on one page whose IoU exceeds `least` (0 or more): boxes that touch meet in a tile of the page's grid (see grid.meeting())."""
    left, right = _sides(rows, page, item)
    iou = Box.of("a").iou(Box.of("b"))
    return meeting(left, right, page, Box.of("a"), Box.of("b")).where("a < b").select(page, "a", "b", iou.alias("iou")).where(F.col("iou") > least)


def max_overlap(rows: DataFrame, page: str = "page", item: str = "item") -> DataFrame:
    """Each box with the largest share of it that another box of its page covers; 0 alone."""
    left, right = _sides(rows, page, item)
    pairs = meeting(left, right, page, Box.of("a"), Box.of("b")).where("a != b").select(page, "a", Box.of("a").overlap(Box.of("b")).alias("o"))
    top = pairs.groupBy(page, "a").agg(F.max("o").alias("overlap"))
    return left.select(page, "a").join(top, [page, "a"], "left").select(page, F.col("a").alias(item), F.coalesce("overlap", F.lit(0.0)).alias("overlap"))


def text_in_regions(regions: DataFrame, blocks: DataFrame, page: str, *, margin: float = 0.01, coverage: float | None = None, glue: str = "\n") -> DataFrame:
    """Regions (page, region, x, y, w, h) with the text of blocks (page, pos, content, x, y, w, h) whose centre, or enough of which, lies within, in order of pos."""
    r = regions.select(page, "region", *[F.col(c).alias(f"a{c}") for c in "xywh"])
    b = blocks.select(page, "pos", "content", *[F.col(c).alias(f"b{c}") for c in "xywh"])
    own, block = Box.of("a"), Box.of("b")
    inside: Column = own.holds_centre(block, margin)
    if coverage is not None:
        inside = inside | (own.coverage(block) >= coverage)
    # a little more than the margin: what lies just on its edge touches too
    near = Box(own.x - margin * 1.01, own.y - margin * 1.01, own.w + margin * 2.02, own.h + margin * 2.02)
    found = meeting(r, b, page, near, block).where(inside).groupBy(page, "region").agg(F.sort_array(F.collect_list(F.struct("pos", "content"))).alias("t"), F.count("*").alias("blocks"))
    return regions.select(page, "region").join(found, [page, "region"], "left").select(page, "region", F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce(F.concat_ws(glue, F.transform("t", lambda s: s["content"])), F.lit("")).alias("text"))


def nearest_below(rows: DataFrame, page: str = "page", item: str = "item", dx: float = 0.08, dy: float = 0.01) -> DataFrame:
    """Each box with the next one below it in its column.

    First among the tiles of its column down to one below its own: what is found there is the next one, as all higher ones are there too. Boxes that
    find none, on a crowded page those at its foot, look at the whole page.
    """
    left, right = _sides(rows, page, item)
    near = (F.abs(F.col("ax") - F.col("bx")) < dx) & (F.col("by") > F.col("ay") + dy)
    best = F.min_by("b", F.struct("by", "b")).alias("next")
    grids = tiles_of(rows, page=page)
    seen = left.join(grids, page).where("ax IS NOT NULL AND ay IS NOT NULL")
    down = tile(F.col("ay") + dy)
    seen = seen.withColumn("__tx", F.explode(F.sequence(tile(F.col("ax") - dx), tile(F.col("ax") + dx)))).withColumn("__ty", F.explode(F.sequence(down, F.least(down + 1, F.col("__k") - 1)))).drop("__k")
    held = right.join(grids, page).where("bx IS NOT NULL AND by IS NOT NULL").withColumn("__tx", tile(F.col("bx"))).withColumn("__ty", tile(F.col("by"))).drop("__k")
    first = seen.join(held, [page, "__tx", "__ty"]).where(near).groupBy(page, "a").agg(best)
    found = left.select(page, "a", "ax", "ay").join(first, [page, "a"], "left")
    rest = found.where("next IS NULL").select(page, "a", "ax", "ay").join(right, page).where(near).groupBy(page, "a").agg(best.alias("__later"))
    return found.join(rest, [page, "a"], "left").select(page, F.col("a").alias(item), F.coalesce("next", "__later").alias("next"))


def owners(figures: DataFrame, problems: DataFrame, score: Column, page: str = "page", *, least: float = 0.5, gap: float = 0.12) -> DataFrame:
    """Each figure (f) with its best-scoring problem (p) on the page: SINGLE if clear, SHARED if two are near, else UNRESOLVED. score: over both sides' columns."""
    pairs = figures.join(problems, page).select(page, "f", "p", score.alias("s"))
    order = W.partitionBy(page, "f").orderBy(F.col("s").desc(), "p")
    top = pairs.withColumn("n", F.row_number().over(order)).where("n <= 2")
    out = top.groupBy(page, "f").agg(F.max(F.when(F.col("n") == 1, F.col("p"))).alias("owner"), F.max(F.when(F.col("n") == 1, F.col("s"))).alias("best"), F.coalesce(F.max(F.when(F.col("n") == 2, F.col("s"))), F.lit(0.0)).alias("second"))
    verdict = F.when(F.col("best") < least, "UNRESOLVED").when(F.col("best") - F.col("second") >= gap, "SINGLE").otherwise("SHARED")
    return out.withColumn("verdict", verdict)
