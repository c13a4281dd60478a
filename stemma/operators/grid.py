"""Spatial joins on crowded pages: a grid of tiles for each page, as fine as the page is full, so that only near boxes meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Box

#: Boxes that a tile is to hold, and tiles on a side at most.
PER_TILE, MOST_TILES = 8, 256


def tiles_of(*tables: DataFrame, page: str) -> DataFrame:
    """(page, __k): tiles on a side of each page's grid, by how many boxes the tables have on it; the counts are added up before they are shuffled."""
    counts = tables[0].groupBy(page).agg(F.count("*").alias("__n"))
    for t in tables[1:]:
        counts = counts.unionByName(t.groupBy(page).agg(F.count("*").alias("__n")))
    return counts.groupBy(page).agg(F.least(F.lit(MOST_TILES), F.greatest(F.lit(1), F.ceil(F.sqrt(F.sum("__n") / PER_TILE)))).cast("int").alias("__k"))


def tile(at: Column) -> Column:
    """The tile of a coordinate; what lies beyond the page counts to its edge."""
    return F.least(F.col("__k") - 1, F.greatest(F.lit(0), F.floor(at * F.col("__k")).cast("int")))


def on_tiles(rows: DataFrame, grids: DataFrame, page: str, box: Box) -> DataFrame:
    """Rows once for each tile that their box touches: with __k, __tx, __ty. Boxes with null parts touch none."""
    placed = rows.join(grids, page)
    across = F.sequence(tile(box.x), F.greatest(tile(box.x), tile(box.x + box.w)))
    down = F.sequence(tile(box.y), F.greatest(tile(box.y), tile(box.y + box.h)))
    whole = box.x.isNotNull() & box.y.isNotNull() & box.w.isNotNull() & box.h.isNotNull()
    return placed.where(whole).withColumn("__tx", F.explode(across)).withColumn("__ty", F.explode(down))


def meeting(left: DataFrame, right: DataFrame, page: str, a: Box, b: Box) -> DataFrame:
    """Pairs of rows of one page whose boxes a (of left) and b (of right) touch, each pair once: in the tile of the corner where the two boxes' meeting begins."""
    grids = tiles_of(left, right, page=page)
    pairs = on_tiles(left, grids, page, a).join(on_tiles(right, grids, page, b).drop("__k"), [page, "__tx", "__ty"])
    touch = (a.x <= b.x + b.w) & (b.x <= a.x + a.w) & (a.y <= b.y + b.h) & (b.y <= a.y + a.h)
    own = (F.col("__tx") == tile(F.greatest(a.x, b.x))) & (F.col("__ty") == tile(F.greatest(a.y, b.y)))
    return pairs.where(touch & own).drop("__tx", "__ty", "__k")
