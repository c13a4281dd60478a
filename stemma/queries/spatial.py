"""Boxes on pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.geometry import Box, from_pixels, to_pixels
from ..operators import spatial as G
from ..sources.views import BOXES_SQL, boxes

_INTER = "greatest(0.0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0.0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"


@query(f"WITH {BOXES_SQL}, p AS (SELECT a.page, a.item AS a, b.item AS b, {_INTER} AS i, a.w * a.h + b.w * b.h AS s FROM boxes a JOIN boxes b ON a.page = b.page AND a.item < b.item) SELECT page, a, b, round(i / (s - i), 6) AS iou FROM p WHERE i > 0")
def iou_selfjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of boxes of a page that meet."""
    return G.box_pairs(boxes(spark, sf_dir)).withColumn("iou", F.round("iou", 6))


@query(f"WITH {BOXES_SQL} SELECT a.page, a.item, round(COALESCE(max(CASE WHEN b.item IS NOT NULL THEN {_INTER} / greatest(1e-9, a.w * a.h) END), 0.0), 6) AS overlap FROM boxes a LEFT JOIN boxes b ON a.page = b.page AND a.item <> b.item GROUP BY ALL")
def max_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each box another one covers."""
    return G.max_overlap(boxes(spark, sf_dir)).withColumn("overlap", F.round("overlap", 6))


@query(f"""WITH {BOXES_SQL}, f AS (SELECT r.page, r.item AS region, CAST(count(b.item) AS BIGINT) AS blocks, COALESCE(string_agg('L' || b.item, chr(10) ORDER BY b.item), '') AS text
  FROM boxes r LEFT JOIN boxes b ON r.page = b.page AND b.item % 2 = 0 AND b.x + b.w / 2 >= r.x - 0.01 AND b.x + b.w / 2 <= r.x + r.w + 0.01 AND b.y + b.h / 2 >= r.y - 0.01 AND b.y + b.h / 2 <= r.y + r.h + 0.01 WHERE r.item % 2 = 1 GROUP BY ALL) SELECT * FROM f""")
def centre_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of the blocks whose centres lie in each region."""
    b = boxes(spark, sf_dir)
    regions = b.where("item % 2 = 1").withColumnRenamed("item", "region")
    blocks = b.where("item % 2 = 0").withColumn("content", F.concat(F.lit("L"), "item")).withColumnRenamed("item", "pos")
    return G.text_in_regions(regions, blocks, "page")


@query(f"WITH {BOXES_SQL} SELECT a.page, a.item, arg_min(b.item, (b.y, b.item)) AS next FROM boxes a LEFT JOIN boxes b ON a.page = b.page AND abs(a.x - b.x) < 0.08 AND b.y > a.y + 0.01 GROUP BY ALL")
def nearest_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next box below in the same column."""
    return G.nearest_below(boxes(spark, sf_dir))


@query(f"""WITH {BOXES_SQL}, s AS (SELECT a.page, a.item AS f, b.item AS p, round(0.7 * {_INTER} / (a.w * a.h) + 0.3 * greatest(0.0, 1 - abs(a.y - b.y) * 2), 9) AS s FROM boxes a JOIN boxes b ON a.page = b.page WHERE a.item % 3 = 0 AND b.item % 3 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY page, f ORDER BY s DESC, p) AS n FROM s), o AS (SELECT page, f, max(p) FILTER (n = 1) AS owner, max(s) FILTER (n = 1) AS best, COALESCE(max(s) FILTER (n = 2), 0.0) AS second FROM r WHERE n <= 2 GROUP BY ALL)
SELECT *, CASE WHEN best < 0.5 THEN 'UNRESOLVED' WHEN best - second >= 0.12 THEN 'SINGLE' ELSE 'SHARED' END AS verdict FROM o""")
def ownership_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which problem each figure belongs to."""
    b = boxes(spark, sf_dir)
    figures = b.where("item % 3 = 0").select("page", F.col("item").alias("f"), *[F.col(c).alias(f"f{c}") for c in "xywh"])
    rows = b.where("item % 3 != 0").select("page", F.col("item").alias("p"), *[F.col(c).alias(f"p{c}") for c in "xywh"])
    figure, problem = Box.of("f"), Box.of("p")
    score = F.round(0.7 * problem.intersection(figure) / figure.area + 0.3 * F.greatest(F.lit(0.0), 1 - F.abs(figure.y - problem.y) * 2), 9)
    return G.owners(figures, rows, score)


@query(f"WITH {BOXES_SQL} SELECT page, item, x >= 0 AND y >= 0 AND w > 0 AND h > 0 AND x + w <= 1 AND y + h <= 1 AS valid, round(least(w, 1 - x), 6) AS cw, round(least(h, 1 - y), 6) AS ch FROM boxes")
def box_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which boxes lie on their page, and clamped to it."""
    box = Box.of()
    c = box.clamped()
    return boxes(spark, sf_dir).select("page", "item", box.valid().alias("valid"), F.round(c.w, 6).alias("cw"), F.round(c.h, 6).alias("ch"))


@query("""SELECT l_orderkey, l_linenumber, round(least(l_partkey % 500, l_partkey % 500 + d) / 500.0, 6) AS x, round(abs(d) / 500.0, 6) AS w, CAST(greatest(1, round(abs(d) / 500.0 * 250)) AS INTEGER) AS px_w FROM (SELECT *, CAST(l_suppkey % 200 - 100 AS BIGINT) AS d FROM lineitem)""")
def pixel_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles dragged from any corner, as boxes and back at half size."""
    from ..sources.tables import table

    line = table(spark, sf_dir, "lineitem").withColumn("d", F.col("l_suppkey") % 200 - 100)
    box = from_pixels(F.col("l_partkey") % 500, F.lit(10), F.col("d"), F.lit(20), F.lit(500.0), F.lit(800.0))
    return line.select("l_orderkey", "l_linenumber", F.round(box.x, 6).alias("x"), F.round(box.w, 6).alias("w"), to_pixels(box, F.lit(250.0), F.lit(400.0))[2].alias("px_w"))
