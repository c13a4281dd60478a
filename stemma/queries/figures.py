"""Figures on pages: owners by evidence, quality of boxes and safety of crops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.geometry import Box
from ..operators import figures as Q
from ..sources.tables import table
from ..sources.views import BOXES_SQL, boxes

_PAD = "greatest(0.0, t.x - 0.08)", "greatest(0.0, t.y - 0.08)"
_TRUTH = "SELECT page, item, x + (item % 4) * 0.02 AS x, y + (page % 5) * 0.01 AS y, w * (1 + page % 3) / 2 AS w, h * (1 + item % 3) / 2 AS h FROM boxes"


def page_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third box as a figure, with the text of the document that has the page's number."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, " 다음 그림을 보고").otherwise("")).alias("page_text"))
    return boxes(spark, sf_dir).where("item % 3 = 0").withColumnRenamed("item", "figure").join(docs, "page", "left")


def page_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other boxes as problems."""
    return boxes(spark, sf_dir).where("item % 3 <> 0").withColumnRenamed("item", "problem").withColumn("stem", F.when((F.col("page") + F.col("problem")) % 4 == 0, "오른쪽 그림과 같이").when(F.col("problem") % 2 == 0, "x = 1"))


@query(f"""WITH {BOXES_SQL}, truth AS ({_TRUTH}), i AS (SELECT d.page, d.item, d.w * d.h AS da, t.w * t.h AS ta, greatest(0.0, least(d.x + d.w, t.x + t.w) - greatest(d.x, t.x)) * greatest(0.0, least(d.y + d.h, t.y + t.h) - greatest(d.y, t.y)) AS common,
  greatest(0.0, least(d.x + d.w, {_PAD[0]} + least(1 - {_PAD[0]}, t.w + 0.16)) - greatest(d.x, {_PAD[0]})) * greatest(0.0, least(d.y + d.h, {_PAD[1]} + least(1 - {_PAD[1]}, t.h + 0.16)) - greatest(d.y, {_PAD[1]})) AS wide FROM boxes d JOIN truth t ON d.page = t.page AND d.item = t.item),
r AS (SELECT page, item, round(common / ta, 9) AS contained, round(wide / da, 9) AS extra, round(da / greatest(1e-6, ta), 9) AS scale FROM i)
SELECT page, item, CASE WHEN scale > 3.2 THEN 'WRONG_REGION' WHEN contained >= 0.9 AND extra >= 0.55 AND scale <= 2.4 THEN 'FULLY_CONTAINED' WHEN contained >= 0.75 AND scale <= 2.8 THEN 'MINOR_EDGE_ERROR' WHEN contained >= 0.4 THEN 'MAJOR_CUT' ELSE 'WRONG_REGION' END AS quality FROM r
WHERE abs(contained - 0.9) > 1e-7 AND abs(contained - 0.75) > 1e-7 AND abs(contained - 0.4) > 1e-7 AND abs(extra - 0.55) > 1e-7""")
def box_qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each box holds what it should; boxes within 1e-7 of a threshold, where two engines' sums may differ, are left to the test."""
    b = boxes(spark, sf_dir)
    t = b.selectExpr("page", "item", "x + (item % 4) * 0.02D AS tx", "y + (page % 5) * 0.01D AS ty", "w * (1 + page % 3) / 2 AS tw", "h * (1 + item % 3) / 2 AS th")
    rows = b.join(t, ["page", "item"])
    d, truth = Box.of(), Box.of("t")
    near = lambda v, at: F.abs(v - at) <= 1e-7
    contained, extra = d.coverage(truth), Q.padded(truth, 0.08).coverage(d)
    return rows.where(~(near(contained, 0.9) | near(contained, 0.75) | near(contained, 0.4) | near(extra, 0.55))).select("page", "item", Q.box_quality(d, truth).alias("quality"))


@query()
def figure_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which problem each figure belongs to, how sure that is, and why."""
    found = Q.figure_owners(page_figures(spark, sf_dir), page_problems(spark, sf_dir))
    return found.select("page", "figure", "owner", F.round("score", 6).alias("score"), "confidence", "status", "shared", F.array_join(F.transform("others", lambda o: F.concat(o["problem"].cast("string"), F.lit(":"), o["score"].cast("string"))), ",").alias("others"), F.array_join("evidence", ",").alias("evidence"))


@query()
def figure_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each figure's crop can be used."""
    truths = page_figures(spark, sf_dir).where("page % 2 = 0").selectExpr("page", "figure", "x", "y", "w * (1 + figure % 2) AS w", "h")
    found = Q.figure_safety(page_figures(spark, sf_dir), page_problems(spark, sf_dir).withColumnRenamed("problem", "body"), truths)
    return found.select("page", "figure", "safety", F.array_join("reasons", ",").alias("reasons"))
