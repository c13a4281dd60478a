"""Layouts of pages: regions, number anchors and the roles of problems, over the sentences of all documents as blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import layout as Q
from ..sources.views import TEXT_BLOCKS_SQL, text_blocks


@query(f"""WITH {TEXT_BLOCKS_SQL}, body AS (SELECT * FROM blocks WHERE x BETWEEN 0 AND 1 AND y > 0.07 AND y < 0.93),
e AS (SELECT page, x, lag(x) OVER (PARTITION BY page ORDER BY x) AS before FROM (SELECT DISTINCT page, x FROM body WHERE x BETWEEN 0.18 AND 0.88)),
g AS (SELECT page, max(x - before) AS gap, arg_min((x + before) / 2, (before - x, x)) AS cut FROM e WHERE before IS NOT NULL GROUP BY page),
p AS (SELECT b.page, COALESCE(gap, 0) AS gap, COALESCE(cut, 0.5) AS cut FROM (SELECT DISTINCT page FROM blocks) b LEFT JOIN g ON b.page = g.page),
s AS (SELECT page, gap, cut, x, w, length(content) AS n, x + w / 2 < cut AS l FROM body JOIN p USING (page)),
m AS (SELECT page, gap, cut, count(*) FILTER (l) AS nl, count(*) FILTER (NOT l) AS nr, COALESCE(sum(n) FILTER (l), 0) AS lc, COALESCE(sum(n) FILTER (NOT l), 0) AS rc, list_sort(list(w) FILTER (l)) AS lw, list_sort(list(w) FILTER (NOT l)) AS rw, list_sort(list(x) FILTER (NOT l)) AS rx FROM s GROUP BY page, gap, cut),
f AS (SELECT *, COALESCE(lw[len(lw) // 2 + 1], 0) AS wl, COALESCE(rw[len(rw) // 2 + 1], 0) AS wr, COALESCE(rx[len(rx) // 2 + 1], 0) AS xr FROM m),
c AS (SELECT p.page, p.gap, p.cut, CASE WHEN f.page IS NULL THEN 'UNKNOWN' WHEN p.gap >= 0.08 AND wr > 0 AND wr < 0.32 AND xr >= 0.62 AND wr / greatest(wl, 0.2) < 0.62 AND nr >= 1 AND lc > rc THEN 'MAIN_PLUS_SIDEBAR'
  WHEN p.gap >= 0.08 AND nl >= 2 AND nr >= 2 AND wr >= 0.28 AND wl >= 0.28 AND p.cut > 0.38 AND p.cut < 0.62 THEN 'TWO_COLUMN' WHEN p.gap >= 0.08 AND nl > 0 AND nr > 0 THEN 'MIXED' ELSE 'ONE_COLUMN' END AS layout FROM p LEFT JOIN f ON p.page = f.page)
SELECT page, layout, round(gap, 6) AS gap, round(cut, 6) AS cut, CASE layout WHEN 'MAIN_PLUS_SIDEBAR' THEN 'HEADER,FOOTER,MAIN_COLUMN_1,SIDEBAR' WHEN 'TWO_COLUMN' THEN 'HEADER,FOOTER,MAIN_COLUMN_1,MAIN_COLUMN_2' ELSE 'HEADER,FOOTER,MAIN_COLUMN_1' END AS regions,
  round(CASE layout WHEN 'MAIN_PLUS_SIDEBAR' THEN 0.06 + greatest(0.4, cut - 0.08) WHEN 'TWO_COLUMN' THEN 0.04 + cut - 0.06 ELSE 0.94 END, 6) AS main_end, CASE layout WHEN 'MAIN_PLUS_SIDEBAR' THEN 0.78 WHEN 'TWO_COLUMN' THEN 0.8 WHEN 'MIXED' THEN 0.55 WHEN 'UNKNOWN' THEN 0.4 ELSE 0.7 END AS main_confidence FROM c""")
def page_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout class of every page and its regions."""
    main = F.col("regions")[2]
    found = Q.page_regions(text_blocks(spark, sf_dir))
    return found.select("page", "layout", F.round("gap", 6).alias("gap"), F.round("cut", 6).alias("cut"), F.array_join(F.transform("regions", lambda r: r["kind"]), ",").alias("regions"), F.round(main["x"] + main["w"], 6).alias("main_end"), main["confidence"].alias("main_confidence"))


@query()
def anchor_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number and step that a block begins with: class, score and evidence."""
    found = Q.number_anchors(text_blocks(spark, sf_dir))
    return found.select("page", "pos", "display", "style", "kind", F.round("score", 6).alias("score"), "region", "preview", "ambiguous", F.array_join("evidence", ",").alias("evidence"))


@query()
def context_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every problem with its box and its role by what stands around it."""
    found = Q.context_roles(text_blocks(spark, sf_dir))
    return found.select("page", "pos", "display", "region", *(F.round(c, 6).alias(c) for c in ("bx", "by", "bh", "score")), "role", F.round("role_score", 6).alias("role_score"), F.round("confidence", 6).alias("confidence"), F.array_join("role_evidence", ",").alias("evidence"))


@query()
def exercise_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of exercises on every page: where they start and end, and how many they are."""
    found = Q.exercise_runs(Q.problem_boxes(Q.number_anchors(text_blocks(spark, sf_dir))))
    return found.select("page", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "problems")
