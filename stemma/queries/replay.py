"""Headings replayed in sections, and order statistics of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import replay as R
from ..operators import scan as S
from ..sources.tables import table
from ..sources.views import BOXES_SQL, SECTION_ITEMS_SQL, section_headings, section_items, section_types


@query(f"""WITH {BOXES_SQL}, {SECTION_ITEMS_SQL},
u AS (SELECT section, page, col, y, 0 AS k, c, code IS NOT NULL OR amb AS known, concept, code, amb, NULL AS item FROM headings UNION ALL SELECT section, page, col, top + 0.06, 1, NULL, FALSE, NULL, NULL, NULL, item FROM items),
h AS (SELECT item, section IS NOT NULL AND COALESCE(bool_or(c) OVER w, FALSE) AS c, last_value(CASE WHEN known AND NOT c THEN {{'amb': amb, 'code': code, 'concept': concept}} END IGNORE NULLS) OVER w AS l, k, section FROM u WINDOW w AS (PARTITION BY section ORDER BY page, col, y, k ROWS UNBOUNDED PRECEDING)),
s AS (SELECT i.item, i.number, i.section, i.page, i.top, h.c, CASE WHEN i.section IS NOT NULL AND NOT h.c THEN h.l END AS l, list_distinct(list_filter(sc, lambda v: (v + i.section) % 7 < 5)) AS sc, list_distinct(list_filter(pc, lambda v: (v + i.section) % 7 < 5)) AS pc FROM items i JOIN h ON h.k = 1 AND h.item = i.item),
o AS (SELECT *, c OR COALESCE(l.amb, FALSE) AS blocked, CASE WHEN NOT l.amb THEN l END AS inh FROM s),
f AS (SELECT *, CASE WHEN section IS NULL THEN NULL WHEN len(sc) = 1 AND (c OR inh IS NULL OR inh.code IS NOT DISTINCT FROM sc[1]) THEN {{'code': sc[1], 'node': sc[1], 'type': sc[1] + 100, 'how': 'stem_type_marker'}} WHEN c THEN NULL WHEN len(pc) = 1 THEN {{'code': pc[1], 'node': pc[1], 'type': pc[1] + 100, 'how': 'page_ocr_unique_type'}}
  WHEN inh IS NOT NULL THEN {{'code': inh.code, 'node': CASE WHEN inh.concept THEN NULL ELSE inh.code END, 'type': CASE WHEN inh.concept THEN 500 ELSE inh.code + 100 END, 'how': CASE WHEN inh.concept THEN 'inherit_concept_heading' ELSE 'inherit_previous_in_section' END}} END AS own FROM o),
g AS (SELECT *, last_value(CASE WHEN own.node IS NOT NULL AND own.type IS NOT NULL AND NOT c AND len(sc) <= 1 THEN own END IGNORE NULLS) OVER (PARTITION BY section ORDER BY number, page, top, item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM f),
z AS (SELECT *, CASE WHEN own IS NOT NULL THEN own WHEN section IS NOT NULL AND NOT c AND NOT blocked AND last IS NOT NULL THEN {{'code': last.code, 'node': last.node, 'type': last.type, 'how': 'inherit_previous_in_section'}} END AS r FROM g)
SELECT item, section, r.code AS code, r.node AS node, r.type AS type, r.how AS how, CASE WHEN section IS NULL THEN 'NO_SECTION' WHEN len(sc) > 1 THEN 'TYPE_MARKER_AMBIGUOUS' WHEN r IS NULL OR r.node IS NULL AND r.type IS NULL THEN 'TYPE_MARKER_MISSING' ELSE '' END AS reasons, c AS c_stage, blocked FROM z""")
def heading_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item's type by the headings before it, its own marks, and the items before it."""
    found = R.replayed_types(section_items(spark, sf_dir), section_headings(spark, sf_dir), section_types(spark, sf_dir))
    return found.withColumn("reasons", F.array_join("reasons", ","))


@query("""SELECT l_returnflag, count(l_extendedprice) AS n, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.25), 4) AS q1, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.5), 4) AS median, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.9), 4) AS p90 FROM lineitem GROUP BY l_returnflag""")
def group_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of groups that hold a third of all rows each, with no group in one task."""
    q = S.quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.25, 0.5, 0.9])
    return q.select("l_returnflag", "n", *[F.round(F.col("q")[i], 4).alias(c) for i, c in enumerate(("q1", "median", "p90"))])


@query("""SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS place, count(*) OVER (PARTITION BY event_type) AS size, CASE WHEN count(*) OVER (PARTITION BY event_type) < 3 THEN 'MID' WHEN (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) * 3 < (count(*) OVER (PARTITION BY event_type) - 1) THEN 'LOW' WHEN (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) * 3 < 2 * (count(*) OVER (PARTITION BY event_type) - 1) THEN 'MID' ELSE 'HIGH' END AS third FROM events""")
def large_group_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and thirds in groups of any size."""
    found = S.ranked(table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), ["event_type"], ["ts", "event_id"], "place", "size")
    ahead, rest = (F.col("place") - 1) * 3, F.col("size") - 1
    return found.select("event_id", "event_type", "place", "size", F.when(F.col("size") < 3, "MID").when(ahead < rest, "LOW").when(ahead < 2 * rest, "MID").otherwise("HIGH").alias("third"))


_STAGE_PAGES_SQL = """pages AS (SELECT o_custkey % 4 AS book, o_orderkey AS page, CASE WHEN o_orderkey % 37 = 5 THEN 'A_BASIC' WHEN o_orderkey % 23 = 4 THEN 'B_TYPE' END AS code, CASE WHEN o_orderkey % 37 = 5 THEN 0.9 WHEN o_orderkey % 23 = 4 THEN 0.72 END AS confidence, o_orderkey % 19 = 3 AS filler FROM orders),
seen AS (SELECT o_custkey % 4 AS book, o_orderkey AS page, 'B_SKILL' AS code, CAST(0.98 AS DOUBLE) AS confidence FROM orders WHERE o_orderkey % 74 = 5 AND o_custkey % 4 <> 3),
hits AS (SELECT book, page, arg_min(code, (rank, -confidence, code)) AS code, arg_min(confidence, (rank, -confidence, code)) AS confidence, CASE min(rank) WHEN 0 THEN 'VISUAL_HEADING' ELSE 'TEXT_HEADING' END AS evidence FROM (SELECT book, page, code, confidence, 0 AS rank FROM seen UNION ALL SELECT book, page, code, confidence, 1 FROM pages WHERE code IS NOT NULL AND page >= 8) GROUP BY book, page)"""


def _stage_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as pages of four books, with the stages that their texts name, and what was seen on some."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    basic, kind = k % 37 == 5, k % 23 == 4
    pages = o.select((F.col("o_custkey") % 4).alias("book"), k.alias("page"), F.when(basic, "A_BASIC").when(kind, "B_TYPE").alias("code"), F.when(basic, "A").when(kind, "B").alias("label"), F.when(basic, 0.9).when(kind, 0.72).alias("confidence"), (k % 19 == 3).alias("filler"))
    seen = o.where((k % 74 == 5) & (F.col("o_custkey") % 4 != 3)).select((F.col("o_custkey") % 4).alias("book"), k.alias("page"), F.lit("B_SKILL").alias("code"), F.lit("S").alias("label"), F.lit(0.98).alias("confidence"))
    return pages, seen


@query(f"""WITH {_STAGE_PAGES_SQL}, f AS (SELECT book, arg_min({{'at': page, 'code': code, 'confidence': confidence, 'evidence': evidence}}, page) AS s FROM hits GROUP BY book),
l AS (SELECT p.book, p.page, p.filler, last_value(CASE WHEN h.page IS NOT NULL THEN {{'at': h.page, 'code': h.code, 'confidence': h.confidence, 'evidence': h.evidence}} END IGNORE NULLS) OVER (PARTITION BY p.book ORDER BY p.page) AS s FROM pages p LEFT JOIN hits h ON h.book = p.book AND h.page = p.page),
a AS (SELECT l.book, l.page, CASE WHEN NOT filler THEN COALESCE(l.s, f.s) END AS s FROM l LEFT JOIN f ON l.book = f.book)
SELECT book, page, COALESCE(s.code, 'UNKNOWN') AS code, round(CASE WHEN s IS NULL THEN 0 WHEN s.at = page THEN s.confidence ELSE greatest(0.55, s.confidence - 0.08) END, 6) AS confidence, CASE WHEN s IS NULL THEN 'UNKNOWN' WHEN s.at = page THEN s.evidence ELSE 'LAYOUT_BOUNDARY' END AS evidence FROM a""")
def page_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage of every page: what was seen, what texts name, and what goes on from earlier pages."""
    found = R.stage_map(*_stage_pages(spark, sf_dir))
    return found.select("book", "page", "code", F.round("confidence", 6).alias("confidence"), "evidence")


@query(f"""WITH {_STAGE_PAGES_SQL} SELECT h.book, h.page AS page_start, COALESCE(lead(h.page) OVER (PARTITION BY h.book ORDER BY h.page) - 1, m.last_page) AS page_end, code, round(confidence, 6) AS confidence FROM hits h JOIN (SELECT book, max(page) AS last_page FROM pages GROUP BY book) m ON m.book = h.book""")
def stage_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each stage begins and ends."""
    pages, seen = _stage_pages(spark, sf_dir)
    found = R.stage_ranges(R.stage_hits(pages, seen), pages.groupBy("book").agg(F.max("page").alias("last_page")))
    return found.select("book", "page_start", "page_end", "code", F.round("confidence", 6).alias("confidence"))
