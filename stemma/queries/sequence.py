"""Neighbours, gaps, as-of joins, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import sequence as Q
from ..sources.tables import table
from ..sources.views import BOXES_SQL, ITEMS_SQL, PROBLEMS_SQL, boxes, items, problems

_FLOW = """flow AS (SELECT l_suppkey AS book, l_orderkey AS seq, l_linenumber AS line, CAST(l_orderkey // 8 AS BIGINT) AS page, CASE WHEN l_partkey % 23 <> 0 THEN CAST(l_orderkey % 90 + l_linenumber AS BIGINT) END AS number FROM lineitem)"""


def _flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("book"), F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("line"), F.floor(F.col("l_orderkey") / 8).alias("page"), F.when(F.col("l_partkey") % 23 != 0, (F.col("l_orderkey") % 90 + F.col("l_linenumber")).cast("long")).alias("number"), F.col("l_partkey").alias("part"))


@query("""WITH flow AS (SELECT l_suppkey AS book, l_orderkey AS seq, l_linenumber AS line, l_partkey AS part, CAST(l_orderkey // 8 AS BIGINT) AS page, CASE WHEN l_partkey % 23 <> 0 THEN CAST(l_orderkey % 90 + l_linenumber AS BIGINT) END AS number FROM lineitem),
m AS (SELECT *, CASE WHEN number IS NOT NULL THEN row_number() OVER (PARTITION BY book, number ORDER BY page, seq, line, part) > 1 ELSE FALSE END AS again,
  CASE WHEN number IS NOT NULL THEN lag(number) OVER (PARTITION BY book, number IS NOT NULL ORDER BY page, seq, line, part) END AS before, CASE WHEN number IS NOT NULL THEN lag(page) OVER (PARTITION BY book, number IS NOT NULL ORDER BY page, seq, line, part) END AS bp FROM flow),
w AS (SELECT *, CASE WHEN number IS NULL THEN 'NOT_CANONICAL' WHEN again THEN 'DUPLICATE' WHEN number < before AND number <= 30 AND before >= 40 AND page IS DISTINCT FROM bp THEN 'CHAPTER_RESET' WHEN number < before THEN 'REVERSED'
  WHEN number - before > 1 AND page IS NOT DISTINCT FROM bp THEN 'GAP_ON_PAGE' WHEN number - before > 20 AND page IS DISTINCT FROM bp THEN 'UNIT_JUMP' END AS why FROM m)
SELECT book, seq, line, part, page, number, before, why, CASE WHEN why IN ('NOT_CANONICAL', 'DUPLICATE', 'REVERSED') THEN 'REVIEW' WHEN why = 'GAP_ON_PAGE' THEN 'SUSPICIOUS' WHEN why IS NOT NULL THEN 'EXPECTED_BOOK_STRUCTURE' ELSE 'OK' END AS status FROM w""")
def number_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is odd about numbers in reading order."""
    return Q.number_flow(_flow(spark, sf_dir), "book", "page", "number", ["page", "seq", "line", "part"])


@query(f"WITH {_FLOW}, d AS (SELECT DISTINCT book, number FROM flow WHERE number IS NOT NULL), b AS (SELECT book, min(number) AS lo, max(number) AS hi FROM d GROUP BY book), every AS (SELECT book, unnest(range(lo, hi + 1)) AS missing FROM b) SELECT e.book, e.missing FROM every e ANTI JOIN d ON e.book = d.book AND e.missing = d.number")
def number_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that each book lacks between its first and last."""
    return Q.missing_numbers(_flow(spark, sf_dir).where("number is not null"), "book", "number")


@query("""SELECT * FROM (SELECT conv_id, turn, CAST(length(text) // 40 AS BIGINT) AS page, lag(CAST(length(text) // 40 AS BIGINT)) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE page < before - 1""")
def page_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns more than one 'page' behind the one ahead of them."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.floor(F.length("text") / 40).alias("page"))
    return Q.reversals(rows, "conv_id", "page", ["turn"])


@query("""WITH h AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY ALL)
SELECT p.event_id, p.user_id, p.ts, h.event_id AS heading, h.ts AS heading_at FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN h ON p.user_id = h.user_id AND p.ts >= h.ts""")
def asof_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with its user's last signup at or before it."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    marks = e.where("event_type = 'signup'").select("user_id", "ts", "event_id")
    return Q.as_of(e.where("event_type = 'purchase'").drop("event_type"), marks.withColumnRenamed("event_id", "mark"), "user_id", "ts", "mark", "heading")


@query("""WITH s AS (SELECT c_nationkey AS book, c_custkey AS start, COALESCE(lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1, 1000000000) AS stop FROM customer)
SELECT book, start, stop AS "end" FROM s""")
def section_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that end where the next one starts."""
    heads = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("book"), F.col("c_custkey").alias("start"))
    return Q.section_ranges(heads, "book", "start", F.lit(1_000_000_000).cast("long"))


@query("""WITH s AS (SELECT c_nationkey AS book, c_custkey AS start, c_custkey + 3 AS stop FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer) WHERE n % 2 = 1),
r AS (SELECT s_nationkey AS book, s_suppkey * 7 % 1500 AS at, s_suppkey FROM supplier)
SELECT r.book, r.at, r.s_suppkey, max(s.start) AS start, max(s.stop) AS "end" FROM r LEFT JOIN (SELECT s1.*, lead(start) OVER (PARTITION BY book ORDER BY start) AS nxt FROM s s1) s ON r.book = s.book AND r.at >= s.start AND (s.nxt IS NULL OR r.at < s.nxt) AND r.at <= s.stop GROUP BY r.book, r.at, r.s_suppkey""")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the section whose range holds them, by an ordered window and no range join."""
    from pyspark.sql import Window as W

    c = table(spark, sf_dir, "customer").withColumn("n", F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey"))).where("n % 2 = 1")
    sections = c.select(F.col("c_nationkey").alias("book"), F.col("c_custkey").alias("start"), (F.col("c_custkey") + 3).alias("end"))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("book"), (F.col("s_suppkey") * 7 % 1500).alias("at"), "s_suppkey")
    return Q.in_range(rows, sections, "book", "at")


@query("""WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'click' THEN event_id END AS value, event_type = 'error' AS reset FROM events),
r AS (SELECT *, count(*) FILTER (reset) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e)
SELECT user_id, event_id, value, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM r""")
def carry_with_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last click of each user since their last error."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.when(F.col("event_type") == "click", F.col("event_id")).alias("value"), (F.col("event_type") == "error").alias("reset"))
    return Q.carry(e, "user_id", ["ts", "event_id"], "value", "reset", "carried").select("user_id", "event_id", "value", "carried")


@query(f"""WITH {BOXES_SQL} SELECT page, item, y, COALESCE(lead(y) OVER (PARTITION BY page ORDER BY y, item) - 0.004, least(1.0, y + 0.2)) AS bottom FROM boxes""")
def next_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that end above the next anchor."""
    rows = boxes(spark, sf_dir).withColumn("at", F.struct("y", "item"))
    from pyspark.sql import Window as W

    below = F.lead("y").over(W.partitionBy("page").orderBy("y", "item"))
    return rows.select("page", "item", "y", F.coalesce(below - 0.004, F.least(F.lit(1.0), F.col("y") + 0.2)).alias("bottom"))


@query(f"""WITH {BOXES_SQL}, g AS (SELECT page, x, round(x - lag(x) OVER (PARTITION BY page ORDER BY x, item), 9) AS gap FROM boxes), m AS (SELECT page, max(gap) AS gap, arg_max(x, (gap, -x)) FILTER (gap IS NOT NULL) AS x FROM g GROUP BY page)
SELECT page, round(gap, 6) AS gap, round(CASE WHEN gap >= 0.08 AND x - gap / 2 BETWEEN 0.1 AND 0.9 THEN x - gap / 2 END, 6) AS split FROM m""")
def largest_gap_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column split of each page."""
    found = Q.largest_gap(boxes(spark, sf_dir), "page", "x", 0.08, (0.1, 0.9))
    return found.select("page", F.round("gap", 6).alias("gap"), F.round("split", 6).alias("split"))


@query("""WITH RECURSIVE r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, length(text) % 3 <> 0 AND lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT NULL AS j FROM conversations),
s AS (SELECT conv_id, n, turn, j AS takes FROM r WHERE n = 1 UNION ALL SELECT r.conv_id, r.n, r.turn, r.j AND NOT s.takes FROM s JOIN r ON r.conv_id = s.conv_id AND r.n = s.n + 1)
SELECT conv_id, turn, takes AS takes_next, COALESCE(lag(takes) OVER (PARTITION BY conv_id ORDER BY turn), FALSE) AS taken FROM s""")
def stitch_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments that take in their successor; one that was taken in cannot."""
    from pyspark.sql import Window as W

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", ((F.length("text") % 3 != 0) & F.lead("turn").over(W.partitionBy("conv_id").orderBy("turn")).isNotNull()).alias("could"))
    return Q.stitch(rows, "conv_id", ["turn"], F.col("could")).drop("could")


@query(f"""WITH {ITEMS_SQL} SELECT item_id, type_id, round(CASE WHEN count(*) OVER w = 1 THEN 0.5 ELSE (row_number() OVER (w ORDER BY price, item_id) - 1) / (count(*) OVER w - 1) END, 6) AS rank FROM items WINDOW w AS (PARTITION BY type_id)""")
def relative_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each item within its type."""
    found = Q.relative_rank(items(spark, sf_dir).select("item_id", "type_id", "price"), ["type_id"], ["price", "item_id"], "rank")
    return found.select("item_id", "type_id", F.round("rank", 6).alias("rank"))


@query(f"""WITH {ITEMS_SQL}, r AS (SELECT item_id, brand, count(*) OVER w AS n, (row_number() OVER (w ORDER BY price, item_id) - 1) / NULLIF(count(*) OVER w - 1, 0) AS t FROM items WINDOW w AS (PARTITION BY brand))
SELECT item_id, brand, CASE WHEN n < 3 THEN 'MID' WHEN t < 1.0 / 3 THEN 'LOW' WHEN t < 2.0 / 3 THEN 'MID' ELSE 'HIGH' END AS third FROM r""")
def terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirds of each brand by price."""
    return Q.tercile(items(spark, sf_dir).select("item_id", "brand", "price"), ["brand"], ["price", "item_id"], "third").drop("price")


@query(f"""WITH {PROBLEMS_SQL}, t AS (SELECT doc_id, lang, review_status, row_number() OVER (PARTITION BY lang, review_status ORDER BY doc_id) AS turn FROM problems) SELECT doc_id, lang, review_status, CAST(turn AS BIGINT) AS turn FROM t ORDER BY turn, lang, review_status LIMIT 60""")
def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty problems, one stratum after another (sixty is the sample)."""
    found = Q.round_robin(problems(spark, sf_dir).select("doc_id", "lang", "review_status"), ["lang", "review_status"], ["doc_id"], 60)
    return found.withColumn("turn", F.col("turn").cast("long"))


@query(f"""WITH {PROBLEMS_SQL}, g AS (SELECT lang, page, dense_rank() OVER (ORDER BY lang, page) AS g FROM (SELECT DISTINCT lang, page FROM problems WHERE page IS NOT NULL))
SELECT p.doc_id, CASE WHEN g.g % 5 = 0 THEN 'HOLDOUT' ELSE 'TRAIN' END AS split FROM problems p JOIN g ON p.lang = g.lang AND p.page = g.page""")
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole groups of language and page, every fifth held out."""
    return Q.hold_out(problems(spark, sf_dir).where("page is not null").select("doc_id", "lang", "page"), ["lang", "page"]).select("doc_id", "split")


@query("""WITH p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS m FROM documents)
SELECT doc_id, source FROM p WHERE m <= 7 OR i IN (SELECT CAST(floor(k * (p.m - 1) / 6 + 0.5) AS BIGINT) FROM range(7) t(k))""")
def evenly_spaced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven documents of each source, evenly spaced (seven is the sample)."""
    return Q.evenly_spaced(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], ["doc_id"], 7)


@query("""WITH p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY source) AS m FROM documents) SELECT doc_id, source FROM p WHERE i = 1 OR i = m OR i = (m + 1) // 2""")
def recovery_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, middle and last of each source."""
    return Q.first_middle_last(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], ["doc_id"])


@query("""SELECT conv_id, turn, lag(role) OVER w AS before, lead(role) OVER w AS after, CAST((row_number() OVER w - 1) // 3 AS BIGINT) AS batch FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def neighbours_and_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of each turn, and batches of three."""
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"), Q.chunks(["turn"], 3, ["conv_id"]).alias("batch"))


@query("""SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents) WHERE n = 1""")
def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each source and language, by aggregation."""
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("doc_id"))
