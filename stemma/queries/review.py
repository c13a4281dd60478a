"""Runs, gates, reviews and copies of versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import review as R
from ..sources.tables import table
from ..sources.views import BOXES_SQL, REVIEW_LOG_SQL, boxes, review_log


@query(f"""WITH {REVIEW_LOG_SQL}, s AS (SELECT *, CASE WHEN status = 'FAILED' THEN stage END AS err FROM review_log),
n AS (SELECT *, CASE WHEN err IS DISTINCT FROM lag(err) OVER (PARTITION BY run_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS fresh FROM s),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM n),
l AS (SELECT run_id, max(c) AS longest FROM (SELECT run_id, grp, count(err) AS c FROM g GROUP BY run_id, grp) GROUP BY run_id),
c AS (SELECT run_id, count(*) AS attempted, count_if(status = 'FAILED') AS failed, count_if(status = 'BLOCKED') AS unknown, count_if(stage = 'purchase') AS problem, count_if(stage = 'signup') AS answer, count_if(stage = 'click') AS explanation, median(value) AS m, count_if(event_id % 13 = 0) AS leaked FROM review_log GROUP BY run_id)
SELECT run_id, attempted, failed, longest, concat_ws(',', CASE WHEN attempted >= 8 AND failed / attempted >= 0.15 THEN 'ocr_fail_rate_high' END, CASE WHEN longest >= 3 THEN 'repeated_same_error' END, CASE WHEN unknown >= 40 THEN 'classifier_mass_unknown' END,
  CASE WHEN failed >= 20 THEN 'ocr_failed_mass' END, CASE WHEN attempted >= 20 AND m < 40 THEN 'ocr_text_systematic_corruption' END, CASE WHEN leaked >= 5 THEN 'answer_explanation_problem_confusion' END, CASE WHEN problem >= 170 AND answer + explanation = 0 THEN 'answer_section_missing_suspicious' END) AS reasons
FROM c JOIN l USING (run_id)""")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which runs should stop, and why (values of events stand for lengths of texts)."""
    log = review_log(spark, sf_dir)
    repeat = R.longest_repeat(log, "run_id", ["ts", "event_id"], F.when(F.col("status") == "FAILED", F.col("stage")))
    n = lambda c: F.count_if(c)
    counts = log.groupBy("run_id").agg(
        F.count("*").alias("attempted"),
        n(F.col("status") == "FAILED").alias("failed"),
        n(F.col("status") == "BLOCKED").alias("unknown"),
        n(F.col("stage") == "purchase").alias("problem"),
        n(F.col("stage") == "signup").alias("answer"),
        n(F.col("stage") == "click").alias("explanation"),
        F.median("value").alias("median_length"),
        n(F.col("event_id") % 13 == 0).alias("leaked"),
    )
    rows = counts.join(repeat, "run_id")
    return rows.select("run_id", "attempted", "failed", "longest", F.array_join(R.stop_reasons({c: F.col(c) for c in rows.columns}), ",").alias("reasons"))


@query("""WITH g AS (SELECT (l_orderkey * 7 + l_partkey) % 5 = 0 AS b, (l_orderkey * 7 + l_partkey) % 9 = 0 AS a, (l_partkey + l_linenumber) % 11 < 2 AS u FROM lineitem),
c AS (SELECT count(*) AS n, count_if(b) AS b, count_if(a) AS a, count_if(NOT b AND u) AS bu, count_if(NOT a AND u) AS au FROM g)
SELECT 'old' AS gate, n - b AS auto, b AS review, bu AS unsafe_auto, b - a AS review_reduction FROM c UNION ALL SELECT 'candidate', n - a, a, au, b - a FROM c""")
def gate_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An old and a new gate over all lines: what each holds back, and what it lets through wrongly."""
    k = F.col("l_orderkey") * 7 + F.col("l_partkey")
    return R.simulate_gates(table(spark, sf_dir, "lineitem"), k % 5 == 0, k % 9 == 0, (F.col("l_partkey") + F.col("l_linenumber")) % 11 < 2)


@query("""WITH v AS (SELECT l_suppkey AS book, CASE (l_orderkey + l_partkey) % 7 WHEN 0 THEN 'REVIEW_REQUIRED' WHEN 1 THEN 'BLOCKED' WHEN 2 THEN 'PAID_OCR_CANDIDATE' WHEN 3 THEN 'AUTO_SAFE' ELSE 'PASS_FALSE_POSITIVE' END AS verdict FROM lineitem),
c AS (SELECT book, count(*) AS start_review, count_if(verdict IN ('REVIEW_REQUIRED', 'BLOCKED', 'PAID_OCR_CANDIDATE')) AS human_remaining FROM v GROUP BY book)
SELECT *, round(CAST(start_review - human_remaining AS DOUBLE) / start_review * 100, 1) AS reduction_pct FROM c""")
def review_minimised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to people of each book's review, in per cent saved."""
    k = (F.col("l_orderkey") + F.col("l_partkey")) % 7
    verdict = F.when(k == 0, "REVIEW_REQUIRED").when(k == 1, "BLOCKED").when(k == 2, "PAID_OCR_CANDIDATE").when(k == 3, "AUTO_SAFE").otherwise("PASS_FALSE_POSITIVE")
    return R.review_reduction(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("book"), verdict.alias("verdict")), "book", "verdict")


@query(f"""WITH {BOXES_SQL}, s AS (SELECT page, item AS bar, y AS sy, h AS sh FROM boxes WHERE item = 1), o AS (SELECT s.page, bar, b.item AS owner, least(sy + sh, b.y + b.h) - greatest(sy, b.y) AS overlap FROM s JOIN boxes b ON s.page = b.page WHERE b.item > 1),
r AS (SELECT *, row_number() OVER (PARTITION BY page, bar ORDER BY overlap DESC, owner) AS nth FROM o WHERE overlap > 0.02),
t AS (SELECT page, bar, max(owner) FILTER (nth = 1) AS owner, max(overlap) AS overlap, COALESCE(max(overlap) FILTER (nth = 2) > max(overlap) * 0.7, FALSE) AS ambiguous FROM r GROUP BY page, bar)
SELECT s.page, s.bar, owner, COALESCE(overlap, 0.0) AS overlap, COALESCE(ambiguous, FALSE) AS ambiguous, owner IS NOT NULL AND NOT COALESCE(ambiguous, FALSE) AND COALESCE(overlap, 0.0) >= 0.08 AS auto_allowed FROM s LEFT JOIN t ON s.page = t.page AND s.bar = t.bar""")
def sidebar_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box that each page's side bar (its first box) stands beside."""
    every = boxes(spark, sf_dir)
    return R.sidebar_owners(every.where("item = 1").withColumnRenamed("item", "bar"), every.where("item > 1"))


@query("""WITH v AS (SELECT o_custkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version, CASE WHEN o_orderkey % 5 = 0 THEN 'DRAFT' ELSE 'OLD' END AS status, o_orderkey AS payload FROM orders),
q AS (SELECT c_custkey AS item, c_custkey % 4 + 1 AS version, CASE c_custkey % 3 WHEN 0 THEN 'FORK' WHEN 1 THEN 'RESTORE' ELSE 'DUPLICATE' END AS kind, c_custkey + 1000000 AS new_item FROM customer),
l AS (SELECT item, max(version) AS last, max(version) FILTER (status = 'DRAFT') AS draft FROM v GROUP BY item),
j AS (SELECT q.*, v.item IS NOT NULL AS there, v.item IS NOT NULL AND kind = 'FORK' AND draft IS NOT NULL AS d, v.payload AS p, last, draft FROM q LEFT JOIN v ON q.item = v.item AND q.version = v.version LEFT JOIN l ON q.item = l.item)
SELECT item, version, kind, CASE WHEN NOT there THEN 'MISSING' WHEN d THEN 'EXISTING' ELSE 'CREATE' END AS action, CASE WHEN there THEN CASE WHEN kind = 'DUPLICATE' THEN new_item ELSE item END END AS to_item,
  CASE WHEN d THEN draft WHEN there THEN CASE WHEN kind = 'DUPLICATE' THEN 1 ELSE last + 1 END END AS to_version, CASE WHEN there THEN CASE WHEN kind = 'RESTORE' THEN 'CURRENT' ELSE 'DRAFT' END END AS to_status, CASE WHEN there AND NOT d THEN p END AS payload FROM j""")
def version_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forks, restored versions and duplicates: one request for each customer, whose orders stand for versions."""
    nth = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    versions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item"), nth.alias("version"), F.when(F.col("o_orderkey") % 5 == 0, "DRAFT").otherwise("OLD").alias("status"), F.col("o_orderkey").alias("payload"))
    key = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select(key.alias("item"), (key % 4 + 1).alias("version"), F.when(key % 3 == 0, "FORK").when(key % 3 == 1, "RESTORE").otherwise("DUPLICATE").alias("kind"), (key + 1_000_000).alias("new_item"))
    return R.copy_versions(versions, asked)


@query("""WITH r AS (SELECT l_partkey AS a, l_suppkey AS b, CASE l_linenumber WHEN 1 THEN 'T1' WHEN 2 THEN 'T2' WHEN 3 THEN 'T3' WHEN 4 THEN 'RELATED' WHEN 5 THEN 'NOT_RELATED' WHEN 6 THEN 'T4' END AS level FROM lineitem),
m AS (SELECT *, count(*) OVER (PARTITION BY a, b) > 1 AS many FROM r), f AS (SELECT a, b, level, concat_ws(',', CASE WHEN NOT a < b THEN 'PAIR_ORDER' END, CASE WHEN level NOT IN ('T1', 'T2', 'T3', 'RELATED', 'NOT_RELATED') THEN 'LEVEL' END, CASE WHEN many THEN 'REPEATED_PAIR' END) AS faults FROM m)
SELECT * FROM f WHERE faults <> ''""")
def relation_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations between items (parts and suppliers of lines) that break a rule of verified twins."""
    n = F.col("l_linenumber")
    level = F.when(n <= 3, F.concat(F.lit("T"), n.cast("string"))).when(n == 4, "RELATED").when(n == 5, "NOT_RELATED").when(n == 6, "T4")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), level.alias("level"))
    return R.relation_faults(rows, "a", "b", "level").withColumn("faults", F.array_join("faults", ","))
