"""Listing, hierarchy, bundle and progress queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.cues import fixture_source
from ..operators import relational as R
from ..sources.tables import table
from ..sources.views import OUTLINE_SQL, PROBLEMS_SQL, REVIEW_LOG_SQL, outline, problems, review_log


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    return orders.select(F.concat(F.lit("C"), "o_custkey").alias("node_id"), F.col("o_orderkey").alias("item"))


@query(f"""WITH RECURSIVE {OUTLINE_SQL}, closure AS (
  SELECT id, id AS root, parent_id FROM outline
  UNION ALL SELECT c.id, o.id, o.parent_id FROM closure c JOIN outline o ON c.parent_id = o.id)
SELECT o.id, o.level, o.title, o.sort_order, COALESCE(n.items, 0) AS items FROM outline o LEFT JOIN (
  SELECT root, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS items FROM closure c JOIN orders ON c.id = 'C' || o_custkey WHERE o_orderstatus IN ('F', 'O') GROUP BY root) n ON o.id = n.root""")
def outline_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct open orders per region, nation and customer."""
    return R.outline_rollup(outline(spark, sf_dir), _assigned(spark, sf_dir))


@query(f"""WITH RECURSIVE {OUTLINE_SQL}, up AS (
  SELECT id, parent_id, CASE WHEN level = 'BOOK' THEN '' ELSE title END AS path FROM outline
  UNION ALL SELECT u.id, o.parent_id, o.title || ' > ' || u.path FROM up u JOIN outline o ON u.parent_id = o.id WHERE o.level <> 'BOOK')
SELECT id, arg_max(path, length(path)) AS path FROM up GROUP BY id""")
def outline_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles from the nation down."""
    return R.path_to_root(outline(spark, sf_dir))


@query(f"""WITH {OUTLINE_SQL}, s AS (
  SELECT id FROM outline WHERE id = 'R2' UNION SELECT id FROM outline WHERE parent_id = 'R2'
  UNION SELECT id FROM outline WHERE parent_id IN (SELECT id FROM outline WHERE parent_id = 'R2'))
SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE 'C' || o_custkey IN (SELECT id FROM s)""")
def semi_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders anywhere below one region."""
    ids = R.subtree(outline(spark, sf_dir), "R2").select(F.col("id").alias("node_id"))
    orders = table(spark, sf_dir, "orders").withColumn("node_id", F.concat(F.lit("C"), "o_custkey"))
    return orders.join(ids, "node_id", "left_semi").select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))


_LIST = """lifecycle IN ('DRAFT', 'ACTIVE') AND display_state = 'LISTED' AND is_fixture IS NOT TRUE"""
_BOOK = """COALESCE(page, 9999), COALESCE(TRY_CAST(regexp_replace(number, '[^0-9]', '', 'g') AS INTEGER), 999999), public_code"""


@query(f"WITH {PROBLEMS_SQL} SELECT doc_id, public_code, page, number, review_status FROM problems WHERE {_LIST} ORDER BY {_BOOK} LIMIT 50 OFFSET 50")
def list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of the list in book order (a page is what this query returns)."""
    return R.list_problems(problems(spark, sf_dir), page=2)[0].select("doc_id", "public_code", "page", "number", "review_status")


@query(f"WITH {PROBLEMS_SQL} SELECT CAST(count(*) AS BIGINT) AS total FROM problems WHERE {_LIST} AND review_status = 'VERIFIED' AND page >= 20 AND page <= 120 AND (public_code ILIKE '%the%' OR text ILIKE '%the%' OR number ILIKE '%the%')")
def list_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total of several filters together."""
    return R.list_problems(problems(spark, sf_dir), query="the", review_status="VERIFIED", page_from=20, page_to=120)[1]


@query(f"WITH {PROBLEMS_SQL} SELECT doc_id, public_code, lifecycle FROM problems WHERE lifecycle = 'ARCHIVED' AND is_fixture IS NOT TRUE ORDER BY doc_id DESC, public_code LIMIT 100")
def trash_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of archived problems, newest first (a page is what this query returns)."""
    return R.list_problems(problems(spark, sf_dir), trash=True, page_size=100, sort="updated")[0].select("doc_id", "public_code", "lifecycle")


@query(f"""WITH {PROBLEMS_SQL} SELECT p.doc_id, p.public_code, p.source, p.page FROM problems p
WHERE review_status = 'NEEDS_REVIEW' AND lifecycle IN ('DRAFT', 'ACTIVE') ORDER BY source, page NULLS LAST, doc_id LIMIT 200""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 problems to review, in a defined order (the limit is part of the queue)."""
    rows = problems(spark, sf_dir).where((F.col("review_status") == "NEEDS_REVIEW") & F.col("lifecycle").isin("DRAFT", "ACTIVE"))
    return rows.orderBy("source", F.col("page").asc_nulls_last(), "doc_id").limit(200).select("doc_id", "public_code", "source", "page")


@query(f"""WITH {PROBLEMS_SQL}, s AS (SELECT source, CAST(count(DISTINCT doc_id) AS BIGINT) AS linked,
  CAST(count(DISTINCT CASE WHEN lifecycle IN ('DRAFT', 'ACTIVE') AND display_state = 'LISTED' THEN doc_id END) AS BIGINT) AS listed, CAST(count(DISTINCT page) AS BIGINT) AS pages,
  CAST(count(*) FILTER (review_status = 'AUTO_CLASSIFIED') AS BIGINT) AS auto_classified, CAST(count(*) FILTER (review_status = 'NEEDS_REVIEW' AND lifecycle IN ('DRAFT', 'ACTIVE')) AS BIGINT) AS needs_review,
  CAST(count(*) FILTER (review_status = 'VERIFIED') AS BIGINT) AS verified FROM problems GROUP BY source)
SELECT *, pages AS ocr_pages, CASE WHEN linked > 0 AND needs_review > 0 THEN 'REVIEW_REQUIRED' WHEN linked > 0 THEN 'COMPLETED' ELSE 'PENDING' END AS status FROM s""")
def source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and status of each source."""
    return R.source_stats(problems(spark, sf_dir))


@query(f"""WITH {REVIEW_LOG_SQL}, s AS (SELECT run_id, candidate_id, arg_max(status, (ts, event_id)) AS status FROM review_log GROUP BY ALL)
SELECT run_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (status = 'AUTO_APPROVED') AS BIGINT) AS auto_approved, CAST(count(*) FILTER (status = 'AI_FIXED') AS BIGINT) AS ai_fixed,
  CAST(count(*) FILTER (status = 'HUMAN_REVIEW') AS BIGINT) AS human_review, CAST(count(*) FILTER (status = 'BLOCKED') AS BIGINT) AS blocked, CAST(count(*) FILTER (status = 'FAILED') AS BIGINT) AS failed,
  CAST(count(*) FILTER (status <> 'AUTO_APPROVED') AS BIGINT) AS unresolved FROM s GROUP BY run_id""")
def progress_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of each run over the latest state of its candidates."""
    states = R.latest(review_log(spark, sf_dir).select("run_id", "candidate_id", "status", "ts", "event_id"), ["run_id", "candidate_id"], ["ts", "event_id"])
    return R.progress(states)


@query(f"WITH {REVIEW_LOG_SQL} SELECT run_id, stage, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(status, (ts, event_id)) AS status, round(arg_max(value, (ts, event_id)), 6) AS value FROM review_log GROUP BY run_id, stage")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each run and stage."""
    rows = review_log(spark, sf_dir).select("run_id", "stage", "event_id", "status", "value", "ts")
    return R.latest(rows, ["run_id", "stage"], ["ts", "event_id"]).select("run_id", "stage", "event_id", "status", F.round("value", 6).alias("value"))


@query("""SELECT o_orderkey, o_custkey, CAST(len(lines) AS BIGINT) AS n_lines, CAST(lines[1].l_linenumber AS BIGINT) AS first_line, CAST(list_sum(list_transform(lines, lambda x: CAST(x.l_quantity AS BIGINT))) AS BIGINT) AS quantity, lines[1].l_partkey AS first_part FROM (
  SELECT o_orderkey, o_custkey, COALESCE(lines, []) AS lines FROM orders LEFT JOIN (
    SELECT l_orderkey, list({'l_linenumber': l_linenumber, 'l_partkey': l_partkey, 'l_quantity': l_quantity} ORDER BY l_linenumber, l_partkey) AS lines FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)""")
def bundle_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as one sorted array, read back through array functions."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    out = R.bundle(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", {"lines": (lines, ["l_linenumber", "l_partkey", "l_quantity"], ["l_linenumber", "l_partkey"])})
    total = F.when(F.size("lines") > 0, F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + x["l_quantity"].cast("long")))
    first = F.get("lines", F.lit(0))
    return out.select("o_orderkey", "o_custkey", F.size("lines").cast("long").alias("n_lines"), first["l_linenumber"].cast("long").alias("first_line"), total.alias("quantity"), first["l_partkey"].alias("first_part"))


@query("""SELECT c_custkey, o_orderkey, o_orderdate FROM (SELECT c_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderstatus = 'F' DESC, o_orderdate, o_orderkey) AS n
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey) WHERE n = 1""")
def lateral_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer one order: finished ones first, then the oldest."""
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return R.top_one(joined.select("c_custkey", "o_orderkey", "o_orderdate", "o_orderstatus"), ["c_custkey"], [(F.col("o_orderstatus") == "F").desc(), F.col("o_orderdate"), F.col("o_orderkey")]).drop("o_orderstatus")


@query("""SELECT s.s_suppkey, n.n_name, (SELECT p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey = s.s_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, p_partkey LIMIT 1) AS dearest_part
FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey""")
def scalar_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per supplier the part of its dearest line; the order is complete, so the row is defined."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_extendedprice", "l_orderkey", "l_linenumber")
    best = lines.groupBy("l_suppkey").agg(F.max_by("l_partkey", F.struct("l_extendedprice", (-F.col("l_orderkey")).alias("o"), (-F.col("l_linenumber")).alias("l"), (-F.col("l_partkey")).alias("p"))).alias("p_partkey"))
    named = best.join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", "left")
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return s.join(named, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", "n_name", F.col("p_name").alias("dearest_part"))


@query("""SELECT o.o_orderkey, o.o_orderpriority, c.c_name, n.n_name, r.r_name, CAST(count(l.l_linenumber) AS BIGINT) AS n_lines, round(sum(l.l_extendedprice * (1 - l.l_discount)), 4) AS revenue
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_linestatus = 'F' GROUP BY ALL""")
def star_left_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of left joins whose filter stands in the join condition, so no row is lost; lines are aggregated before they join."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    lines = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").groupBy("l_orderkey").agg(F.count("l_linenumber").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return joined.select("o_orderkey", "o_orderpriority", "c_name", "n_name", "r_name", F.coalesce("n", F.lit(0)).alias("n_lines"), "revenue")


@query("""SELECT CAST(count(*) AS BIGINT) AS documents, CAST(count(*) FILTER (lang = 'en') AS BIGINT) AS english, CAST(count(*) FILTER (n_chars > 1000) AS BIGINT) AS long_ones FROM documents""")
def exact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact counts by equality, in one pass."""
    d = table(spark, sf_dir, "documents")
    return d.agg(F.count("*").alias("documents"), F.count_if(F.col("lang") == "en").alias("english"), F.count_if(F.col("n_chars") > 1000).alias("long_ones"))


@query("""SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def exists_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with pending orders and none above a price: a semi and an anti join."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    return c.join(o.where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").join(o.where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, NULLIF(event_type, 'view') AS kind FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) IS DISTINCT FROM 7""")
def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths into JSON, empty values to null, and a null-safe comparison."""
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.nullif(F.col("event_type"), F.lit("view")).alias("kind"))
    return e.where(~F.col("k").eqNullSafe(F.lit(7)))


@query(f"""WITH {PROBLEMS_SQL} SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (is_fixture IS NOT TRUE) AS BIGINT) AS not_fixture, CAST(count(*) FILTER (is_fixture) AS BIGINT) AS fixture FROM problems GROUP BY source""")
def tri_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown fixtures count as none."""
    return problems(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.count_if(R.not_true(F.col("is_fixture"))).alias("not_fixture"), F.count_if(F.col("is_fixture")).alias("fixture"))


@query("""SELECT COALESCE(a.l_partkey, b.l_partkey) AS l_partkey, CASE WHEN a.l_partkey IS NULL THEN 'only_n' WHEN b.l_partkey IS NULL THEN 'only_r' ELSE 'both' END AS side
FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R') a FULL JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'N') b ON a.l_partkey = b.l_partkey""")
def set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts returned, not returned, or both."""
    line = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("R", "N"))
    both = line.groupBy("l_partkey").agg(F.max(F.col("l_returnflag") == "R").alias("r"), F.max(F.col("l_returnflag") == "N").alias("n"))
    return both.select("l_partkey", F.when(F.col("r") & F.col("n"), "both").when(F.col("r"), "only_r").otherwise("only_n").alias("side"))


@query("""SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3)) AND s_acctbal > 0 AND s_name ILIKE '%0%'""")
def in_list_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup by ids of another table, with filters that reach the scan."""
    n = table(spark, sf_dir, "nation").where(F.col("n_regionkey").isin(1, 3))
    s = table(spark, sf_dir, "supplier").where((F.col("s_acctbal") > 0) & F.col("s_name").ilike("%0%"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey", "s_name")


@query(r"""WITH s AS (SELECT doc_id, source AS title, CASE doc_id % 9 WHEN 0 THEN 'Regression' WHEN 1 THEN 'step  7' WHEN 2 THEN lang WHEN 3 THEN NULL ELSE left(text, strpos(text, '.')) END AS filename, CASE doc_id % 14 WHEN 5 THEN 'do not' WHEN 6 THEN 'DO NOT USE' END AS kind FROM documents)
SELECT doc_id, regexp_matches(COALESCE(title, '') || ' ' || COALESCE(filename, '') || ' ' || COALESCE(kind, ''), '(?i)STEP\s*\d|fixture|regression|Internal STEP|Production UI Test|do not use') AS fixture FROM s""")
def fixture_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents' sources are only for tests, by title, file name and kind."""
    k = F.col("doc_id")
    name = F.when(k % 9 == 0, "Regression").when(k % 9 == 1, "step  7").when(k % 9 == 2, F.col("lang")).when(k % 9 != 3, F.expr("left(text, locate('.', text))"))
    kind = F.when(k % 14 == 5, "do not").when(k % 14 == 6, "DO NOT USE")
    return table(spark, sf_dir, "documents").select("doc_id", fixture_source(F.col("source"), name, kind).alias("fixture"))
