"""Upsert, version and checkpoint plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import plans as P
from ..catalog import query
from ..sources.tables import table
from ..sources.views import PROBLEMS_SQL, problems

_CANON = "CASE WHEN regexp_matches(regexp_replace(number, '\\.$', ''), '^[0-9]{1,4}$') THEN lpad(regexp_replace(number, '\\.$', ''), 4, '0') END"


@query(f"""WITH {PROBLEMS_SQL}, k AS (SELECT doc_id, source, page, {_CANON} AS c, review_status = 'VERIFIED' AS verified FROM problems), i AS (SELECT *, source || '|' || page || '|' || c AS identity FROM k WHERE page IS NOT NULL AND c IS NOT NULL),
o AS (SELECT identity, arg_min(doc_id, (NOT verified, doc_id)) AS existing, arg_min(verified, (NOT verified, doc_id)) AS v FROM i WHERE doc_id % 3 = 0 GROUP BY identity)
SELECT n.identity, CASE WHEN o.existing IS NULL THEN 'CREATED' WHEN v THEN 'EXISTING_VERIFIED' ELSE 'EXISTING_DRAFT' END AS action, o.existing FROM (SELECT DISTINCT identity FROM i) n LEFT JOIN o USING (identity)""")
def identity_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What drafts would be created, and which exist (every third row is stored)."""
    p = problems(spark, sf_dir).select(F.col("source").alias("doc"), "page", "number", F.col("doc_id").alias("problem_id"), (F.col("review_status") == "VERIFIED").alias("verified"), F.col("doc_id").alias("created"))
    return P.identity_upsert(p, p.where("problem_id % 3 = 0"))


@query("""WITH n AS (SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS price FROM orders), s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS st, price AS pr, o_orderkey % 2 = 0 AS prot FROM n WHERE o_orderkey % 5 <> 0)
SELECT n.*, CASE WHEN s.o_orderkey IS NULL THEN 'CREATE' WHEN n.o_orderstatus IS NOT DISTINCT FROM s.st AND n.price IS NOT DISTINCT FROM s.pr THEN 'SKIP' WHEN prot THEN 'BLOCKED' ELSE 'UPDATE' END AS action FROM n LEFT JOIN s ON n.o_orderkey = s.o_orderkey""")
def upsert_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create, update, skip or block, by key."""
    n = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("price"))
    s = n.where("o_orderkey % 5 != 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    return P.merge_plan(n, s, ["o_orderkey"], ["o_orderstatus", "price"], F.col("o_orderkey") % 2 == 0)


@query("""WITH v AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 1 THEN 'TEACHER' ELSE 'BOOK' END AS origin, conv_id % 7 = 0 AS verified FROM conversations WHERE conv_id % 5 <> 0), l AS (SELECT conv_id, max(turn) AS n, arg_max(text, turn) AS t, arg_max(origin, turn) AS o, arg_max(verified, turn) AS vf FROM v GROUP BY conv_id),
e AS (SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN arg_max(text, turn) WHEN conv_id % 11 = 0 THEN ' ' ELSE 'edit ' || conv_id END AS new_text FROM conversations GROUP BY conv_id),
a AS (SELECT e.conv_id, l.n, CASE WHEN l.conv_id IS NULL THEN 'SKIP_MISSING' WHEN o = 'TEACHER' THEN 'SKIP_TEACHER' WHEN vf THEN 'SKIP_VERIFIED' WHEN trim(COALESCE(new_text, '')) = '' THEN 'SKIP_BLANK' WHEN new_text IS NOT DISTINCT FROM t THEN 'SKIP_UNCHANGED' ELSE 'APPEND' END AS action FROM e LEFT JOIN l ON e.conv_id = l.conv_id)
SELECT conv_id, action, CASE WHEN action = 'APPEND' THEN n + 1 END AS version_no, CASE WHEN action = 'APPEND' THEN 'AUTO_CLEAN' END AS origin FROM a""")
def version_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which edits append a version, and why others do not."""
    c = table(spark, sf_dir, "conversations")
    v = c.where("conv_id % 5 != 0").select("conv_id", F.col("turn").alias("version_no"), "text", F.when(F.col("turn") % 3 == 1, "TEACHER").otherwise("BOOK").alias("origin"), (F.col("conv_id") % 7 == 0).alias("verified"))
    last = c.groupBy("conv_id").agg(F.max_by("text", "turn").alias("t"))
    k = F.col("conv_id")
    edits = last.select("conv_id", F.when(k % 4 == 0, F.col("t")).when(k % 11 == 0, " ").otherwise(F.concat(F.lit("edit "), k.cast("string"))).alias("new_text"))
    return P.append_versions(v, edits, "conv_id", "text")


@query("""WITH n AS (SELECT page_id AS page, sha256(html) AS digest FROM pages), d AS (SELECT page, CASE WHEN page % 4 = 1 THEN 'old' ELSE digest END AS digest FROM n WHERE page % 3 <> 0), o AS (SELECT n.* FROM n LEFT JOIN d ON n.page = d.page WHERE n.digest IS DISTINCT FROM d.digest),
h AS (SELECT *, page % 5 = 0 AS c FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY page) AS k FROM h) SELECT page, digest, CASE WHEN c THEN 'CACHE_HIT' WHEN round(k * 0.005, 6) <= 0.1 THEN 'OCR' ELSE 'OVER_CAP' END AS action FROM r""")
def checkpoint_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a rerun has to read, from the cache or as the money lasts."""
    n = table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.sha2("html", 256).alias("digest"))
    done = n.where("page % 3 != 0").withColumn("digest", F.when(F.col("page") % 4 == 1, "old").otherwise(F.col("digest")))
    return P.pages_to_do(n, done, n.where("page % 5 = 0"), cap=0.1)


@query("""WITH o AS (SELECT doc_id, text FROM documents), v AS (SELECT doc_id, 'new ' || doc_id AS nt, CASE WHEN doc_id % 4 = 0 THEN 'moved' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 3 = 0) SELECT o.doc_id, sha256(CASE WHEN COALESCE(v.h = sha256(o.text), FALSE) THEN v.nt ELSE o.text END) AS text, COALESCE(v.h = sha256(o.text), FALSE) AS overridden FROM o LEFT JOIN v ON o.doc_id = v.doc_id""")
def apply_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides that still fit their row."""
    o = table(spark, sf_dir, "documents").select("doc_id", "text")
    k = F.col("doc_id")
    over = o.where("doc_id % 3 = 0").select("doc_id", F.when(k % 4 == 0, "moved").otherwise(F.sha2("text", 256)).alias("expected_hash"), F.concat(F.lit("new "), k.cast("string")).alias("text"))
    return P.apply_overrides(o, over, "doc_id", "text").withColumn("text", F.sha2("text", 256))


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN NOT COALESCE(p_size BETWEEN 1 AND 45, FALSE) THEN 'SIZE' END, CASE WHEN NOT COALESCE(p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22'), FALSE) THEN 'BRAND' END], lambda x: x IS NOT NULL), ',') AS problems FROM part
WHERE NOT COALESCE(p_size BETWEEN 1 AND 45, FALSE) OR NOT COALESCE(p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22'), FALSE)""")
def constraint_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows outside the domains of their columns."""
    p = table(spark, sf_dir, "part")
    found = P.validate(p, "p_partkey", {"SIZE": F.col("p_size").between(1, 45), "BRAND": F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22")})
    return found.withColumn("problems", F.array_join("problems", ","))


@query("""SELECT conv_id, CAST(generate_subscripts(p, 1) AS BIGINT) AS ordinal, unnest(p) AS line FROM (SELECT conv_id, string_split(string_agg(role, ',' ORDER BY turn), ',') AS p FROM conversations GROUP BY conv_id)""")
def child_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array elements as numbered child rows."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("p"))
    return P.replace_children(c, "conv_id", "p", "line")


@query("""WITH d AS (SELECT user_id, list(DISTINCT event_type) AS had FROM events WHERE event_id % 3 = 0 GROUP BY user_id), u AS (SELECT DISTINCT user_id FROM events)
SELECT u.user_id AS run_id, list_filter(['view', 'click', 'signup', 'purchase', 'error'], lambda s: NOT list_contains(COALESCE(d.had, []), s))[1] AS next FROM u LEFT JOIN d ON u.user_id = d.user_id""")
def next_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first stage that each run has still to do (a third of events are done)."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), "event_id")
    return P.next_stage(e, e.where("event_id % 3 = 0"), ["view", "click", "signup", "purchase", "error"])
