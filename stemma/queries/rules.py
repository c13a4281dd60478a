"""Gates, judges and routers over evidence that is dealt to the driver's rows by arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import rules as U
from ..sources.tables import table


def _k() -> Column:
    return F.col("l_orderkey") * 7 + F.col("l_partkey") * 3 + F.col("l_linenumber")


_KS = "(l_orderkey * 7 + l_partkey * 3 + l_linenumber)"


def _conf(step: int, low: float = 0.4) -> Column:
    return low + (_k() * step % 60) / 100.0


def _conf_sql(step: int, low: float = 0.4) -> str:
    return f"({low} + CAST({_KS} * {step} % 60 AS DOUBLE) / 100.0)"


def _flag(step: int, every: int) -> Column:
    return _k() * step % every == 0


def _flag_sql(step: int, every: int) -> str:
    return f"({_KS} * {step} % {every} = 0)"


_KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]
_GATE_SQL = f"""CASE WHEN {_flag_sql(3, 41)} THEN 'HUMAN_REVIEW' WHEN {_flag_sql(5, 37)} OR {_flag_sql(7, 43)} THEN 'BLOCKED' WHEN {_conf_sql(11)} < 0.5 THEN 'BLOCKED' WHEN NOT NOT {_flag_sql(13, 17)} AND NOT NOT {_flag_sql(17, 5)} THEN 'BLOCKED'
 WHEN NOT NOT {_flag_sql(13, 17)} THEN 'HUMAN_REVIEW' WHEN {_flag_sql(19, 29)} THEN 'BLOCKED' WHEN {_flag_sql(23, 31)} THEN 'HUMAN_REVIEW' WHEN {_conf_sql(29)} < 0.85 THEN 'HUMAN_REVIEW' WHEN {_conf_sql(11)} < 0.78 OR {_conf_sql(31)} < 0.78 THEN 'HUMAN_REVIEW'
 WHEN {_conf_sql(37)} < 0.78 OR {_conf_sql(41)} < 0.78 THEN 'HUMAN_REVIEW' ELSE 'AUTO_APPROVED' END"""


@query(f"""WITH g AS (SELECT {', '.join(_KEYS)}, {_GATE_SQL} AS verdict FROM lineitem) SELECT *, CASE WHEN verdict = 'AUTO_APPROVED' THEN 'AUTO_CLASSIFIED' WHEN verdict = 'HUMAN_REVIEW' THEN 'NEEDS_REVIEW' END AS review_status, verdict <> 'AUTO_APPROVED' AS queued FROM g""")
def confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the ordered gate, and what becomes of the draft."""
    e = {"math_conflict": _flag(3, 41), "neighbour_blocking": _flag(5, 37), "crop_unsafe": _flag(7, 43), "identity": _conf(11), "ingested": ~_flag(13, 17), "has_stem": ~_flag(17, 5), "paid_ocr": _flag(19, 29), "compare_fail": _flag(23, 31), "figure": _conf(29), "structure": _conf(31), "checker_a": _conf(37), "checker_b": _conf(41)}
    rows = table(spark, sf_dir, "lineitem").select(*_KEYS, U.confidence_gate(e)["verdict"].alias("verdict"))
    state = U.lifecycle_of(F.col("verdict"))
    return rows.select(*_KEYS, "verdict", state["review_status"].alias("review_status"), state["queued"].alias("queued"))


@query(f"""WITH j AS (SELECT {', '.join(_KEYS)}, list_filter([CASE WHEN {_flag_sql(3, 9)} THEN 'IDENTITY' END, CASE WHEN {_flag_sql(5, 11)} THEN 'CROP' END, CASE WHEN {_flag_sql(7, 13)} THEN 'DUPLICATE' END, CASE WHEN {_conf_sql(11, 0.55)} < 0.7 THEN 'TYPE_CONFIDENCE' END,
  CASE WHEN {_conf_sql(13, 0.55)} < 0.8 THEN 'UNIT_CONFIDENCE' END, CASE WHEN {_conf_sql(17, 0.0)} >= 0.25 THEN 'BBOX_INTRUSION' END], lambda x: x IS NOT NULL) AS r FROM lineitem) SELECT {', '.join(_KEYS)}, len(r) = 0 AS passed, array_to_string(r, ',') AS residuals FROM j""")
def qa_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each item fails, and whether it passes."""
    verdict = U.qa_judge({"IDENTITY": _flag(3, 9), "CROP": _flag(5, 11), "DUPLICATE": _flag(7, 13)}, _conf(11, 0.55), _conf(13, 0.55), _conf(17, 0.0))
    return table(spark, sf_dir, "lineitem").select(*_KEYS, verdict.alias("v")).select(*_KEYS, "v.passed", F.array_join("v.residuals", ",").alias("residuals"))


@query(f"""SELECT {', '.join(_KEYS)}, CASE WHEN {_flag_sql(3, 15)} OR {_conf_sql(5, 0.3)} > 0.85 THEN 'UNSAFE' WHEN {_flag_sql(7, 6)} OR {_flag_sql(11, 14)} THEN 'REVIEW' ELSE 'SAFE' END AS crop FROM lineitem""")
def crop_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe, to be reviewed or unsafe crops."""
    return table(spark, sf_dir, "lineitem").select(*_KEYS, U.crop_gate([_flag(3, 15), _conf(5, 0.3) > 0.85], [_flag(7, 6)], ~_flag(11, 14)).alias("crop"))


@query(f"""WITH v AS (SELECT {', '.join(_KEYS)}, {_flag_sql(3, 19)} AS failed, CASE WHEN {_flag_sql(5, 4)} THEN 1 ELSE 0 END AS critical, CASE WHEN NOT {_flag_sql(7, 10)} THEN {_conf_sql(11, 0.3)} END AS hit, CASE WHEN NOT {_flag_sql(13, 3)} THEN {_conf_sql(17, 0.3)} END AS korean FROM lineitem),
h AS (SELECT *, CASE WHEN hit IS NULL THEN CASE WHEN failed THEN 0.0 ELSE 0.5 END ELSE hit END AS h2 FROM v),
o AS (SELECT *, CASE WHEN NOT failed AND critical = 0 AND h2 >= 0.75 AND (korean IS NULL OR korean >= 0.7) THEN 'GREEN' WHEN NOT failed AND critical = 0 AND (h2 >= 0.4 OR COALESCE(korean, 0) >= 0.5) THEN 'YELLOW' ELSE 'RED' END AS verdict FROM h)
SELECT {', '.join(_KEYS)}, verdict, CASE WHEN verdict = 'GREEN' AND critical = 0 THEN 'NONE' WHEN verdict = 'YELLOW' AND critical = 0 THEN 'LIGHT' WHEN critical <= 2 AND COALESCE(korean, 1) >= 0.5 THEN 'HEAVY' ELSE 'RETYPE' END AS burden FROM o""")
def ocr_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on readings, and how much is to be corrected."""
    failed, critical = _flag(3, 19), F.when(_flag(5, 4), 1).otherwise(0)
    hit, korean = F.when(~_flag(7, 10), _conf(11, 0.3)), F.when(~_flag(13, 3), _conf(17, 0.3))
    rows = table(spark, sf_dir, "lineitem").select(*_KEYS, critical.alias("critical"), korean.alias("korean"), U.ocr_verdict(failed, critical, hit, korean).alias("verdict"))
    return rows.select(*_KEYS, "verdict", U.burden(F.col("verdict"), F.col("critical"), F.col("korean")).alias("burden"))


@query(f"""SELECT {', '.join(_KEYS)}, least({_conf_sql(3, 0.6)}, {_conf_sql(5, 0.7)}, {_conf_sql(7, 0.6)}, {_conf_sql(11, 0.7)}) >= 0.78 AS agree, round(greatest(abs({_conf_sql(3, 0.6)} - {_conf_sql(7, 0.6)}), abs({_conf_sql(5, 0.7)} - {_conf_sql(11, 0.7)})), 6) AS widest FROM lineitem""")
def checker_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two checkers on two fields."""
    v = U.agreement([_conf(3, 0.6), _conf(5, 0.7)], [_conf(7, 0.6), _conf(11, 0.7)])
    return table(spark, sf_dir, "lineitem").select(*_KEYS, v["agree"].alias("agree"), F.round(v["widest"], 6).alias("widest"))


@query("""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 9 < 4 THEN 200 WHEN event_id % 9 = 4 THEN 429 WHEN event_id % 9 = 5 THEN 503 ELSE 400 + event_id % 9 END AS status, CASE WHEN event_id % 9 IN (0, 4, 5) THEN 'RETRY' WHEN event_id % 9 < 4 THEN 'OK' ELSE 'FATAL' END AS class FROM events""")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which failures are tried again."""
    k = F.col("event_id") % 9
    status = F.when(k == 0, F.lit(None).cast("long")).when(k < 4, 200).when(k == 4, 429).when(k == 5, 503).otherwise(400 + k).cast("long")
    return table(spark, sf_dir, "events").select("event_id", status.alias("status")).withColumn("class", U.error_class(F.col("status")))


def _label(step: int, every: int) -> Column:
    return F.when(_k() * step % every != 0, F.concat(F.lit("T"), (_k() * step % 3).cast("string")))


def _label_sql(step: int, every: int) -> str:
    return f"CASE WHEN {_KS} * {step} % {every} <> 0 THEN 'T' || ({_KS} * {step} % 3) END"


@query(f"""WITH e AS (SELECT {', '.join(_KEYS)}, {_label_sql(5, 4)} AS content, {_label_sql(7, 5)} AS source, {_label_sql(11, 3)} AS cluster, {_label_sql(13, 2)} AS section, {_label_sql(17, 7)} AS ai, {_flag_sql(19, 6)} AS cached, {_flag_sql(23, 2)} AS fp FROM lineitem),
t AS (SELECT *, CASE WHEN cached AND (COALESCE(content, source, cluster) IS NOT NULL OR fp) THEN 1 WHEN cluster = section AND (content IS NULL OR content = cluster) THEN 2 WHEN cluster <> content AND (ai = cluster OR ai = content) THEN 3 WHEN content = source THEN 4 WHEN content = ai THEN 5 WHEN COALESCE(content, cluster, section) IS NOT NULL AND fp THEN 6 ELSE 7 END AS k FROM e)
SELECT {', '.join(_KEYS)}, CASE k WHEN 1 THEN COALESCE(content, source, cluster, ai) WHEN 2 THEN cluster WHEN 3 THEN ai WHEN 4 THEN source WHEN 5 THEN ai WHEN 6 THEN COALESCE(content, cluster, section) ELSE COALESCE(content, cluster, section, ai) END AS type,
  CASE k WHEN 1 THEN 'SOURCE_CONFIRMED' WHEN 2 THEN 'CLUSTER_CONFIRMED' WHEN 3 THEN 'AI_CONFIRMED' WHEN 4 THEN 'SOURCE_CONFIRMED' WHEN 5 THEN 'AI_CONFIRMED' WHEN 6 THEN 'CLUSTER_CONFIRMED' ELSE 'LOW_CONFIDENCE_REVIEW' END AS by FROM t""")
def type_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which candidate type counts, and why."""
    v = U.confirm_type(_label(5, 4), _label(7, 5), _label(11, 3), _label(13, 2), _label(17, 7), _flag(19, 6), _flag(23, 2))
    return table(spark, sf_dir, "lineitem").select(*_KEYS, v["type"].alias("type"), v["by"].alias("by"))


@query("""SELECT page_id, CASE WHEN length(html) > 4000 THEN 'PAID' WHEN page_id % 4 = 0 THEN 'CACHED' WHEN length(html) < 500 THEN 'SKIP' ELSE 'LOCAL' END AS route FROM pages""")
def router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where pages go, by ordered evidence."""
    rules = [(F.length("html") > 4000, "PAID", "LARGE"), (F.col("page_id") % 4 == 0, "CACHED", "SEEN"), (F.length("html") < 500, "SKIP", "SMALL")]
    return table(spark, sf_dir, "pages").select("page_id", U.decide(rules, "LOCAL")["verdict"].alias("route"))


@query(f"""SELECT {', '.join(_KEYS)}, round(CASE WHEN {_flag_sql(3, 7)} THEN {_conf_sql(5, 0.3)} ELSE greatest({_conf_sql(5, 0.3)}, least(CAST(0.93 AS DOUBLE), {_conf_sql(5, 0.3)} + CASE WHEN {_flag_sql(11, 2)} THEN 0.1 ELSE 0 END + CASE WHEN {_flag_sql(13, 3)} THEN 0.08 ELSE 0 END + CASE WHEN {_flag_sql(17, 5)} THEN 0.04 ELSE 0 END)) END, 6) AS strong,
  list_filter([CASE WHEN NOT {_flag_sql(11, 2)} THEN 'CROP' END, CASE WHEN NOT {_flag_sql(13, 3)} THEN 'OWNER' END], lambda x: x IS NOT NULL) = [] AS safe FROM lineitem""")
def strengthened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidences raised by evidence, and whether all gates hold."""
    strong = U.strengthen(_conf(5, 0.3), [(_flag(11, 2), 0.1), (_flag(13, 3), 0.08), (_flag(17, 5), 0.04)], _flag(3, 7))
    return table(spark, sf_dir, "lineitem").select(*_KEYS, F.round(strong, 6).alias("strong"), U.all_hold({"CROP": _flag(11, 2), "OWNER": _flag(13, 3)})["safe"].alias("safe"))


@query("""WITH h AS (SELECT source, count(*) FILTER (n_chars < 300) AS hits, count(DISTINCT doc_id % 7) FILTER (n_chars < 300) AS pages FROM documents GROUP BY source) SELECT source, CAST(hits AS BIGINT) AS hits, CAST(CASE WHEN hits >= 6 AND pages >= 3 THEN 0.9 WHEN hits >= 8 THEN 0.72 WHEN hits > 0 THEN 0.4 ELSE 0.15 END AS DOUBLE) AS confidence FROM h""")
def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure a label is for each source, by hits and pages."""
    short = F.col("n_chars") < 300
    h = table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(short).alias("hits"), F.countDistinct(F.when(short, F.col("doc_id") % 7)).alias("pages"))
    return h.select("source", "hits", U.label_confidence(F.col("hits"), F.col("pages")).alias("confidence"))


@query("""WITH e AS (SELECT o_orderkey, CASE WHEN o_custkey % 4 > 0 THEN 'U' || o_custkey % 3 END AS hu, CASE WHEN o_orderkey % 3 > 0 THEN 'U' || o_orderkey % 2 END AS cu, CASE WHEN o_custkey % 5 > 1 THEN 'T' || o_custkey % 2 END AS ht, CASE WHEN o_orderkey % 7 > 2 THEN 'T' || o_orderkey % 2 END AS ct, o_custkey % 6 > 0 AS known, (o_orderkey % 10) / 10.0 AS d FROM orders),
c AS (SELECT *, CASE WHEN hu <> cu THEN 0.2 WHEN hu = cu THEN 0.96 WHEN hu IS NOT NULL THEN 0.88 WHEN cu IS NOT NULL THEN 0.55 ELSE 0.35 END AS us, CASE WHEN ht <> ct THEN 0.48 WHEN ht = ct THEN 0.92 WHEN ht IS NOT NULL THEN 0.8 WHEN ct IS NOT NULL THEN 0.62 ELSE 0.3 END AS ts FROM e)
SELECT o_orderkey, COALESCE(cu, hu) AS unit, CAST(us AS DOUBLE) AS unit_confidence, COALESCE(ct, ht, 'TYPE_UNCLEAR') AS type, CAST(ts AS DOUBLE) AS type_confidence, CAST(CASE WHEN known THEN 0.82 ELSE 0.2 END AS DOUBLE) AS key_point_confidence, us >= 0.5 AS unit_auto, ts >= 0.6 AS type_auto, d >= 0.5 AS difficulty_auto, us >= 0.5 AND ts >= 0.6 AS auto,
  array_to_string(list_filter([CASE WHEN hu <> cu THEN 'UNIT_CONFLICT' END, CASE WHEN ht IS NULL AND ct IS NOT NULL THEN 'TYPE_FROM_STEM_ONLY' END, CASE WHEN ht <> ct THEN 'TYPE_HEADING_STEM_MISMATCH' END, CASE WHEN ht IS NULL AND ct IS NULL THEN 'TYPE_UNCLEAR' END, CASE WHEN NOT known THEN 'KEY_POINT_REVIEW' END], lambda x: x IS NOT NULL), ',') AS reasons FROM c""")
def draft_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First classifications by what headings and texts say, and which of them need review."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    name = lambda letter, n: F.concat(F.lit(letter), n)
    e = {"heading_unit": F.when(c % 4 > 0, name("U", c % 3)), "content_unit": F.when(o % 3 > 0, name("U", o % 2)), "heading_type": F.when(c % 5 > 1, name("T", c % 2)), "content_type": F.when(o % 7 > 2, name("T", o % 2)), "key_point": F.when(c % 6 > 0, "known").otherwise("REVIEW"), "difficulty": (o % 10) / 10.0}
    rows = table(spark, sf_dir, "orders").select("o_orderkey", U.draft_class(e, 0.5, 0.6, 0.5).alias("v")).select("o_orderkey", "v.*")
    return rows.withColumn("reasons", F.array_join("reasons", ","))
