"""Cues of short texts, readings against the truth, caches and homes of numbers, and gates of figures and drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import cues as C
from ..functions import rules as U
from ..operators import readings as R
from ..sources.tables import table
from ..sources.views import BOXES_SQL, boxes
from .rules import _KEYS, _conf, _conf_sql, _flag, _flag_sql

_CUES = "CASE c_custkey % 6 WHEN 0 THEN '유형 0' || c_custkey % 10 || ' 덧셈과 뺄셈' WHEN 1 THEN '유형 3 a 유형12, 도형' WHEN 2 THEN 'p. ' || c_custkey % 40 WHEN 3 THEN c_custkey % 99 || ' of 40 · 07' WHEN 4 THEN 'Table ' || c_custkey % 30 || ' 표 2' END"


@query(f"""WITH t AS (SELECT c_custkey, {_CUES} AS text FROM customer), n AS (SELECT *, list_filter([CAST(x AS INT) FOR x IN regexp_extract_all(text, '(\\d{{1,2}})', 1)], lambda x: x BETWEEN 1 AND 26) AS fits, regexp_extract(text, '(\\d{{2}})\\s*$', 1) AS tail,
  regexp_extract(text, '유형\\s*(\\d{{1,2}})(?:\\s*([가-힣]{{2,16}}))?', 1) AS code, regexp_extract(text, '유형\\s*(\\d{{1,2}})(?:\\s*([가-힣]{{2,16}}))?', 2) AS title FROM t)
SELECT c_custkey, array_to_string([lpad(x, 2, '0') FOR x IN regexp_extract_all(text, '유형\\s*0?(\\d{{1,2}})', 1)], ',') AS markers,
  CASE WHEN len(fits) = 1 THEN lpad(CAST(fits[1] AS VARCHAR), 2, '0') WHEN tail <> '' AND CAST(NULLIF(tail, '') AS INT) BETWEEN 1 AND 26 THEN tail END AS badge, CASE WHEN code <> '' THEN rtrim('유형 ' || code || ' ' || title) END AS heading,
  regexp_matches(text, '그림|도형|그래프|figure|diagram', 'i') AS figure, regexp_matches(text, '다음 표|표\\s*\\d|table', 'i') AS "table" FROM n""")
def marker_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type codes, badges, headings and cues of figures and tables in short texts."""
    k = F.col("c_custkey")
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    text = F.when(k % 6 == 0, say("유형 0", k % 10, " 덧셈과 뺄셈")).when(k % 6 == 1, F.lit("유형 3 a 유형12, 도형")).when(k % 6 == 2, say("p. ", k % 40)).when(k % 6 == 3, say(k % 99, " of 40 · 07")).when(k % 6 == 4, say("Table ", k % 30, " 표 2"))
    t = F.col("text")
    rows = table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"))
    return rows.select("c_custkey", F.array_join(C.type_markers(t), ",").alias("markers"), C.badge_code(t).alias("badge"), C.type_heading(t).alias("heading"), C.shows_figure(t).alias("figure"), C.shows_table(t).alias("table"))


@query(f"""WITH {BOXES_SQL}, t AS (SELECT *, CASE item % 5 WHEN 0 THEN '0' || item || ' x' WHEN 1 THEN ' ' || page % 2000 || '. Find' WHEN 2 THEN page % 10 || ' ' || item || ' y' WHEN 3 THEN 'No ' || item END AS content FROM boxes), d AS (SELECT *, regexp_extract(regexp_replace(content, '\\s+', '', 'g'), '^\\d+') AS index FROM t)
SELECT page, item, index, CAST(index AS BIGINT) AS value FROM d WHERE x BETWEEN 0.08 AND 0.22 AND y BETWEEN 0.06 AND 0.92 AND length(index) BETWEEN 1 AND 3 AND NOT regexp_matches(index, '^0\\d$') AND CAST(NULLIF(index, '') AS BIGINT) >= 1""")
def leading_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes where an item begins, by the number in front."""
    i, p = F.col("item"), F.col("page")
    content = F.when(i % 5 == 0, F.concat(F.lit("0"), i, F.lit(" x"))).when(i % 5 == 1, F.concat(F.lit(" "), p % 2000, F.lit(". Find"))).when(i % 5 == 2, F.concat(p % 10, F.lit(" "), i, F.lit(" y"))).when(i % 5 == 3, F.concat(F.lit("No "), i))
    return R.leading_anchors(boxes(spark, sf_dir).withColumn("content", content)).select("page", "item", "index", "value")


_SAFE = {"identity_stable": (3, 9), "boundary_safe": (5, 8), "required_complete": (7, 11), "neighbour_figure": (11, 13), "shared_unresolved": (13, 17), "choices_safe": (17, 7), "owner_correct": (19, 6)}
_CROPS, _OWNERS = ("FIGURE_CROP_SAFE", "FIGURE_CROP_REVIEW", "FIGURE_CROP_UNSAFE"), ("SINGLE_OWNER_HIGH", "SHARED_OWNER_HIGH", "SINGLE_OWNER_REVIEW", "SHARED_OWNER_REVIEW", "UNRESOLVED")
_BOXES = ("GOOD", "MINOR_CUT", "MAJOR_CUT", "WRONG_REGION")
_CYCLES = {"crop": (_CROPS, "l_suppkey"), "ownership": (_OWNERS, "l_partkey"), "box_quality": (_BOXES, "l_orderkey")}
_EVIDENCE_SQL = ", ".join([f"NOT {_flag_sql(*v)} AS {n}" if n not in ("neighbour_figure", "shared_unresolved") else f"{_flag_sql(*v)} AS {n}" for n, v in _SAFE.items()] + [f"{list(v)}[{c} % {len(v)} + 1] AS {n}" for n, (v, c) in _CYCLES.items()])


def _evidence() -> dict[str, Column]:
    flags = {n: _flag(*v) if n in ("neighbour_figure", "shared_unresolved") else ~_flag(*v) for n, v in _SAFE.items()}
    return flags | {n: F.get(F.array(*[F.lit(x) for x in v]), (F.col(c) % len(v)).cast("int")) for n, (v, c) in _CYCLES.items()}


@query(f"""WITH e AS (SELECT {', '.join(_KEYS)}, {_conf_sql(23, 0.5)} AS confidence, {_flag_sql(29, 31)} AS formula, {_flag_sql(31, 19)} AS tables, {_flag_sql(37, 3)} AS sidebar, {_EVIDENCE_SQL} FROM lineitem),
f AS (SELECT *, list_filter([CASE WHEN NOT identity_stable THEN 'IDENTITY' END, CASE WHEN NOT boundary_safe THEN 'BOUNDARY' END, CASE WHEN confidence < 0.7 THEN 'DETECTION' END, CASE WHEN crop <> 'FIGURE_CROP_SAFE' THEN 'CROP' END, CASE WHEN ownership NOT IN ('SINGLE_OWNER_HIGH', 'SHARED_OWNER_HIGH') THEN 'OWNERSHIP' END, CASE WHEN NOT required_complete THEN 'INCOMPLETE' END,
  CASE WHEN neighbour_figure THEN 'NEIGHBOUR' END, CASE WHEN shared_unresolved THEN 'SHARED' END, CASE WHEN NOT choices_safe THEN 'CHOICES' END, CASE WHEN box_quality IN ('MAJOR_CUT', 'WRONG_REGION') THEN 'BOX' END, CASE WHEN NOT owner_correct THEN 'OWNER' END], lambda x: x IS NOT NULL) AS failed FROM e)
SELECT {', '.join(_KEYS)}, len(failed) = 0 AS safe, array_to_string(failed, ',') AS failed, CASE WHEN confidence < 0.6 THEN 'FIGURE_NOT_DETECTED' WHEN formula THEN 'FORMULA_FALSE_POSITIVE' WHEN tables THEN 'TABLE_CONFUSION' WHEN box_quality = 'WRONG_REGION' THEN 'FIGURE_BBOX_UNCERTAIN' WHEN box_quality = 'MAJOR_CUT' THEN 'FIGURE_CUT_RISK'
  WHEN crop = 'FIGURE_CROP_UNSAFE' THEN 'FIGURE_CUT_RISK' WHEN crop = 'FIGURE_CROP_REVIEW' THEN 'LABEL_CUT_RISK' WHEN ownership = 'UNRESOLVED' THEN 'FIGURE_OWNER_AMBIGUOUS' WHEN ownership = 'SHARED_OWNER_REVIEW' THEN 'SHARED_OWNER_AMBIGUOUS' WHEN ownership = 'SINGLE_OWNER_REVIEW' THEN 'FIGURE_OWNER_AMBIGUOUS' WHEN sidebar THEN 'SIDEBAR_FIGURE' ELSE 'OTHER' END AS reason FROM f""")
def figure_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures that need no review, what fails on the others, and why a person should look."""
    e = _evidence() | {"confidence": _conf(23, 0.5), "detected": _conf(23, 0.5) >= 0.6, "formula": _flag(29, 31), "table_confusion": _flag(31, 19), "sidebar": _flag(37, 3)}
    rows = table(spark, sf_dir, "lineitem").select(*_KEYS, U.figure_safe(e).alias("v"), U.figure_reason(e).alias("reason"))
    return rows.select(*_KEYS, "v.safe", F.array_join("v.failed", ",").alias("failed"), "reason")


@query(f"""WITH e AS (SELECT {', '.join(_KEYS)}, NOT {_flag_sql(3, 9)} AS crop_safe, NOT {_flag_sql(5, 8)} AS number_ok, NOT {_flag_sql(7, 11)} AS has_stem, {_flag_sql(11, 3)} AND l_partkey % 7 < 5 AS missing_choice, {_flag_sql(13, 4)} AND l_suppkey % 3 = 0 AS missing_figure, l_orderkey % 13 = 0 AS conflict FROM lineitem),
w AS (SELECT *, list_filter([CASE WHEN NOT crop_safe THEN 'crop_not_safe' END, CASE WHEN NOT has_stem THEN 'stem_missing' END, CASE WHEN missing_choice THEN 'missing_choice' END, CASE WHEN missing_figure THEN 'missing_figure' END, CASE WHEN conflict THEN 'OCR_CONFLICT' END], lambda x: x IS NOT NULL) AS warnings FROM e)
SELECT {', '.join(_KEYS)}, CASE WHEN number_ok AND len(warnings) = 0 THEN 'DRAFT' ELSE 'PIPELINE_REVIEW' END AS status, number_ok AND has_stem AND NOT missing_choice AND NOT missing_figure AS complete, array_to_string(warnings, ',') AS warnings FROM w""")
def pipeline_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised items that become drafts, and what is wrong with the others."""
    e = {"crop_safe": ~_flag(3, 9), "number_ok": ~_flag(5, 8), "has_stem": ~_flag(7, 11), "expects_choices": _flag(11, 3), "choices": F.col("l_partkey") % 7, "expects_figure": _flag(13, 4), "figures": F.col("l_suppkey") % 3, "conflicts": F.when(F.col("l_orderkey") % 13 == 0, 1).otherwise(0)}
    rows = table(spark, sf_dir, "lineitem").select(*_KEYS, U.pipeline_status(e).alias("v"))
    return rows.select(*_KEYS, "v.status", "v.complete", F.array_join("v.warnings", ",").alias("warnings"))


def _same_sql(x: str) -> str:
    return f"lower(regexp_replace(replace(replace(translate({x}, '−–$', '--'), '²', '^2'), '³', '^3'), '\\s+', '', 'g'))"


@query(f"""WITH t AS (SELECT doc_id, text AS truth, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN '7 ' || text || ' ①②③ 도형 x^2-1' WHEN 2 THEN '12 본이기 ①' ELSE ' ' END AS read, CAST(doc_id % 13 AS VARCHAR) AS number, doc_id % 3 + 1 AS choices, doc_id % 5 = 1 AS figure FROM documents),
l AS (SELECT *, {_same_sql('read')} AS r, list_filter([regexp_replace(x, '^\\s+|\\s+$', '', 'g') FOR x IN string_split(truth, chr(10))], lambda x: length(x) > 8)[1:4] AS lines, len(list_filter(['①','②','③','④','⑤','⑥','⑦','⑧','⑨','⑩'], lambda m: contains(read, m))) AS marks FROM t),
h AS (SELECT *, list_filter(lines, lambda x: contains(r, substring({_same_sql('x')}, 1, 16))) AS hits FROM l)
SELECT doc_id, CASE WHEN doc_id % 4 = 3 OR regexp_replace(COALESCE(read, ''), '\\s', '', 'g') = '' THEN 'NOT_COMPARED' ELSE array_to_string([CASE WHEN c THEN 'PASS' ELSE 'FAIL' END FOR c IN [contains(r, number), CASE WHEN COALESCE(len(lines), 0) = 0 THEN regexp_replace(COALESCE(truth, ''), '\\s', '', 'g') = '' ELSE len(hits) / len(lines) >= 0.5 END,
  marks = choices, contains(r, 'x^2-1'), NOT figure OR regexp_matches(read, '그림|도형|graph|triangle|반원|포물선', 'i'), NOT regexp_matches(read, '소개기|논이기|본이기')]], ',') END AS checks FROM h""")
def reading_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six checks of each cached reading of a document against its text."""
    k, text = F.col("doc_id"), F.col("text")
    read = F.when(k % 4 == 0, text).when(k % 4 == 1, F.concat(F.lit("7 "), text, F.lit(" ①②③ 도형 x^2-1"))).when(k % 4 == 2, F.lit("12 본이기 ①")).otherwise(" ")
    v = R.reading_checks(F.col("read"), number=(k % 13).cast("string"), truth=text, choices=k % 3 + 1, maths=F.array(F.lit("$x² − 1$")), figure=k % 5 == 1)
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", read.alias("read")).select("doc_id", v.alias("v"))
    every = F.concat_ws(",", "v.identity", "v.stem", "v.choices", "v.math", "v.figure", "v.boundary")
    return rows.select("doc_id", F.when(F.col("v.identity") == "NOT_COMPARED", "NOT_COMPARED").otherwise(every).alias("checks"))


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_quantity DESC) AS nth FROM lineitem WHERE l_partkey % 3 <> 0)
SELECT p_partkey, l_suppkey AS cached_l_suppkey, l_quantity AS cached_l_quantity FROM part LEFT JOIN c ON p_partkey = l_partkey AND nth = 1""")
def merged_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with what the last line that is cached says of them."""
    cached = table(spark, sf_dir, "lineitem").where("l_partkey % 3 <> 0").withColumnRenamed("l_partkey", "p_partkey")
    return R.merge_cached(table(spark, sf_dir, "part").select("p_partkey"), cached, "p_partkey", ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"], ["l_suppkey", "l_quantity"])


@query("""WITH l AS (SELECT p_partkey AS item, p_partkey % 60 AS number, p_partkey % 97 + 1 AS a, p_partkey % 97 + 1 + p_partkey % 25 AS b, p_partkey % 4 = 0 AS marked FROM part WHERE p_partkey % 3 <> 0), h AS (SELECT number, count(*) AS homes FROM l GROUP BY number),
w AS (SELECT DISTINCT CAST(l_linenumber * 9 + l_suppkey % 40 AS BIGINT) AS number FROM lineitem), c AS (SELECT w.number, min(item) AS covered_by FROM w JOIN l ON marked AND w.number BETWEEN a AND b AND b - a <= 20 GROUP BY w.number)
SELECT w.number, COALESCE(homes, 0) AS homes, covered_by FROM w LEFT JOIN h ON w.number = h.number LEFT JOIN c ON w.number = c.number""")
def number_homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where wanted numbers are at home, and the first listed item whose marked range covers them."""
    k = F.col("p_partkey")
    a = k % 97 + 1
    listed = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(k.alias("item"), (k % 60).alias("number"), F.when(k % 4 == 0, F.concat(F.lit("[ "), a, F.lit("~"), a + k % 25, F.lit("] x"))).otherwise("x").alias("stem"))
    wanted = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") * 9 + F.col("l_suppkey") % 40).cast("long").alias("number"))
    return R.number_homes(listed, wanted)


@query("""WITH f AS (SELECT DISTINCT l_orderkey AS page, l_linenumber AS n FROM lineitem WHERE l_suppkey % 7 <> 0), t AS (SELECT DISTINCT l_orderkey AS page, l_linenumber AS n FROM lineitem WHERE l_partkey % 5 <> 0),
p AS (SELECT COALESCE(f.page, t.page) AS page, count(t.n) AS expected, count(f.n) AS found, count_if(COALESCE(f.n = t.n, FALSE)) AS matched FROM f FULL JOIN t ON f.page = t.page AND f.n = t.n GROUP BY 1),
s AS (SELECT *, page % 10 AS book, expected - matched AS missed, found - matched AS extra, CASE WHEN found > 0 THEN matched / found END AS precision, CASE WHEN expected > 0 THEN matched / expected END AS recall FROM p)
SELECT book, count(*) AS pages, count_if(missed = 0 AND extra = 0) AS whole_pages, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(found) AS BIGINT) AS found, CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(missed) AS BIGINT) AS missed, CAST(sum(extra) AS BIGINT) AS extra, round(avg(precision), 6) AS mean_precision, round(avg(recall), 6) AS mean_recall FROM s GROUP BY book""")
def segmentation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the pages' segmentation, in sums and means by book."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), "l_linenumber", "l_suppkey", "l_partkey")
    pages = R.segmentation_scores(line.where("l_suppkey % 7 <> 0"), line.where("l_partkey % 5 <> 0"), ["page"], "l_linenumber")
    out = R.segmentation_totals(pages.withColumn("book", F.col("page") % 10), "book")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_precision", "mean_recall")})


@query("""WITH r AS (SELECT o_orderkey AS item, CASE WHEN o_orderkey % 5 = 0 THEN 'REVIEW' ELSE 'AUTO' END AS unit_decision, o_orderkey % 6 = 0 AS has_reason, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey % 25 END AS type, o_custkey % 5 AS unit, o_custkey AS page FROM orders),
m AS (SELECT r.*, c.c_custkey AS p, c.c_custkey % 9 AS pv, s.s_suppkey AS s, s.s_nationkey AS doc, n.n_nationkey AS t, n.n_regionkey AS tu FROM r LEFT JOIN customer c ON item = c.c_custkey LEFT JOIN supplier s ON item = s.s_suppkey LEFT JOIN nation n ON type = n.n_nationkey)
SELECT item, array_to_string(list_filter([CASE WHEN unit_decision <> 'AUTO' THEN 'UNIT_NOT_AUTO' END, CASE WHEN has_reason THEN 'HAS_REVIEW_REASON' END, CASE WHEN type IS NULL THEN 'TYPE_UNCLEAR' END, CASE WHEN unit = 3 THEN 'UNIT_CODE_MISSING' END, CASE WHEN p IS NULL THEN 'PROBLEM_MISSING' END, CASE WHEN pv = 0 THEN 'DRAFT_VERSION_MISSING' END,
  CASE WHEN pv = 1 THEN 'VERIFIED_BLOCKED' END, CASE WHEN s IS NULL THEN 'SOURCE_MISSING' END, CASE WHEN doc <> 7 THEN 'WRONG_DOCUMENT' END, CASE WHEN s % 50 <> page THEN 'PAGE_MISMATCH' END, CASE WHEN t IS NULL THEN 'TYPE_PROFILE_MISSING' END, CASE WHEN tu <> unit THEN 'UNIT_TYPE_INCONSISTENT' END], lambda x: x IS NOT NULL), ',') AS reasons FROM m""")
def preflight_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks against storing each classified row."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    auto = [F.lit("AUTO").alias(n) for n in ("overall", "type_decision", "key_point_decision", "strategy_decision")]
    rows = table(spark, sf_dir, "orders").select(
        k.alias("item"), *auto, F.when(k % 5 == 0, "REVIEW").otherwise("AUTO").alias("unit_decision"), F.when(k % 6 == 0, 1).otherwise(0).alias("review_reasons"), F.when(k % 11 != 0, c % 25).cast("string").alias("type"), (c % 5).cast("string").alias("unit"),
        F.when(c % 5 != 3, "U").alias("unit_code"), c.alias("page"), F.lit("1").alias("number"), F.lit(False).alias("evidence_insufficient"),
    )
    v = F.col("c_custkey")
    problems = table(spark, sf_dir, "customer").select(v.alias("item"), F.when(v % 9 != 0, v).alias("version"), F.when(v % 9 == 1, "VERIFIED").otherwise("DRAFT").alias("review_status"))
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("item"), F.col("s_nationkey").alias("document"), (F.col("s_suppkey") % 50).alias("page"), F.lit("1").alias("number"))
    profiles = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("type"), F.col("n_regionkey").cast("string").alias("unit"))
    return R.preflight(rows, problems, sources, profiles, F.lit(7)).select("item", F.array_join("reasons", ",").alias("reasons"))


_LEAKS = ("0123", "0123 유형 07", "123. 대표 문제 3", "123 x를 구하시오 대표 문제", "12쪽 유형 3 덧셈", "①\n이차방정식", "0094 $x^2 + \\frac{1}{2}$", "유형 1\n보기")


@query("WITH t AS (SELECT c_custkey, list_extract([" + ", ".join("'" + t.replace("\n", "' || chr(10) || '") + "'" for t in _LEAKS) + """], CAST(c_custkey % 9 + 1 AS INT)) AS text FROM customer), b AS (SELECT *, regexp_replace(text, '^\\d{3,4}[.)]?\\s*', '') AS body FROM t)
SELECT c_custkey, body = '' OR (length(body) <= 24 AND contains(body, '대표 문제') AND NOT contains(body, '구하시오')) OR (length(body) < 40 AND regexp_matches(body, '^\\d+쪽\\s*유형\\s*\\d+')) OR (len(string_split(body, chr(10))) <= 2 AND len(list_filter(string_split(body, chr(10)), lambda x: NOT regexp_matches(x, '^(유형 \\d+|보기)$|^\\d+쪽\\s*유형\\s*\\d+|대표 문제'))) = 0)
  OR regexp_matches(body, '^[①-⑳]\\n.*방정식') AS packaging, COALESCE(length(regexp_replace(body, '\\$+|\\\\[a-zA-Z]+|[{}]|\\s+', '', 'g')) BETWEEN 1 AND 16 AND NOT regexp_matches(body, '구하시오|대표 문제'), FALSE) AS atom FROM b""")
def packaging_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What leaked behind items: packaging of the book, or short expressions."""
    texts = F.array(*[F.lit(t) for t in _LEAKS])
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.get(texts, (F.col("c_custkey") % 9).cast("int")).alias("text"))
    return rows.select("c_custkey", C.packaging_only(F.col("text")).alias("packaging"), C.short_atom(F.col("text")).alias("atom"))
