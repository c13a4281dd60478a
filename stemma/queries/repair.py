"""Texts put right, types completed, and decisions on items held back, over orders and lines that stand for items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import repair as X
from ..functions import rules as U
from ..operators import repair as R
from ..operators.completion import complete_types
from ..operators.review import page_groups
from ..sources.files import provider_layout
from ..sources.tables import table
from ..sources.views import BOXES_SQL, boxes
from .rules import _KEYS, _conf, _conf_sql, _flag, _flag_sql


def _pick(k: Column, texts: list[Column]) -> Column:
    out = F.when(k == 0, texts[0])
    for i, t in enumerate(texts[1:], 1):
        out = out.when(k == i, t)
    return out


def _order_texts(spark: SparkSession, sf_dir: str, *texts: Column) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", _pick(F.col("o_orderkey") % len(texts), list(texts)).alias("t"))


def _stem() -> Column:
    return F.concat(F.lit("Find x + "), F.col("o_custkey"))


@query("""WITH k AS (SELECT o_orderkey, o_orderkey % 5 AS k, 'Find x + ' || o_custkey AS s FROM orders) SELECT o_orderkey, k <> 0 AS leaked, s AS stem, CASE k WHEN 2 THEN '4' WHEN 3 THEN '7' WHEN 4 THEN '9 so' END AS answer,
CASE k WHEN 1 THEN '정답 및 풀이 ● 9쪽' WHEN 2 THEN '4' || chr(10) || 'since' WHEN 3 THEN '7 ' || chr(10) || ' 8' WHEN 4 THEN '9 so' END AS explanation FROM k""")
def leak_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with answer keys in them, taken apart."""
    rows = _order_texts(spark, sf_dir, _stem(), F.concat(F.lit("정답 및 풀이 ● 9쪽 # "), _stem()), F.concat(_stem(), F.lit(" 정답 : 4\nsince")), F.concat(_stem(), F.lit(" [정답] 7 정답: 8")), F.concat(_stem(), F.lit("\n정답 9 so")))
    return rows.select("o_orderkey", X.split_leak(F.col("t")).alias("v")).select("o_orderkey", "v.*")


@query("""WITH k AS (SELECT o_orderkey, o_orderkey % 4 AS k, 'Find x + ' || o_custkey AS s FROM orders) SELECT o_orderkey, CASE k WHEN 3 THEN s || chr(10) || '정답 : ' || repeat('a', 200) || chr(10) || '답 4' ELSE s END AS kept FROM k""")
def leak_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the lines of answer keys; one that would lose most of itself keeps them, but for page headings."""
    long = F.concat(F.lit("정답 및 풀이 83쪽\n"), _stem(), F.lit("\n정답 : "), F.lit("a" * 200), F.lit("\n답 4"))
    rows = _order_texts(spark, sf_dir, _stem(), F.concat(_stem(), F.lit("\n정답 및 풀이 83쪽\n답 4")), F.concat(_stem(), F.lit("\n풀이 : by hand\n정답: 4")), long)
    return rows.select("o_orderkey", X.strip_leak(F.col("t")).alias("kept"))


@query("""WITH k AS (SELECT o_orderkey, o_orderkey % 9 AS k, o_custkey % 900 + 100 AS n FROM orders) SELECT o_orderkey, CASE k WHEN 0 THEN CAST(n AS VARCHAR) WHEN 1 THEN CAST(n AS VARCHAR) WHEN 2 THEN '③' WHEN 3 THEN CAST(n AS VARCHAR) WHEN 4 THEN CAST(n % 100 AS VARCHAR) WHEN 5 THEN CAST(n AS VARCHAR) WHEN 6 THEN '1' || n END AS display,
CAST(CASE k WHEN 2 THEN 3 WHEN 4 THEN n % 100 WHEN 6 THEN 1000 + n WHEN 7 THEN NULL WHEN 8 THEN NULL ELSE n END AS BIGINT) AS value, CASE k WHEN 0 THEN '3_DIGIT' WHEN 1 THEN '3_DIGIT' WHEN 2 THEN 'CIRCLED' WHEN 3 THEN 'BOXED' WHEN 4 THEN 'PAREN' WHEN 5 THEN 'NUMBER_PUNCT' WHEN 6 THEN '4_DIGIT' WHEN 7 THEN 'VISUAL_MARKER' END AS style,
CASE k WHEN 0 THEN '' WHEN 1 THEN 'Find' WHEN 2 THEN '다음' WHEN 3 THEN '' WHEN 4 THEN 'x' WHEN 5 THEN 'x' WHEN 6 THEN '5x' WHEN 7 THEN 'STEP1' ELSE 'none' END AS rest, k IN (1, 2, 4, 5, 6) AS glued, k = 6 AS ambiguous,
CASE k WHEN 0 THEN 'plain_leading_digits' WHEN 1 THEN 'glued_number_plus_stem' WHEN 2 THEN 'circled_token' WHEN 3 THEN 'boxed_number' WHEN 4 THEN 'paren_list_or_choice' WHEN 5 THEN 'number_punctuation' WHEN 6 THEN 'digit_run_continues' WHEN 7 THEN 'step_marker' ELSE 'no_leading_number' END AS reason FROM k""")
def glued_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that texts begin with, and what is glued to them."""
    n = (F.col("o_custkey") % 900 + 100).cast("string")
    two = (F.col("o_custkey") % 900 % 100).cast("string")
    texts = [n, F.concat(n, F.lit(" Find")), F.lit("③ 다음"), F.concat(F.lit("[ "), n, F.lit(" ]")), F.concat(F.lit("("), two, F.lit(") x")), F.concat(n, F.lit(". x")), F.concat(F.lit("1"), n, F.lit("5x")), F.lit("STEP 1"), F.lit("none")]
    return _order_texts(spark, sf_dir, *texts).select("o_orderkey", X.glued_number(F.col("t")).alias("v")).select("o_orderkey", "v.*")


@query("""WITH k AS (SELECT o_orderkey, o_orderkey % 3 AS k FROM orders) SELECT o_orderkey, CASE k WHEN 0 THEN '12' WHEN 1 THEN '1234' ELSE '12' END AS display, CASE k WHEN 0 THEN '34다음' WHEN 1 THEN '다음' ELSE '3다음' END AS rest, k <> 2 AS ambiguous,
CASE k WHEN 0 THEN 'sequence_fit_but_rest_still_digits' WHEN 1 THEN 'ambiguous_glued_digits' ELSE 'sequence_resolved_glue' END AS reason FROM k""")
def resolved_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of digits read by the numbers of neighbours."""
    k = F.col("o_orderkey") % 3
    near = F.when(k == 1, F.array(F.lit(500))).otherwise(F.array(F.lit(11))).cast("array<bigint>")
    v = X.resolve_digits(F.when(k == 2, "123").otherwise("1234"), F.lit("다음"), near)
    return table(spark, sf_dir, "orders").select("o_orderkey", v.alias("v")).select("o_orderkey", "v.display", "v.rest", "v.ambiguous", "v.reason")


@query("""WITH k AS (SELECT o_orderkey, o_orderkey % 10 + 10 AS p, 'x^' || o_custkey AS e FROM orders) SELECT o_orderkey, e || ';(;y' AS kept, p || ' + 35' AS dropped, 'dropped_page_type_ref:' || p || ' + 35;review_math_token:(;possible_lone_math_token:y' AS warnings FROM k""")
def math_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mathematics found in texts, without references to pages."""
    tokens = F.array(F.concat(F.lit("x^"), F.col("o_custkey")), F.concat((F.col("o_orderkey") % 10 + 10).cast("string"), F.lit(" + 35")), F.lit("("), F.lit("y"))
    v = table(spark, sf_dir, "orders").select("o_orderkey", X.filter_math(tokens).alias("v"))
    return v.select("o_orderkey", *[F.array_join(f"v.{c}", ";").alias(c) for c in ("kept", "dropped", "warnings")])


@query("""WITH k AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'I I Sums' WHEN 1 THEN p_size || ' ' || p_size || ' ' || p_size || ' Sums' WHEN 2 THEN 'Sums' WHEN 3 THEN '유형 07 유형 07 Sums' END AS title FROM part)
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'I Sums' WHEN 1 THEN (SELECT CAST(p_size AS VARCHAR) FROM part q WHERE q.p_partkey = k.p_partkey) || ' Sums' WHEN 2 THEN 'II Sums' WHEN 3 THEN '유형 07 Sums' ELSE 'II' END AS shown FROM k""")
def outline_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of codes and titles, no code twice."""
    k, n = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    title = F.when(k == 0, "I I Sums").when(k == 1, F.concat_ws(" ", n, n, n, F.lit("Sums"))).when(k == 2, "Sums").when(k == 3, "유형 07 유형 07 Sums")
    code = F.when(k == 0, "I").when(k == 1, n).when(k == 3, "07").otherwise(" II ")
    return table(spark, sf_dir, "part").select("p_partkey", X.outline_title(code, title, k == 3).alias("shown"))


# a customer's orders are a book of items, four to a page; every third runs on into a prompt for the next two
_BOOK_SQL = """b AS (SELECT o_custkey AS book, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS number, o_orderkey FROM orders),
i AS (SELECT book, number, number // 4 AS page, CAST(book % 3 AS VARCHAR) AS section, number % 17 <> 0 AS listed, number % 7 = 0 AS protected, number % 3 = 0 AS donor, 'Item ' || o_orderkey AS own, '[' || (number + 1) || '~' || (number + 2) || '] ' || CASE WHEN number % 2 = 0 THEN 'Find both.' ELSE 'Notes.' END AS prompt FROM b)"""


def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("number")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("number"), "o_orderkey")
    own = F.concat(F.lit("Item "), F.col("o_orderkey"))
    prompt = F.concat(F.lit("["), n + 1, F.lit("~"), n + 2, F.lit("] "), F.when(n % 2 == 0, "Find both.").otherwise("Notes."))
    return rows.select("book", "number", F.floor(n / 4).alias("page"), (F.col("book") % 3).cast("string").alias("section"), F.when(n % 3 == 0, F.concat(F.lpad(n.cast("string"), 4, "0"), F.lit(" "), own, F.lit("\n"), prompt)).otherwise(own).alias("text"), (n % 17 != 0).alias("listed"), (n % 7 == 0).alias("protected"))


@query(f"""WITH {_BOOK_SQL}, c AS (SELECT d.*, (SELECT count(*) FROM i t WHERE t.book = d.book AND t.listed AND t.number IN (d.number + 1, d.number + 2)) AS there, (SELECT COALESCE(max(abs(t.page - d.page)), 0) FROM i t WHERE t.book = d.book AND t.listed AND t.number IN (d.number + 1, d.number + 2)) AS far FROM i d WHERE d.donor AND d.listed),
r AS (SELECT book, number, number + 1 AS a, number + 2 AS b, own AS keep, prompt AS shared, concat_ws(',', CASE WHEN number % 2 <> 0 THEN 'NO_PROMPT' END, CASE WHEN there < 2 THEN 'TARGETS' END, CASE WHEN there < 2 OR far > 1 THEN 'PAGES' END, CASE WHEN there < 2 THEN 'SECTION' END, CASE WHEN protected THEN 'PROTECTED' END) AS reasons FROM c)
SELECT *, CASE WHEN reasons = '' THEN 'AUTO_SAFE' ELSE 'REVIEW_REQUIRED' END AS verdict FROM r""")
def range_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that run on into a later range's prompt, and whether it may be moved."""
    return R.range_candidates(_book(spark, sf_dir), r"\bFind\b").withColumn("reasons", F.array_join("reasons", ","))


@query(f"""WITH {_BOOK_SQL}, s AS (SELECT d.* FROM i d WHERE d.donor AND d.listed AND d.number % 2 = 0 AND NOT d.protected AND 2 = (SELECT count(*) FROM i t WHERE t.book = d.book AND t.listed AND t.number IN (d.number + 1, d.number + 2)))
SELECT book, number, TRUE AS gave, FALSE AS took, own AS text FROM s UNION ALL SELECT i.book, i.number, FALSE, TRUE, s.prompt || chr(10) || i.own FROM s JOIN i ON i.book = s.book AND i.listed AND i.number IN (s.number + 1, s.number + 2)""")
def range_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts moved from the items they leaked into to those they are for."""
    return R.range_restore(_book(spark, sf_dir), r"\bFind\b")


_GLUE_SQL = """g AS (SELECT o_custkey AS book, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS number, o_orderkey FROM orders),
j AS (SELECT *, lpad(CAST(number AS VARCHAR), 4, '0') || ' Item x' || o_orderkey AS own, lead(o_orderkey) OVER (PARTITION BY book ORDER BY number) AS next, lag(o_orderkey) OVER (PARTITION BY book ORDER BY number) AS prev, number % 11 = 0 AS protected FROM g),
t AS (SELECT *, CASE WHEN number % 4 = 1 THEN own || ' ' || lpad(CAST(number + 1 AS VARCHAR), 4, '0') || ' Twin x' || o_orderkey WHEN number % 4 = 2 THEN 'See ' || lpad(CAST(number - 1 AS VARCHAR), 4, '0') || ' more' ELSE own END AS text FROM j)"""


@query(f"""WITH {_GLUE_SQL} SELECT book, number, 'TRIM' AS action, own AS text, number AS from_number FROM t WHERE number % 4 = 1 AND next IS NOT NULL AND NOT protected
UNION ALL SELECT book, number, CASE WHEN (number - 1) % 11 = 0 THEN 'TRIM' ELSE 'SIBLING' END, CASE WHEN (number - 1) % 11 = 0 THEN 'See' ELSE lpad(CAST(number AS VARCHAR), 4, '0') || ' Twin x' || prev END, CASE WHEN (number - 1) % 11 = 0 THEN number ELSE number - 1 END FROM t WHERE number % 4 = 2 AND NOT protected""")
def sibling_rebuilds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that hold their neighbours' texts, and what their texts should be."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("number"), "o_orderkey")
    n, pad = F.col("number"), lambda c: F.lpad(c.cast("string"), 4, "0")
    own = F.concat(pad(n), F.lit(" Item x"), F.col("o_orderkey"))
    text = F.when(n % 4 == 1, F.concat(own, F.lit(" "), pad(n + 1), F.lit(" Twin x"), F.col("o_orderkey"))).when(n % 4 == 2, F.concat(F.lit("See "), pad(n - 1), F.lit(" more"))).otherwise(own)
    return R.sibling_rebuilds(rows.select("book", "number", text.alias("text"), (n % 11 == 0).alias("protected")))


_FIX_SQL = f"""c AS (SELECT {', '.join(_KEYS)}, list_filter([CASE WHEN {_flag_sql(3, 2)} THEN 'BBOX_INTRUSION' END, CASE WHEN {_flag_sql(5, 3)} THEN 'ANSWER_KEY_LEAK' END, CASE WHEN {_flag_sql(7, 3)} THEN 'TYPE_UNCLEAR' END, CASE WHEN {_flag_sql(11, 4)} THEN 'UNIT_UNCLEAR' END], lambda x: x IS NOT NULL) AS r,
  {_flag_sql(13, 2)} AS fix1, {_flag_sql(17, 3)} AS fix2, {_conf_sql(19)} >= 0.76 AS fix3, {_flag_sql(23, 6)} AS dup FROM lineitem),
s1 AS (SELECT *, fix1 AND list_contains(r, 'BBOX_INTRUSION') AS a1, fix2 AND list_contains(r, 'ANSWER_KEY_LEAK') AS a2, fix3 AND list_has_any(r, ['TYPE_UNCLEAR', 'UNIT_UNCLEAR']) AS a3 FROM c),
s2 AS (SELECT *, list_filter(r, lambda x: NOT (a1 AND x = 'BBOX_INTRUSION') AND NOT (a2 AND x = 'ANSWER_KEY_LEAK') AND NOT (a3 AND x IN ('TYPE_UNCLEAR', 'UNIT_UNCLEAR'))) AS l FROM s1)"""


@query(f"""WITH {_FIX_SQL}, f AS (SELECT {', '.join(_KEYS)}, concat_ws(',', array_to_string(l, ','), CASE WHEN dup THEN 'DUPLICATE_CANDIDATE' END) AS j, concat_ws(',', CASE WHEN a1 THEN 'BBOX_CORRECT' END, CASE WHEN a2 THEN 'SPLIT_ANSWER' END, CASE WHEN a3 THEN 'TYPE_REINFER' END) AS applied FROM s2)
SELECT {', '.join(_KEYS)}, regexp_replace(j, '^,', '') AS residual, applied, CASE WHEN j = '' THEN 'AUTO_CLEAR' ELSE 'HUMAN_REVIEW' END AS verdict, CASE WHEN j = '' THEN 'AUTO_CLASSIFIED' ELSE 'NEEDS_REVIEW' END AS review_status FROM f""")
def residual_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items held back, judged again after what could be put right."""
    left = F.array_compact(F.array(*[F.when(_flag(s, n), F.lit(r)) for s, n, r in ((3, 2, "BBOX_INTRUSION"), (5, 3, "ANSWER_KEY_LEAK"), (7, 3, "TYPE_UNCLEAR"), (11, 4, "UNIT_UNCLEAR"))]))
    fixes = [(_flag(13, 2), "BBOX_CORRECT", ("BBOX_INTRUSION",)), (_flag(17, 3), "SPLIT_ANSWER", ("ANSWER_KEY_LEAK",)), (_conf(19) >= 0.76, "TYPE_REINFER", ("TYPE_UNCLEAR", "UNIT_UNCLEAR"))]
    rows = table(spark, sf_dir, "lineitem").select(*_KEYS, R.cleaned(left, fixes, [(_flag(23, 6), "DUPLICATE_CANDIDATE")]).alias("s"))
    return rows.select(*_KEYS, F.array_join("s.left", ",").alias("residual"), F.array_join("s.applied", ",").alias("applied"), R.cleanup_verdict(F.col("s")).alias("v")).select(*_KEYS, "residual", "applied", "v.*")


_SIGNALS = {"hidden": (3, 31), "protected": (5, 29), "duplicate_body": (7, 23), "own_range": (11, 7), "later": (13, 3), "siblings": (17, 3), "too_short": (19, 6), "covered": (23, 4), "page_prompt": (29, 5), "atom": (31, 3), "trimmed": (37, 9), "packaging": (41, 8), "range_leak": (43, 4), "on_next": (47, 2), "next_leak": (53, 3), "next_listed": (59, 2), "leak_packaging": (61, 3), "leak_found": (67, 2), "number_dup": (71, 5), "original": (73, 2)}


@query(f"""WITH e AS (SELECT {', '.join(_KEYS)}, {', '.join(f'{_flag_sql(*v)} AS {n}' for n, v in _SIGNALS.items())} FROM lineitem)
SELECT {', '.join(_KEYS)}, CASE WHEN hidden THEN 'BLOCKED' WHEN protected OR duplicate_body THEN 'REVIEW_REQUIRED' WHEN own_range AND NOT later THEN CASE WHEN siblings THEN 'REVIEW_REQUIRED' ELSE 'PASS_FALSE_POSITIVE' END WHEN too_short THEN CASE WHEN covered THEN 'PASS_FALSE_POSITIVE' WHEN page_prompt THEN 'AUTO_SAFE' WHEN atom THEN 'PASS_FALSE_POSITIVE' ELSE 'REVIEW_REQUIRED' END
 WHEN trimmed OR packaging THEN 'AUTO_SAFE' WHEN range_leak THEN CASE WHEN later AND on_next THEN 'AUTO_SAFE' ELSE 'REVIEW_REQUIRED' END WHEN next_leak THEN CASE WHEN NOT next_listed THEN 'REVIEW_REQUIRED' WHEN leak_packaging THEN 'AUTO_SAFE' WHEN NOT leak_found THEN 'PASS_FALSE_POSITIVE' ELSE 'REVIEW_REQUIRED' END
 WHEN number_dup AND atom THEN 'PASS_FALSE_POSITIVE' WHEN NOT original THEN 'BLOCKED' ELSE 'REVIEW_REQUIRED' END AS verdict FROM e""")
def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of items in review, by signals and what was found."""
    v = U.review_decision({n: _flag(*a) for n, a in _SIGNALS.items()})
    return table(spark, sf_dir, "lineitem").select(*_KEYS, v["verdict"].alias("verdict"))


@query("""WITH i AS (SELECT o_custkey // 10 AS page, o_orderpriority AS section, o_orderkey % 9000 AS number, o_orderkey % 3 = 0 AS cand, o_orderkey % 4 <> 0 AS listed FROM orders), l AS (SELECT page, min(number) AS lo, max(number) AS hi FROM i WHERE listed GROUP BY page),
c AS (SELECT page, section, count(*) AS candidates, min(number) AS a, max(number) AS z FROM i WHERE cand GROUP BY page, section) SELECT page, section, candidates, lpad(CAST(COALESCE(lo, a) AS VARCHAR), 4, '0') || '~' || lpad(CAST(COALESCE(hi, z) AS VARCHAR), 4, '0') AS number_range FROM c LEFT JOIN l USING (page)""")
def review_page_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in review by page and section, with the numbers that stand there."""
    k = F.col("o_orderkey")
    items = table(spark, sf_dir, "orders").select(F.floor(F.col("o_custkey") / 10).alias("page"), F.col("o_orderpriority").alias("section"), (k % 9000).alias("number"), (k % 3 == 0).alias("cand"), (k % 4 != 0).alias("listed"))
    return page_groups(items.where("cand"), items.where("listed"), ["section"])


def _type(step: int, every: int, kinds: int = 4) -> Column:
    k = F.col("o_orderkey") * step
    return F.when(k % every != 0, F.concat(F.lit("T"), (F.col("o_custkey") * step % kinds).cast("string")))


def _type_sql(step: int, every: int, kinds: int = 4) -> str:
    return f"CASE WHEN o_orderkey * {step} % {every} <> 0 THEN 'T' || (o_custkey * {step} % {kinds}) END"


@query(f"""WITH i AS (SELECT o_orderkey AS item, CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey % 11 END AS section, o_custkey % 5 AS key, {_type_sql(3, 2)} AS content, {_type_sql(5, 3)} AS source, {_type_sql(7, 2)} AS neighbour, {_type_sql(11, 4)} AS ai, CASE WHEN o_orderkey % 6 = 0 THEN {_type_sql(13, 5, 5)} END AS cached, o_orderkey % 19 <> 0 AS current, o_orderkey % 10 = 3 AS protected,
  CASE WHEN o_orderkey % 2 = 0 THEN 'NEEDS_REVIEW' END AS review_status, o_orderkey % 21 = 0 AS leak, o_orderkey % 4 AS fp FROM orders),
a AS (SELECT s.range AS section, 'T' || t.range AS type FROM range(11) s, range(4) t WHERE (s.range + t.range) % 3 <> 0),
vk AS (SELECT section, key, cached AS bk FROM (SELECT section, key, cached, count(*) AS n, row_number() OVER (PARTITION BY section, key ORDER BY count(*) DESC, cached) AS r FROM i WHERE cached IS NOT NULL AND section IS NOT NULL GROUP BY section, key, cached) WHERE r = 1 AND n >= 2),
vs AS (SELECT section, cached AS bs FROM (SELECT section, cached, row_number() OVER (PARTITION BY section ORDER BY count(*) DESC, cached) AS r FROM i WHERE cached IS NOT NULL AND section IS NOT NULL GROUP BY section, cached) WHERE r = 1),
al AS (SELECT section, list(type) AS types FROM a GROUP BY section), j AS (SELECT i.*, bk, bs, COALESCE(types, []) AS types FROM i LEFT JOIN vk ON i.section = vk.section AND i.key = vk.key LEFT JOIN vs ON i.section = vs.section LEFT JOIN al ON i.section = al.section),
o AS (SELECT *, CASE WHEN list_contains(types, cached) THEN cached END AS k, CASE WHEN list_contains(types, content) THEN content END AS c, CASE WHEN list_contains(types, source) THEN source END AS s, COALESCE(CASE WHEN list_contains(types, bk) THEN bk END, CASE WHEN list_contains(types, neighbour) THEN neighbour END) AS g, CASE WHEN list_contains(types, bs) THEN bs END AS e, CASE WHEN list_contains(types, ai) THEN ai END AS h FROM j),
p AS (SELECT *, COALESCE(k, c, g, e, h) AS pref FROM o), q AS (SELECT *, pref IS NOT NULL AND pref <> 'T' || fp AS fits FROM p),
d AS (SELECT *, CASE WHEN k IS NOT NULL AND (COALESCE(c, s, g) IS NOT NULL OR fits) THEN 1 WHEN g = e AND (c IS NULL OR c = g) THEN 2 WHEN g <> c AND (h = g OR h = c) THEN 3 WHEN c = s THEN 4 WHEN c = h THEN 5 WHEN COALESCE(c, g, e) IS NOT NULL AND fits THEN 6 ELSE 7 END AS w FROM q),
t AS (SELECT *, COALESCE(k, CASE w WHEN 1 THEN COALESCE(c, s, g, h) WHEN 2 THEN g WHEN 3 THEN h WHEN 4 THEN s WHEN 5 THEN h WHEN 6 THEN COALESCE(c, g, e) ELSE COALESCE(c, g, e, h) END, pref) AS type FROM d),
f AS (SELECT *, CASE WHEN k IS NOT NULL THEN 'SOURCE_CONFIRMED' WHEN type IS NULL THEN 'LOW_CONFIDENCE_REVIEW' ELSE CASE w WHEN 2 THEN 'CLUSTER_CONFIRMED' WHEN 3 THEN 'AI_CONFIRMED' WHEN 4 THEN 'SOURCE_CONFIRMED' WHEN 5 THEN 'AI_CONFIRMED' WHEN 6 THEN 'CLUSTER_CONFIRMED' ELSE 'LOW_CONFIDENCE_REVIEW' END END AS confirmation FROM t)
SELECT item, type, confirmation, concat_ws(',', CASE WHEN section IS NULL THEN 'NO_SECTION' END, CASE WHEN section IS NOT NULL AND type IS NULL THEN 'TYPE_UNRESOLVED' END, CASE WHEN section IS NOT NULL AND confirmation = 'LOW_CONFIDENCE_REVIEW' THEN 'LOW_CONFIDENCE_REVIEW' END, CASE WHEN protected THEN 'PROTECTED' END) AS reasons,
  type IS NOT NULL AND current AND NOT protected AS persist, type IS NOT NULL AND current AND NOT protected AND confirmation <> 'LOW_CONFIDENCE_REVIEW' AND COALESCE(review_status, '') = 'NEEDS_REVIEW' AND NOT leak AS clear_review FROM f""")
def completed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of all items (orders) by votes, neighbours and fingerprints, as far as their sections (of customers) allow."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    items = table(spark, sf_dir, "orders").select(
        k.alias("item"), F.when(k % 13 != 0, c % 11).alias("section"), (c % 5).alias("key"), _type(3, 2).alias("content"), _type(5, 3).alias("source"), _type(7, 2).alias("neighbour"), _type(11, 4).alias("ai"), F.when(k % 6 == 0, _type(13, 5, 5)).alias("cached"),
        (k % 19 != 0).alias("current"), (k % 10 == 3).alias("protected"), F.when(k % 2 == 0, "NEEDS_REVIEW").alias("review_status"), (k % 21 == 0).alias("leak"), F.concat(F.lit("T"), k % 4).alias("fp"),
    )
    s = spark.range(44).select((F.col("id") % 11).alias("section"), F.floor(F.col("id") / 11).alias("t")).where("(section + t) % 3 <> 0")
    return complete_types(items, s.select("section", F.concat(F.lit("T"), F.col("t").cast("string")).alias("type")), lambda t: t == F.col("fp")).withColumn("reasons", F.array_join("reasons", ","))


@query(f"""WITH {BOXES_SQL} SELECT page, row_number() OVER (PARTITION BY page ORDER BY item) - 1 AS pos, 'item ' || item AS content, round(least(1.0, x), 6) AS x, round(least(1.0, y), 6) AS y, round(least(1.0, x + w) - least(1.0, x), 6) AS width, round(least(1.0, y + h) - least(1.0, y), 6) AS height FROM boxes""")
def provider_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of boxes as a provider's JSON (pixel corners) and read back, normalised."""
    at = lambda a, side: (F.col(a) if isinstance(a, str) else a) * side
    box = F.struct("item", F.lit("text").alias("type"), F.concat(F.lit("item "), F.col("item")).alias("content"), at("x", 2000.0).alias("top_left_x"), at("y", 3000.0).alias("top_left_y"), at(F.col("x") + F.col("w"), 2000.0).alias("bottom_right_x"), at(F.col("y") + F.col("h"), 3000.0).alias("bottom_right_y"))
    pages = boxes(spark, sf_dir).groupBy("page").agg(F.sort_array(F.collect_list(box)).alias("blocks"))
    raw = pages.select("page", F.to_json(F.struct(F.struct(F.lit(2000.0).alias("width"), F.lit(3000.0).alias("height")).alias("dimensions"), "blocks")).alias("raw"))
    return provider_layout(raw).where("kind = 'block'").select("page", "pos", "content", *[F.round(c, 6).alias(c) for c in ("x", "y", "width", "height")])
