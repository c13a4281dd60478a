"""Readings, choices, features and headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import mathtext as M
from ..operators.outline import parse_headings
from ..sources.tables import table

_A = "'f' || (o_orderkey % 4) || ' = x^' || (o_orderkey % 3 + 1) || ' + y^{2} - ' || (o_custkey % 50)"
_B = "'f' || (o_orderkey % 4) || ' = x^' || (o_orderkey % 2 + 1) || ' + y^{2} ' || CASE WHEN o_orderkey % 5 = 0 THEN '+' ELSE '-' END || ' ' || (o_custkey % 49)"


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda x: x.cast("string")
    a = F.concat(F.lit("f"), s(k % 4), F.lit(" = x^"), s(k % 3 + 1), F.lit(" + y^{2} - "), s(c % 50))
    b = F.concat(F.lit("f"), s(k % 4), F.lit(" = x^"), s(k % 2 + 1), F.lit(" + y^{2} "), F.when(k % 5 == 0, "+").otherwise("-"), F.lit(" "), s(c % 49))
    return table(spark, sf_dir, "orders").select("o_orderkey", a.alias("a"), b.alias("b"))


@query(f"""WITH r AS (SELECT o_orderkey, o_custkey, {_A} AS a, {_B} AS b FROM orders), c AS (SELECT *, o_orderkey % 3 <> o_orderkey % 2 AS ex, o_orderkey % 5 = 0 AS op, o_custkey % 50 <> o_custkey % 49 AS nu FROM r)
SELECT o_orderkey, CASE WHEN ex OR op OR nu THEN 'CRITICAL' WHEN a <> b THEN 'COSMETIC' ELSE 'SAME' END AS worst, concat_ws(',', CASE WHEN ex OR nu THEN 'NUMBERS' END, CASE WHEN ex THEN 'EXPONENTS' END, CASE WHEN op THEN 'OPERATORS' END) AS codes FROM c""")
def reading_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two readings of a formula disagree on."""
    return _readings(spark, sf_dir).select("o_orderkey", M.reading_diff(F.col("a"), F.col("b")).alias("d")).select("o_orderkey", "d.worst", F.array_join("d.codes", ",").alias("codes"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> o_orderkey % 2 THEN 'x' ELSE '' END AS bases FROM orders""")
def exponent_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases with different exponents in two readings."""
    return _readings(spark, sf_dir).select("o_orderkey", F.array_join(M.conflicts(F.col("a"), F.col("b")), ",").alias("bases"))


@query("""WITH c AS (SELECT l_orderkey, list({'n': l_linenumber, 'p': l_partkey} ORDER BY l_linenumber, l_partkey) AS ls FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, CAST(len(ls) AS BIGINT) AS n, CAST(sum_of AS BIGINT) AS parts, ordered FROM (
  SELECT l_orderkey, ls, list_sum(list_transform(ls, lambda x: x.p)) AS sum_of, list_bool_and(list_transform(ls, lambda x, i: x.n = i)) AS ordered FROM c)""")
def parsed_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choices read back from text: how many, what they say, and whether their labels run from 1."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("ls"))
    text = F.concat(F.lit("Which part?\n"), F.array_join(F.transform("ls", lambda x: F.concat(F.lit("("), x["l_linenumber"].cast("string"), F.lit(") "), x["l_partkey"].cast("string"))), "\n"))
    c = lines.select("l_orderkey", M.choices(text).alias("c"))
    return c.select("l_orderkey", F.size("c").cast("long").alias("n"), F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x["text"].cast("long")).alias("parts"), M.in_sequence(F.transform("c", lambda x: x["label"])).alias("ordered"))


_PATTERNS = {"capitals": "[A-Z]", "digits": "[0-9]", "bars": r"\|", "stops": r"\."}
_RULES = [("TABLE", ["bars"], []), ("PROSE", ["stops"], ["bars"]), ("LIST", ["digits"], ["stops"])]


@query("""WITH f AS (SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines, CAST(list_max(list_transform(string_split(text, chr(10)), lambda s: length(s))) AS BIGINT) AS longest,
  CAST(len(regexp_extract_all(text, '[A-Z]')) AS BIGINT) AS capitals, CAST(len(regexp_extract_all(text, '[0-9]')) AS BIGINT) AS digits, CAST(len(regexp_extract_all(text, '\\|')) AS BIGINT) AS bars, CAST(len(regexp_extract_all(text, '\\.')) AS BIGINT) AS stops FROM documents),
s AS (SELECT *, list_filter([CASE WHEN bars > 0 THEN 'TABLE' END, CASE WHEN stops > 0 AND bars = 0 THEN 'PROSE' END, CASE WHEN digits > 0 AND stops = 0 THEN 'LIST' END], lambda x: x IS NOT NULL) AS t FROM f)
SELECT * EXCLUDE t, array_to_string(t, ',') AS supported, CASE WHEN len(t) = 1 THEN t[1] END AS inferred FROM s""")
def feature_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of texts, the types they support, and the one type where there is just one."""
    f = table(spark, sf_dir, "documents").select("doc_id", M.features(F.col("text"), _PATTERNS).alias("f"))
    a = M.agreement(F.col("f"), _RULES)
    return f.select("doc_id", "f.*", F.array_join(a["supported"], ",").alias("supported"), a["inferred"].alias("inferred"))


@query("""WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS s, generate_subscripts(string_split(html, chr(10)), 1) - 1 AS line FROM pages),
h AS (SELECT page_id, line, CASE WHEN regexp_matches(s, '<h1[^>]*>([^<]*)') THEN 0 WHEN regexp_matches(s, '<h2[^>]*>([^<]*)') THEN 1 WHEN regexp_matches(s, '<p[^>]*>([^<]*)') THEN 2 END AS d,
  trim(CASE WHEN regexp_matches(s, '<h1[^>]*>([^<]*)') THEN regexp_extract(s, '<h1[^>]*>([^<]*)', 1) WHEN regexp_matches(s, '<h2[^>]*>([^<]*)') THEN regexp_extract(s, '<h2[^>]*>([^<]*)', 1) ELSE regexp_extract(s, '<p[^>]*>([^<]*)', 1) END) AS title FROM l), g AS (SELECT * FROM h WHERE d IS NOT NULL)
SELECT page_id, CAST(line AS BIGINT) AS line, ['TITLE', 'SECTION', 'TEXT'][d + 1] AS level, title, (SELECT arg_max(u.title, u.line) FROM g u WHERE u.page_id = g.page_id AND u.line < g.line AND u.d < g.d AND u.line = (SELECT max(x.line) FROM g x WHERE x.page_id = g.page_id AND x.line < g.line AND x.d < g.d)) AS parent,
  CAST((SELECT min(u.line) FROM g u WHERE u.page_id = g.page_id AND u.line > g.line AND u.d <= g.d) - 1 AS BIGINT) AS last FROM g""")
def parsed_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, sections and paragraphs of pages as a hierarchy with ranges of lines."""
    levels = [("TITLE", "<h1[^>]*>([^<]*)"), ("SECTION", "<h2[^>]*>([^<]*)"), ("TEXT", "<p[^>]*>([^<]*)")]
    return parse_headings(table(spark, sf_dir, "pages"), "page_id", "html", levels)


@query("""WITH p AS (SELECT o_orderkey, o_orderstatus AS st, o_orderpriority AS pr, list_sort(string_split(o_orderpriority, '-')) AS w FROM orders), s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'X' ELSE st END AS st, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE pr END AS pr FROM p)
SELECT p.o_orderkey, concat_ws(',', CASE WHEN p.st IS DISTINCT FROM s.st THEN 'status' END, CASE WHEN p.pr IS DISTINCT FROM s.pr THEN 'priority' END) AS diffs FROM p JOIN s ON p.o_orderkey = s.o_orderkey""")
def read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that differ between what was planned and what was stored; words without regard to order."""
    words = F.array_sort(F.split(F.col("o_orderpriority"), "-"))
    p = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("st"), F.col("o_orderpriority").alias("pr"), words.alias("w"))
    s = p.select("o_orderkey", F.when(F.col("o_orderkey") % 6 == 0, "X").otherwise(F.col("st")).alias("st2"), F.when(F.col("o_orderkey") % 4 != 0, F.col("pr")).alias("pr2"), F.reverse("w").alias("w2"))
    diffs = M.field_diffs({"status": (F.col("st"), F.col("st2")), "priority": (F.col("pr"), F.col("pr2")), "words": (F.col("w"), F.array_sort("w2"))})
    return p.join(s, "o_orderkey").select("o_orderkey", F.array_join(diffs, ",").alias("diffs"))
