"""Text: numbers, keys, checks and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as X
from ..operators.search import partial_hits
from ..sources.files import markdown_layout
from ..sources.tables import table
from ..sources.views import PROBLEMS_SQL, problems


@query(f"""WITH {PROBLEMS_SQL}, c AS (SELECT doc_id, number, regexp_replace(regexp_replace(number, '\\s+', '', 'g'), '\\.$', '') AS p FROM problems) SELECT doc_id, number, CASE WHEN regexp_matches(p, '^[0-9]{{1,4}}$') THEN lpad(p, 4, '0') END AS canonical FROM c""")
def canonical_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem numbers in canonical form."""
    return problems(spark, sf_dir).select("doc_id", "number", X.canonical_number(F.col("number")).alias("canonical"))


@query("SELECT o_orderkey, 'QB-' || lpad(CAST(o_orderkey * 37 AS VARCHAR), CAST(greatest(6, length(CAST(o_orderkey * 37 AS VARCHAR))) AS INTEGER), '0') AS code FROM orders")
def public_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of at least six digits."""
    return table(spark, sf_dir, "orders").select("o_orderkey", X.public_code(F.col("o_orderkey") * 37).alias("code"))


@query("SELECT p_partkey, p_type || '|' || p_brand || '|' || CASE WHEN p_size % 7 >= 5 THEN 'MC5' WHEN p_size % 7 > 0 THEN 'C' || (p_size % 7) ELSE 'CR' END || '|' || CASE WHEN p_partkey % 2 = 0 THEN 'FIG' ELSE 'NOFIG' END || '|' || CASE WHEN p_partkey % 3 = 0 THEN 'TAB' ELSE 'NOTAB' END || '|' || CASE WHEN p_size % 5 = 0 THEN 'D?' ELSE 'D' || (p_size % 5) END AS key FROM part")
def structure_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What variants of one item share."""
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", X.structure_key(F.col("p_type"), F.col("p_brand"), s % 7, k % 2 == 0, k % 3 == 0, F.when(s % 5 != 0, s % 5)).alias("key"))


#: Neutral rules over the driver's texts: licences, secrets, addresses and shouting.
_LEAKS = [("LICENSE", r"(?i)licensed under", ""), ("EMAIL", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", "<email>"), ("NUMBER", r"[0-9]{4,}", "<n>"), ("MARKS", r"[%&$*#]{3}", "")]


@query("""WITH a AS (SELECT doc_id, text AS t0, regexp_replace(text, '(?i)licensed under', '', 'g') AS t1 FROM documents), b AS (SELECT *, regexp_replace(t1, '[A-Za-z0-9._]+@[A-Za-z0-9.]+', '<email>', 'g') AS t2 FROM a), c AS (SELECT *, regexp_replace(t2, '[0-9]{4,}', '<n>', 'g') AS t3 FROM b), d AS (SELECT *, regexp_replace(t3, '[%&$*#]{3}', '', 'g') AS t4 FROM c)
SELECT doc_id, sha256(t4) AS cleaned, concat_ws(',', CASE WHEN regexp_matches(t0, '(?i)licensed under') THEN 'LICENSE' END, CASE WHEN regexp_matches(t1, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') THEN 'EMAIL' END, CASE WHEN regexp_matches(t2, '[0-9]{4,}') THEN 'NUMBER' END, CASE WHEN regexp_matches(t3, '[%&$*#]{3}') THEN 'MARKS' END) AS rules FROM d""")
def traced_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaning rules in order, with those that fired."""
    traced = table(spark, sf_dir, "documents").select("doc_id", X.traced_rules(F.col("text"), _LEAKS).alias("t"))
    return traced.select("doc_id", F.sha2("t.text", 256).alias("cleaned"), F.array_join("t.fired", ",").alias("rules"))


@query("""SELECT doc_id, length(regexp_replace(text, '\\s+', '', 'g')) >= 8 AS readable, regexp_matches(text, '[%&$*#]{3}') AS marks, regexp_matches(text, '(?i)licensed under') AS leak, CAST(length(regexp_replace(text, '\\s+', '', 'g')) AS BIGINT) AS visible FROM documents""")
def garbage_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readability, garbage and leak tests."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", (X.char_count(t) >= 8).alias("readable"), t.rlike(r"[%&$*#]{3}").alias("marks"), t.rlike("(?i)licensed under").alias("leak"), X.char_count(t).cast("long").alias("visible"))


@query("""WITH v AS (SELECT doc_id, text, length(regexp_replace(text, '\\s+', '', 'g')) AS n FROM documents) SELECT doc_id, round(CASE WHEN n > 0 THEN length(regexp_replace(text, '[^A-Z]', '', 'g')) / n ELSE 0 END, 6) AS capitals, round(CASE WHEN n > 0 THEN length(regexp_replace(text, '[^0-9]', '', 'g')) / n ELSE 0 END, 6) AS digits, round(CASE WHEN n > 0 THEN length(regexp_replace(text, '[^%&$*#!|]', '', 'g')) / n ELSE 0 END, 6) AS signs FROM v""")
def ratio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of capitals, digits and signs among visible characters."""
    r = lambda p: F.round(X.class_ratio(F.col("text"), p), 6)
    return table(spark, sf_dir, "documents").select("doc_id", r("[A-Z]").alias("capitals"), r("[0-9]").alias("digits"), r("[%&$*#!|]").alias("signs"))


@query("""WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '\\begin{a} $x^{2}$ \\end{a}' WHEN 1 THEN '\\begin{a} {{{ $x' WHEN 2 THEN '}}} $a$ {' WHEN 3 THEN 'plain' ELSE '\\end{b} $ $ $' END AS s FROM documents),
c AS (SELECT doc_id, CAST(length(s) - length(replace(s, '\\begin{', '\\begin')) AS BIGINT) AS begins, CAST(length(s) - length(replace(s, '\\end{', '\\end')) AS BIGINT) AS ends, CAST(length(s) - length(replace(s, '$', '')) AS BIGINT) AS dollars,
  CASE doc_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN -3 WHEN 3 THEN 0 ELSE 0 END AS low, CASE doc_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN -2 WHEN 3 THEN 0 ELSE 0 END AS depth FROM t)
SELECT doc_id, begins, ends, dollars, CAST(low AS BIGINT) AS low, CAST(depth AS BIGINT) AS depth, begins = ends AND dollars % 2 = 0 AND low >= -2 AND depth < 3 AS ok FROM c""")
def latex_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance of environments, dollar signs and braces (five written forms, dealt to documents)."""
    forms = {0: r"\begin{a} $x^{2}$ \end{a}", 1: r"\begin{a} {{{ $x", 2: "}}} $a$ {", 3: "plain"}
    s = F.lit(r"\end{b} $ $ $")
    for k, v in forms.items():
        s = F.when(F.col("doc_id") % 5 == k, F.lit(v)).otherwise(s)
    return table(spark, sf_dir, "documents").select("doc_id", X.balance(s).alias("b")).select("doc_id", "b.*")


@query(r"""WITH q AS (SELECT item_id, unnest(list_filter(string_split_regex(text, '\s+'), lambda t: t <> '')) AS token FROM benchmark), w AS (SELECT DISTINCT token FROM q), h AS (SELECT token, doc_id FROM w JOIN documents ON contains(text, token)),
n AS (SELECT item_id, count(*) AS size FROM q GROUP BY item_id)
SELECT item_id, doc_id, round(count(*) / size, 6) AS hit FROM q JOIN h USING (token) JOIN n USING (item_id) GROUP BY item_id, doc_id, size""")
def token_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of all tokens of each benchmark text that a document holds, for every pair with at least one."""
    return partial_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def turn_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character error rate of every turn against the one before, over all their characters but white space. DuckDB counts bytes, so SQL gives none."""
    from pyspark.sql import Window as W

    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", before.alias("before"))
    return rows.select("conv_id", "turn", F.round(X.char_error_rate(F.col("text"), F.col("before")), 6).alias("cer"))


@query("""WITH l AS (SELECT conv_id * 1000 + turn AS k, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS lines FROM conversations),
e AS (SELECT k, len(lines) AS n, unnest(lines) AS content, generate_subscripts(lines, 1) - 1 AS line FROM l) SELECT k, CAST(line AS BIGINT) AS line, content, round(0.04 + line / n * 0.9, 6) AS y, round(greatest(0.012, 0.9 / n), 6) AS height FROM e""")
def synthetic_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of turns spread down a page."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text")
    return markdown_layout(rows, "k", "text")


@query("""SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<!--.*?-->', '', 'g'), '(?i)<(/?)(p|br|b|i|em|strong|ul|ol|li|sub|sup|table|tr|td|th)\\b[^>]*>', '<\\1\\2>', 'g'),
  '<[^>]*>', '', 'g')) AS plain FROM pages""")
def html_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without scripts, styles, comments and tags."""
    kept = X.sanitise_html(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(F.regexp_replace(kept, "<[^>]*>", ""), 256).alias("plain"))


_KIND = [(r"(?i)<table", "TABLE", 0.9, "HAS_TABLE"), (r"(?i)<(ul|ol)\b", "LIST", 0.8, "HAS_LIST"), (r"(?i)<h[1-3]\b", "ARTICLE", 0.7, "HAS_HEADING")]


@query("""SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<table') THEN 'TABLE' WHEN regexp_matches(html, '(?i)<(ul|ol)\\b') THEN 'LIST' WHEN regexp_matches(html, '(?i)<h[1-3]\\b') THEN 'ARTICLE' ELSE 'PLAIN' END AS kind,
CAST(CASE WHEN regexp_matches(html, '(?i)<table') THEN 0.9 WHEN regexp_matches(html, '(?i)<(ul|ol)\\b') THEN 0.8 WHEN regexp_matches(html, '(?i)<h[1-3]\\b') THEN 0.7 ELSE 0.5 END AS DOUBLE) AS confidence FROM pages""")
def page_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of pages by ordered evidence."""
    rest = F.struct(F.lit("PLAIN").alias("id"), F.lit(0.5).alias("confidence"), F.lit("OTHER").alias("rule"))
    return table(spark, sf_dir, "pages").select("page_id", X.first_rule(F.col("html"), _KIND, rest).alias("k")).select("page_id", F.col("k.id").alias("kind"), "k.confidence")


@query("""SELECT doc_id, sha256(replace(replace(text, 'the', '[redacted]'), 'of', '[redacted]')) AS redacted FROM documents""")
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals replaced everywhere."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.redact(F.col("text"), F.array(F.lit("the"), F.lit("of"), F.lit(""))), 256).alias("redacted"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'See [' || (o_orderkey % 50 + 1) || '~' || (o_orderkey % 50 + 1 + o_custkey % 30) || '].' ELSE 'none' END AS stem, CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 30 <= 20 THEN CAST(o_custkey % 30 + 1 AS BIGINT) ELSE 0 END AS covered FROM orders""")
def range_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[a~b] marks of at most twenty numbers, and how many they cover."""
    k = F.col("o_orderkey")
    a = (k % 50 + 1).cast("string")
    b = (k % 50 + 1 + F.col("o_custkey") % 30).cast("string")
    stem = F.when(k % 3 == 0, F.concat(F.lit("See ["), a, F.lit("~"), b, F.lit("]."))).otherwise("none")
    covered = F.aggregate(X.ranges(F.col("stem"), span=20), F.lit(0).cast("long"), lambda s, p: s + p["b"] - p["a"] + 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", stem.alias("stem")).select("o_orderkey", "stem", covered.alias("covered"))


@query("""WITH c AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents), k AS (SELECT *, list_reverse(list_transform(l, lambda s: regexp_matches(s, '^\\s*(?:(?:.*[Ll]icensed under.*|.*[Ll]icense.*))?\\s*$'))) AS m FROM c),
g AS (SELECT *, least(8, COALESCE(list_position(m, FALSE) - 1, len(m))) AS gone FROM k) SELECT doc_id, sha256(array_to_string(l[1 : len(l) - gone], chr(10))) AS kept FROM g""")
def packaging_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without licence lines and blank lines at their end."""
    kept = X.strip_trailing_lines(F.col("text"), "(?:.*[Ll]icensed under.*|.*[Ll]icense.*)")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(kept, 256).alias("kept"))


@query("""SELECT o_orderkey, 'Item ' || o_custkey AS stem, CASE WHEN o_orderkey % 3 = 0 THEN 'Item ' || o_custkey WHEN o_orderkey % 3 = 1 THEN 'Read this.' || chr(10) || 'Item ' || o_custkey ELSE 'Item ' || o_custkey END AS composed FROM orders""")
def composed_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers taken off and shared prompts put in front of stems that lack them."""
    k = F.col("o_orderkey")
    own = X.strip_leading_number(F.concat(F.lpad((k % 1000).cast("string"), 4, "0"), F.lit(". Item "), F.col("o_custkey").cast("string")), F.lpad((k % 1000).cast("string"), 4, "0"))
    shared = F.when(k % 3 == 0, F.lit("item")).when(k % 3 == 1, F.lit("Read this.")).otherwise(F.lit(" "))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", own.alias("stem"), F.when(k % 3 == 0, F.lit("Item")).otherwise(shared).alias("shared"))
    return rows.select("o_orderkey", "stem", X.compose_stem(F.col("shared"), F.col("stem")).alias("composed"))
