"""Problems recognised in texts, and formulas of two readings compared, over all documents with marks put in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import recognition as R
from ..operators.recognition import recognised
from ..sources.tables import table

#: What stands before and behind a document's text, by doc_id % 12; the same in both engines.
HEADS = ["'12. '", "'문제 3 '", "'[7] '", "''", "'① '", "'0421 '", "'5) '", "''", "'4. x2 - 5x + 6 = 0 '", "'8. x² ≤ 4 '", "'9. '", "''"]
TAILS = [
    "'\n① 2\n② x² = 4\n③ 6'", "'\n(1) a\n(2) b\n정답: 2'", "'\n1) p\n3) q'", "'\n정답 및 풀이'", "''", "'\n다음 그림 x^2/3'", "'\r\n답 : √2'", "''", "'\n① a'", "'\n② b\n① a'", "'\n표 1 a ≠ b, sqrt(2);'", "'\n'",
]


def _marked(column: str) -> str:
    pick = lambda side: "CASE doc_id % 12 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(side)) + " END"
    return f"({pick(HEADS)}) || {column} || ({pick(TAILS)})"


def raw_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw texts of problems: every twelfth of a kind; of every 50th only what was put in is left."""
    d = table(spark, sf_dir, "documents")
    body = "CASE WHEN doc_id % 50 = 7 THEN '' ELSE replace(text, '. ', '.\n') END"
    return d.select("doc_id", F.expr(_marked(body).replace("\\", "\\\\").replace("\n", "\\n").replace("\r", "\\r")).alias("raw"))


def _flat(df: DataFrame) -> DataFrame:
    f = F.col("found")
    formulas = F.array_join(F.transform(f["formulas"], lambda m: F.concat_ws("|", m["original"], F.coalesce(m["latex"], F.lit("-")), m["structure_ok"].cast("string"), F.array_join(m["notes"], "+"))), " ")
    choices = F.array_join(F.transform(f["choices"], lambda c: F.concat_ws("|", c["order"].cast("string"), c["label"], c["text"])), ";")
    return df.select("doc_id", f["status"].alias("status"), f["verdict"].alias("verdict"), f["number"].alias("number"), F.sha2(f["stem"], 256).alias("stem_sha256"), formulas.alias("formulas"), choices.alias("choices"), f["answer"].alias("answer"), f["has_figure"].alias("has_figure"), f["has_table"].alias("has_table"), F.array_join(f["components"], ",").alias("components"), F.array_join(f["warnings"], ",").alias("warnings"))


@query()
def recognised_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a problem: number, stem, formulas, choices, answer and verdict."""
    return _flat(recognised(raw_problems(spark, sf_dir), "raw"))


@query()
def scanned_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as an OCR engine's output, of which nothing is taken as certain."""
    return _flat(recognised(raw_problems(spark, sf_dir), "raw", scan=True))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, '. ')) AS s, generate_subscripts(string_split(text, '. '), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, i, CASE (doc_id + i) % 9 WHEN 0 THEN '# 0' || (100 + i % 800) || ' ' WHEN 1 THEN '05-3 ' WHEN 2 THEN '① ' WHEN 3 THEN '보기 ' WHEN 4 THEN '![x](y) 12. ' WHEN 5 THEN '(가) ' WHEN 6 THEN '문제 2 ' WHEN 7 THEN '[4] ' ELSE '' END || s AS t FROM l),
p AS (SELECT doc_id, i, trim(regexp_replace(regexp_replace(regexp_replace(t, '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '^#{1,6}\s*', ''), '\s+', ' ', 'g')) AS t, (doc_id + i) % 9 AS k FROM m)
SELECT doc_id, CAST(i AS BIGINT) AS line, CASE WHEN k = 0 THEN '0' || (100 + i % 800) WHEN k = 1 THEN '05-3' WHEN k = 4 THEN '12' WHEN k = 7 THEN '4' END AS number, CASE WHEN k = 0 THEN 'four_digit' WHEN k = 1 THEN 'section' WHEN k IN (4, 7) THEN 'dotted' END AS kind,
CASE WHEN t = '' THEN 'empty' WHEN k IN (2, 3, 5) THEN 'choice_or_보기_label' WHEN k = 0 THEN 'leading_four_digit' WHEN k = 1 THEN 'theory_section_id' WHEN k IN (4, 7) THEN 'dotted_or_bracket_number' ELSE 'no_problem_number' END AS reason FROM p
WHERE NOT regexp_matches(t, '^(\d|\[)') OR k IN (0, 1, 4, 7)""")
def workbook_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each sentence says of a problem's number, with heads of a workbook put before it; sentences that begin with a number of their own are left to the test."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("i", "s"))
    k = (F.col("doc_id") + F.col("i")) % 9
    head = F.when(k == 0, F.concat(F.lit("# 0"), (100 + F.col("i") % 800).cast("string"), F.lit(" "))).when(k == 1, "05-3 ").when(k == 2, "① ").when(k == 3, "보기 ").when(k == 4, "![x](y) 12. ").when(k == 5, "(가) ").when(k == 6, "문제 2 ").when(k == 7, "[4] ").otherwise("")
    read = d.select("doc_id", F.col("i").cast("long").alias("line"), k.alias("k"), F.concat(head, "s").alias("t")).withColumn("a", R.workbook_anchor(F.col("t")))
    own = R.strip(F.col("t")).rlike(r"^(\d|\[)") & ~F.col("k").isin(0, 1, 4, 7)
    return read.where(~own).select("doc_id", "line", "a.number", "a.kind", "a.reason")


@query(r"""WITH k AS (SELECT doc_id, doc_id % 7 + 2 AS a, CASE WHEN doc_id % 3 = 0 THEN doc_id % 5 + 2 ELSE doc_id % 7 + 2 END AS b, doc_id % 4 AS f, list_filter(string_split(COALESCE(text, ''), ' '), lambda w: regexp_matches(w, '^[a-z]+$')) AS w FROM documents)
SELECT doc_id, array_to_string(list_concat(list_concat(CASE WHEN a <> b THEN ['exponent_mismatch:x^' || a || ' vs x^' || b] ELSE [] END, CASE WHEN f = 1 THEN ['subscript_mismatch:a_1 vs a_2'] ELSE [] END),
  list_concat(CASE WHEN f = 2 THEN ['fraction_mismatch:1/' || COALESCE(w[1], 'q') || ' vs 2/' || COALESCE(w[1], 'q')] ELSE [] END, CASE WHEN f = 3 THEN ['radical_mismatch:2,' || COALESCE(w[1], 'q') || ' vs 3'] ELSE [] END)), ';') AS conflicts FROM k""")
def formula_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two readings' formulas disagree on; a word of each document stands in fractions and roots."""
    k, f = F.col("doc_id"), F.col("doc_id") % 4
    word = F.coalesce(F.get(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w.rlike(r"^[a-z]+\z")), F.lit(0)), F.lit("q"))
    power = lambda n: F.concat(F.lit(r"\left( x^{"), n.cast("string"), F.lit(r"} \right) \le 3"))
    left = F.array(power(k % 7 + 2), F.when(f == 1, "a_{1} + y²").when(f == 2, F.concat(F.lit(r"\frac{1}{"), word, F.lit("}"))).when(f == 3, F.concat(F.lit(r"\sqrt{2} \sqrt{"), word, F.lit("}"))).otherwise("y³"))
    right = F.array(power(F.when(k % 3 == 0, k % 5 + 2).otherwise(k % 7 + 2)), F.when(f == 1, "a_2 + y^2").when(f == 2, F.concat(F.lit(r"\frac{2}{"), word, F.lit("}"))).when(f == 3, F.lit(r"\sqrt{3}")).otherwise("y^{3}"))
    told = F.transform(R.formula_conflicts(left, right), lambda c: F.concat(c["code"], F.lit(":"), c["detail"]))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(told, ";").alias("conflicts"))
