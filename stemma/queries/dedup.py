"""Duplicates, fingerprints and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.text import normal_text
from ..operators import dedup as D
from ..sources.tables import table
from ..sources.views import PROBLEMS_SQL, problems

#: The normal form in RE2; the replacements are the same.
_NORMAL = r"""regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace({0}, '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '$$', '$'), '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g')"""
_FP = f"CASE WHEN length(regexp_replace({_NORMAL.format('text')}, '\\s+', '', 'g')) >= 12 THEN sha256({_NORMAL.format('text')}) END"


@query(f"SELECT doc_id, {_NORMAL.format('text')} AS plain, CAST(length({_NORMAL.format('text')}) AS BIGINT) AS n FROM documents")
def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal form of every text."""
    plain = normal_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", plain.alias("plain"), F.length(plain).cast("long").alias("n"))


@query(f"WITH h AS (SELECT doc_id, {_FP} AS fingerprint FROM documents) SELECT h.doc_id, fingerprint, copies, keeper FROM h JOIN (SELECT fingerprint, CAST(count(*) AS BIGINT) AS copies, min(doc_id) AS keeper FROM h WHERE fingerprint IS NOT NULL GROUP BY fingerprint HAVING count(*) > 1) USING (fingerprint)")
def exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with equal normal forms."""
    return D.exact_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""WITH {PROBLEMS_SQL}, r AS (SELECT doc_id, page, number, {_FP} AS fp, length(regexp_replace({_NORMAL.format('text')}, '\\s+', '', 'g')) AS chars FROM problems),
k AS (SELECT fp, arg_min({{'keeper': doc_id, 'kpage': page, 'knumber': number}}, (COALESCE(TRY_CAST(regexp_replace(number, '[^0-9]', '', 'g') AS BIGINT), page * 10000, 0), COALESCE(page, 0), doc_id)) AS g FROM r WHERE fp IS NOT NULL GROUP BY fp HAVING count(*) > 1),
p AS (SELECT r.*, g.keeper AS keeper, COALESCE(page = g.kpage, FALSE) AS sp, COALESCE(number = g.knumber, FALSE) AS sn FROM r JOIN k USING (fp) WHERE doc_id <> g.keeper)
SELECT doc_id, keeper, CASE WHEN (sp AND sn) OR (chars >= 80 AND sp) THEN 'EXACT_DUPLICATE' WHEN chars < 80 AND NOT sn THEN 'SIMILAR_DISTINCT' ELSE 'UNCERTAIN' END AS kind,
  CASE WHEN (sp AND sn) OR (chars >= 80 AND sp) THEN 'LINKED' WHEN chars < 80 AND NOT sn THEN 'KEPT_DISTINCT' ELSE 'HUMAN_REVIEW' END AS status,
  (sp AND sn) OR (chars >= 80 AND sp) AS block_extra, (sp AND sn) OR (chars >= 80 AND sp) OR (chars < 80 AND NOT sn) AS clears FROM p""")
def dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each copy against the one that stays, and what kind of pair they are."""
    return D.duplicate_pairs(problems(spark, sf_dir), "doc_id", "text", "page", "number")


@query(f"""WITH {PROBLEMS_SQL}, k AS (SELECT doc_id, public_code, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS k FROM problems), g AS (SELECT k, min(public_code) AS kept_code FROM k WHERE length(k) >= 24 GROUP BY k HAVING count(*) > 1)
SELECT doc_id, public_code, kept_code FROM k JOIN g USING (k) WHERE public_code <> kept_code""")
def dup_keeper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extras under the loose key, and the code that stays."""
    return D.keepers(problems(spark, sf_dir), "doc_id", "text", "public_code")


@query(f"""SELECT DISTINCT doc_id, kind, value FROM (SELECT doc_id, 'NORMALIZED_TEXT' AS kind, {_FP} AS value FROM documents UNION ALL SELECT doc_id, 'STRUCTURE', sha256(lang || '|' || source) FROM documents UNION ALL SELECT doc_id, 'FILE_HASH', sha256(text) FROM documents) WHERE value IS NOT NULL""")
def fingerprint_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fingerprints of all documents."""
    return D.fingerprints(table(spark, sf_dir, "documents"), "doc_id", "text", F.concat_ws("|", "lang", "source"), F.col("text"))


@query("""WITH n AS (SELECT page_id, sha256(html) AS h FROM pages), o AS (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'stale' ELSE sha256(html) END AS h FROM pages WHERE page_id % 4 <> 0)
SELECT n.page_id, n.h, CASE WHEN o.page_id IS NULL THEN 'NEW' ELSE 'CHANGED' END AS change FROM n LEFT JOIN o ON n.page_id = o.page_id WHERE o.page_id IS NULL OR n.h IS DISTINCT FROM o.h""")
def changed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are new or whose hash moved since an earlier crawl (a quarter was not in it, a ninth of the rest differs)."""
    now = table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("h"))
    before = now.where("page_id % 4 <> 0").withColumn("h", F.when(F.col("page_id") % 9 == 0, "stale").otherwise(F.col("h")))
    return D.changed(now, before, "page_id", "h")


@query("SELECT l_partkey, l_suppkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part and supplier pairs on more than one line."""
    return D.repeated_keys(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey").withColumnRenamed("count", "n")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without labels."""
    return D.orphans(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query(f"""WITH f AS (SELECT doc_id, {_FP} AS fp FROM documents), q AS (SELECT DISTINCT fp FROM f WHERE doc_id % 20 = 0 AND fp IS NOT NULL)
SELECT doc_id, fp FROM f WHERE fp IS NOT NULL AND fp NOT IN (SELECT fp FROM q)""")
def anti_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that share no fingerprint with any of the queries (every id that 20 divides)."""
    f = table(spark, sf_dir, "documents").select("doc_id", D.fingerprint(F.col("text")).alias("fp")).where("fp is not null")
    return f.join(f.where("doc_id % 20 = 0").select("fp").distinct(), "fp", "left_anti").select("doc_id", "fp")
