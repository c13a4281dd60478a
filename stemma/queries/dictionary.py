"""Rule tables and alias dictionaries over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import dictionary as D
from ..sources.tables import table
from ..sources.views import ITEMS_SQL, items

_ALIASES = "a AS (SELECT w AS pattern, min(conv_id) AS priority, left(w, 4) AS label FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[a-z]{9,}')) AS w FROM conversations) GROUP BY w)"


def word_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of nine letters or more that conversations hold is a pattern; the conversation it is first met in is its priority, its first letters are the label."""
    said = table(spark, sf_dir, "conversations").select("conv_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{9,})"), F.lit(1))).alias("pattern"))
    return said.groupBy("pattern").agg(F.min("conv_id").alias("priority")).select("pattern", "priority", F.substring("pattern", 1, 4).alias("label"), F.lit(0.9).alias("confidence"))


@query(f"""WITH {_ALIASES}, h AS (SELECT d.doc_id, count(*) AS hits, arg_min(a.label, (a.priority, a.label, a.pattern)) AS label, arg_min(a.pattern, (a.priority, a.label, a.pattern)) AS pattern, min(a.priority) AS priority FROM documents d JOIN a ON contains(lower(d.text), a.pattern) GROUP BY d.doc_id)
SELECT d.doc_id, label, pattern, priority, COALESCE(hits, 0) AS hits FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id""")
def rule_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule of thousands that fits each document, and how many do."""
    found = D.first_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), word_rules(spark, sf_dir))
    return found.select("doc_id", "label", "pattern", "priority", "hits")


@query("""WITH t AS (SELECT DISTINCT lang AS type, ['own ' || lang, 'Über ' || lang] AS aliases FROM documents WHERE lang IS NOT NULL),
m AS (SELECT CASE WHEN doc_id % 7 = 0 OR lang IS NULL THEN 'REVIEW_' || CASE WHEN doc_id % 7 = 0 THEN 'zz' ELSE COALESCE(lang, '') END ELSE lang END AS type, source || ' ' || doc_id % 3 AS title, doc_id AS example FROM documents),
a AS (SELECT type, list_sort(list(DISTINCT title)) AS titles, list_sort(list(DISTINCT example))[1:5] AS examples FROM m GROUP BY type)
SELECT COALESCE(t.type, a.type) AS type, array_to_string(list_concat(COALESCE(t.aliases, []), COALESCE(a.titles, [])), ';') AS aliases, array_to_string(COALESCE(a.examples, []), ';') AS examples FROM t FULL JOIN a ON t.type = a.type""")
def alias_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types with the titles that documents add to their aliases, and five examples; titles of no known type go to review."""
    d = table(spark, sf_dir, "documents")
    types = d.where("lang IS NOT NULL").select(F.col("lang").alias("type"), F.array(F.concat(F.lit("own "), "lang"), F.concat(F.lit("Über "), "lang")).alias("aliases")).distinct()
    kind = F.when(F.col("doc_id") % 7 == 0, "zz").otherwise(F.col("lang"))
    headings = d.select(F.concat("source", F.lit(" "), (F.col("doc_id") % 3).cast("string")).alias("title"), kind.alias("type"), kind.alias("code"), F.col("doc_id").alias("example"))
    found = D.grown_dictionary(types, headings)
    return found.select("type", F.array_join("aliases", ";").alias("aliases"), F.array_join("examples", ";").alias("examples"))


@query(f"""WITH {ITEMS_SQL}, p AS (SELECT type_id, list_sort(list(DISTINCT brand)) AS concepts, list_sort(list(DISTINCT 'S' || size % 7)) AS strategies FROM items WHERE concept <> 3 GROUP BY type_id HAVING count(*) % 2 = 1)
SELECT item_id, items.type_id, array_to_string(COALESCE(concepts, []), ',') AS concepts, array_to_string(COALESCE(strategies, []), ',') AS strategies, p.type_id IS NOT NULL AS profiled FROM items LEFT JOIN p ON items.type_id = p.type_id""")
def expanded_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with the concepts and strategies of their type's profile."""
    rows = items(spark, sf_dir)
    profiles = rows.where("concept <> 3").groupBy("type_id").agg(F.array_sort(F.collect_set("brand")).alias("concepts"), F.array_sort(F.collect_set(F.concat(F.lit("S"), (F.col("size") % 7).cast("string")))).alias("strategies"), F.count("*").alias("n")).where("n % 2 = 1")
    found = D.expanded(rows.select("item_id", "type_id"), profiles, "type_id", ["concepts", "strategies"])
    return found.select("item_id", "type_id", F.array_join("concepts", ",").alias("concepts"), F.array_join("strategies", ",").alias("strategies"), "profiled")
