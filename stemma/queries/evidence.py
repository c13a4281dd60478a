"""Types of all documents strengthened by what their words, structure and neighbours say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..operators.evidence import strengthened_types, with_neighbours
from ..sources.tables import table

TYPES = ["LINEAR", "QUADRATIC", "MATRIX", "CUBIC_QUARTIC_EQ"]


def typed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items with a first type: the words of a text give its stem's type, its commas, sentences and lines the structure, strategy and key points; headings, reviews and flags go by doc_id."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    count = lambda p: F.regexp_count(text, F.lit(p))
    pick = lambda n: F.get(F.array(*map(F.lit, TYPES)), F.pmod(n, F.lit(len(TYPES))).cast("int"))
    commas, stops, words = count(","), count(r"\."), F.size(F.split(text, " "))
    intent = F.when(text.rlike("thand|ation"), "LINEAR").when(text.rlike("eiten|ung"), "QUADRATIC").when(text.rlike("ción|mente"), "MATRIX").when(text.rlike("ouque"), "CUBIC_QUARTIC_EQ")
    level = lambda i: F.pmod(commas + F.lit(i), F.lit(4))
    agreement = F.map_from_arrays(F.array(*map(F.lit, TYPES)), F.array(*[F.when(level(i) < 2, "SUPPORT").when(level(i) == 2, "WEAK").otherwise("CONFLICT") for i in range(len(TYPES))]))
    some = lambda n, every: F.filter(F.array(*map(F.lit, TYPES)), lambda t: F.pmod(F.length(t) + n, F.lit(every)) != 0)
    kind = F.when(k % 6 == 0, "TYPE_UNCLEAR").otherwise(pick(words))
    reasons = F.array_compact(F.array(F.when(k % 11 == 3, "TYPE_HEADING_STEM_MISMATCH"), F.when(k % 13 == 4, "UNIT_CONFLICT"), F.when(k % 7 == 2, "SUBUNIT_HEADING_RISK")))
    rows = d.select(
        "doc_id", "source", kind.alias("type"), (0.55 + F.pmod(words, F.lit(30)) / 100).alias("confidence"), text.alias("stem"), F.when(k % 3 != 1, intent).alias("stem_intent"), F.when(k % 4 == 0, pick(k)).when(k % 4 == 1, kind).alias("heading"), F.when(k % 5 != 0, pick(commas)).alias("inferred"), agreement.alias("agreement"),
        some(stops, 3).alias("strategies"), some(words, 2).alias("key_points"), some(commas, 4).alias("requested"), reasons.alias("review_reasons"), F.pmod(stops, F.lit(3)).alias("conditions"), (k % 9 != 2).alias("unit_auto"), (k % 17 == 6).alias("insufficient"), (k % 8 != 5).alias("anchor"), (k % 10 == 7).alias("old_auto"), (F.pmod(words, F.lit(3)) != 0).alias("auto"),
    )
    return rows


@query()
def strengthened_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's type, how certain it is, and why not."""
    found = strengthened_types(with_neighbours(typed_documents(spark, sf_dir), ["source"], ["doc_id"]))
    f = F.col("found")
    return found.select("doc_id", *[f[c].alias(c) for c in ("type", "coverage", "overall", "reason", "candidate")], F.round(f["confidence"], 6).alias("confidence"), F.array_join(f["boosts"], ",").alias("boosts"), F.array_join(f["conflicts"], ",").alias("conflicts"))
