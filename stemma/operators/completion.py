"""Types for a whole collection: votes by structure and section, nearest neighbours and fingerprints, in a fixed order of trust."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import confirm_type
from ..functions.text import tags
from .stats import majority

#: Votes that a structure's and a section's type need.
KEY_VOTES, SECTION_VOTES = 2, 1


def complete_types(items: DataFrame, allowed: DataFrame, conflict: Callable[[Column], Column], item: str = "item") -> DataFrame:
    """A type for every item that evidence gives one: (item, type, confirmation, reasons, persist, clear_review).

    items: item, section, key (structure), content, source, neighbour, ai (candidate types), cached (a sure type, or null), current (has a version), protected,
    review_status, leak. allowed: (section, type); what a section does not allow counts as no evidence, sections of no types included. The cached types
    vote: a structure's type needs KEY_VOTES, a section's SECTION_VOTES; ties go to the smaller type. conflict(type): the item's fingerprint speaks against it.
    A cached type stays. Votes are one row a key or section, so a hot one only meets its own rows.
    """
    sure = items.where("cached is not null and section is not null")
    by_key = majority(sure, ["section", "key"], "cached", KEY_VOTES).select("section", "key", F.col("cached").alias("__by_key"))
    by_section = majority(sure, ["section"], "cached", SECTION_VOTES).select("section", F.col("cached").alias("__by_section"))
    types = allowed.groupBy("section").agg(F.collect_set("type").alias("__allowed"))
    rows = items.join(by_key, ["section", "key"], "left").join(by_section, "section", "left").join(types, "section", "left")
    ok = lambda c: F.when(F.coalesce(F.array_contains("__allowed", F.col(c)), F.lit(False)), F.col(c))
    names = {"cached": "cached", "content": "content", "source": "source", "ai": "ai", "section": "__by_section"}
    rows = rows.select("*", *[ok(c).alias(f"__ok_{n}") for n, c in names.items()], F.coalesce(ok("__by_key"), ok("neighbour")).alias("__ok_cluster"))
    e = {n: F.col(f"__ok_{n}") for n in (*names, "cluster")}
    preferred = F.coalesce(e["cached"], e["content"], e["cluster"], e["section"], e["ai"])
    rows = rows.withColumn("__preferred", preferred)
    agrees = F.col("__preferred").isNotNull() & ~F.coalesce(conflict(F.col("__preferred")), F.lit(False))
    cached = e["cached"].isNotNull()
    rows = rows.withColumn("__d", confirm_type(e["content"], e["source"], e["cluster"], e["section"], e["ai"], cached, agrees))
    rows = rows.withColumn("type", F.coalesce(e["cached"], F.col("__d.type"), F.col("__preferred")))
    found = F.col("type").isNotNull()
    rows = rows.withColumn("confirmation", F.when(cached, "SOURCE_CONFIRMED").when(found, F.col("__d.by")).otherwise("LOW_CONFIDENCE_REVIEW"))
    low = F.col("confirmation") == "LOW_CONFIDENCE_REVIEW"
    known, yes = F.col("section").isNotNull(), lambda c: F.coalesce(F.col(c), F.lit(False))
    reasons = tags(NO_SECTION=~known, TYPE_UNRESOLVED=known & ~found, LOW_CONFIDENCE_REVIEW=known & low, PROTECTED=yes("protected"))
    persist = found & yes("current") & ~yes("protected")
    clear = persist & ~low & (F.coalesce("review_status", F.lit("")) == "NEEDS_REVIEW") & ~yes("leak")
    return rows.select(item, "type", "confirmation", reasons.alias("reasons"), persist.alias("persist"), clear.alias("clear_review"))
