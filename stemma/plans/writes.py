"""Idempotent plans: running one twice changes nothing the second time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_number
from ..operators.scan import running


def identity_upsert(incoming: DataFrame, stored: DataFrame, *, doc: str = "doc", page: str = "page", number: str = "number", stored_id: str = "problem_id", verified: str = "verified", created: str = "created") -> DataFrame:
    """(identity, action, existing): CREATED, EXISTING_DRAFT or EXISTING_VERIFIED per identity document|page|canonical number.

    Incoming rows of one identity are one; without a canonical number there is none and the row is dropped. Of several stored rows the
    verified one counts, then the oldest.
    """
    key = lambda: F.concat_ws("|", F.col(doc).cast("string"), F.col(page).cast("string"), canonical_number(F.col(number)))
    known = F.col(page).isNotNull() & F.col(doc).isNotNull() & canonical_number(F.col(number)).isNotNull()
    new = incoming.where(known).select(key().alias("identity")).distinct()
    old = stored.where(known).groupBy(key().alias("identity")).agg(F.min_by(F.struct(stored_id, verified), F.struct((~F.col(verified)).alias("a"), F.col(created).alias("b"), F.col(stored_id).alias("c"))).alias("o"))
    action = F.when(F.col("o").isNull(), "CREATED").when(F.col(f"o.{verified}"), "EXISTING_VERIFIED").otherwise("EXISTING_DRAFT")
    return new.join(old, "identity", "left").select("identity", action.alias("action"), F.col(f"o.{stored_id}").alias("existing"))


def merge_plan(incoming: DataFrame, stored: DataFrame, keys: list[str], values: Sequence[str], protected: Column | None = None) -> DataFrame:
    """Incoming rows (one per key) with action: CREATE, UPDATE if any value differs (null-safe), SKIP, or BLOCKED where the stored row is protected."""
    old = stored.select(*keys, *[F.col(v).alias(f"__{v}") for v in values], (F.lit(False) if protected is None else F.coalesce(protected, F.lit(False))).alias("__p"), F.lit(True).alias("__k"))
    joined = incoming.join(old, keys, "left")
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"__{v}"))
    action = F.when(F.col("__k").isNull(), "CREATE").when(same, "SKIP").when(F.col("__p"), "BLOCKED").otherwise("UPDATE")
    return joined.withColumn("action", action).drop("__p", "__k", *[f"__{v}" for v in values])


def append_new(plan: DataFrame, path: str, keys: list[str]) -> None:
    """Append the plan's CREATE rows that are not at the path yet."""
    spark = plan.sparkSession
    rows = plan.where("action = 'CREATE'").drop("action")
    try:
        rows = rows.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    except AnalysisException as e:  # the first write has nothing to read
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    rows.write.mode("append").parquet(path)


def append_versions(current: DataFrame, edits: DataFrame, key: str, text: str, origin: str = "AUTO_CLEAN") -> DataFrame:
    """Edits (key, new_text) against versions (key, version_no, text, origin, verified): a row per edit with what it does and the version appended.

    In this order an edit is skipped: no version there, a teacher's edit on top, verified, blank, unchanged.
    """
    last = current.groupBy(key).agg(F.max_by(F.struct("version_no", text, "origin", "verified"), "version_no").alias("v"))
    joined = edits.join(last, key, "left")
    blank = F.trim(F.coalesce("new_text", F.lit(""))) == ""
    action = (
        F.when(F.col("v").isNull(), "SKIP_MISSING").when(F.col("v.origin") == "TEACHER", "SKIP_TEACHER").when(F.coalesce("v.verified", F.lit(False)), "SKIP_VERIFIED").when(blank, "SKIP_BLANK").when(F.col("new_text").eqNullSafe(F.col(f"v.{text}")), "SKIP_UNCHANGED").otherwise("APPEND")
    )
    return joined.select(key, action.alias("action"), F.when(action == "APPEND", F.col("v.version_no") + 1).alias("version_no"), F.when(action == "APPEND", F.lit(origin)).alias("origin"))


def replace_children(versions: DataFrame, key: str, payload: str, child: str) -> DataFrame:
    """Rows of a child table from an array column: key, ordinal from 1, and the element; what is written replaces the key's rows."""
    return versions.select(key, F.posexplode(payload).alias("p", child)).select(key, (F.col("p") + 1).cast("long").alias("ordinal"), child)


def apply_overrides(rows: DataFrame, overrides: DataFrame, key: str, value: str, expected_hash: str = "expected_hash") -> DataFrame:
    """Rows with overridden values; an override whose expected hash no longer matches the row is left out."""
    new = overrides.select(key, F.col(value).alias("__v"), F.col(expected_hash).alias("__h"))
    joined = rows.join(new, key, "left")
    fits = F.coalesce(F.col("__h") == F.sha2(F.col(value), 256), F.lit(False))
    marked = joined.withColumn("overridden", fits)
    return marked.withColumn(value, F.when(F.col("overridden"), F.col("__v")).otherwise(F.col(value))).drop("__v", "__h")


def pages_to_do(pages: DataFrame, done: DataFrame, cached: DataFrame, *, page: str = "page", digest: str = "digest", price: float = 0.005, cap: float | None = None) -> DataFrame:
    """Pages that are new or changed since the last run: CACHE_HIT where the content was read before, else OCR as long as the money lasts, else OVER_CAP."""
    before = done.select(page, F.col(digest).alias("__d"))
    open_ = pages.join(before, page, "left").where(~F.col(digest).eqNullSafe(F.col("__d"))).drop("__d")
    hit = open_.join(cached.select(page, digest, F.lit(True).alias("__c")), [page, digest], "left").withColumn("__c", F.coalesce("__c", F.lit(False)))
    if cap is None:
        return hit.withColumn("action", F.when(F.col("__c"), "CACHE_HIT").otherwise("OCR")).drop("__c")
    within = F.round(F.col("__n") * price, 6) <= cap
    return running(hit, ["__c"], [page], {"__n": ("count", F.lit(1))}).withColumn("action", F.when(F.col("__c"), "CACHE_HIT").when(within, "OCR").otherwise("OVER_CAP")).drop("__c", "__n")


def validate(rows: DataFrame, key: str, checks: Mapping[str, Column]) -> DataFrame:
    """(key, problems): rows that break a check (a condition that must hold; unknown breaks it), with the names of those."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    return rows.select(key, found.alias("problems")).where(F.size("problems") > 0)


def next_stage(runs: DataFrame, done: DataFrame, stages: Sequence[str], run: str = "run_id", stage: str = "stage") -> DataFrame:
    """(run, next): the first stage in order that a run has not done; null where all are."""
    had = done.groupBy(run).agg(F.collect_set(stage).alias("__had"))
    every = F.array(*[F.lit(s) for s in stages])
    left = F.filter(every, lambda s: ~F.array_contains(F.coalesce("__had", F.array().cast("array<string>")), s))
    return runs.select(run).distinct().join(had, run, "left").select(run, F.get(left, F.lit(0)).alias("next"))
