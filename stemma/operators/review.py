"""Runs and reviews as a whole: when to stop, what a gate would change, what is left to people, and copies of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tags

#: When a run of a first stage stops.
LEAST_ATTEMPTS, FAIL_RATE, SAME_ERRORS, MOST_UNKNOWN, MOST_FAILED = 8, 0.15, 3, 40, 20
TEXT_ATTEMPTS, LEAST_MEDIAN, MOST_LEAKED, MANY_PROBLEMS = 20, 40, 5, 170
#: Verdicts that leave work to people, and levels of verified relations.
HUMAN_VERDICTS = ("REVIEW_REQUIRED", "BLOCKED", "PAID_OCR_CANDIDATE")
RELATION_LEVELS = ("T1", "T2", "T3", "RELATED", "NOT_RELATED")
#: Vertical overlap that counts, that of a sure owner, and the second's share of it that makes an owner doubtful.
LEAST_OVERLAP, SURE_OVERLAP, RIVAL = 0.02, 0.08, 0.7


def longest_repeat(rows: DataFrame, key: str, order: list[str], error: Column) -> DataFrame:
    """(key, longest): the most rows in a row of one key with the same error; rows without one end a repeat."""
    own = W.partitionBy(key).orderBy(*order)
    step = rows.select(key, *order, error.alias("__e")).withColumn("__new", (~F.col("__e").eqNullSafe(F.lag("__e").over(own))).cast("int"))
    runs = step.withColumn("__run", F.sum("__new").over(own)).groupBy(key, "__run").agg(F.count("__e").alias("n"))
    return runs.groupBy(key).agg(F.max("n").alias("longest"))


def stop_reasons(c: dict[str, Column]) -> Column:
    """Why a run should stop, in order; empty where it may go on.

    c: attempted, failed, longest (same errors in a row), unknown, problem, answer, explanation, median_length, leaked.
    """
    attempted, failed = c["attempted"], c["failed"]
    return tags(
        ocr_fail_rate_high=(attempted >= LEAST_ATTEMPTS) & (failed / attempted >= FAIL_RATE),
        repeated_same_error=c["longest"] >= SAME_ERRORS,
        classifier_mass_unknown=c["unknown"] >= MOST_UNKNOWN,
        ocr_failed_mass=failed >= MOST_FAILED,
        ocr_text_systematic_corruption=(attempted >= TEXT_ATTEMPTS) & (c["median_length"] < LEAST_MEDIAN),
        answer_explanation_problem_confusion=c["leaked"] >= MOST_LEAKED,
        answer_section_missing_suspicious=(c["problem"] >= MANY_PROBLEMS) & (c["answer"] + c["explanation"] == 0),
    )


def simulate_gates(rows: DataFrame, before: Column, after: Column, unsafe: Column) -> DataFrame:
    """A row for each gate: what it lets through, holds back and lets through wrongly; and how many reviews the new one saves."""
    n = lambda c: F.count_if(c)
    counts = rows.agg(F.count("*").alias("n"), n(before).alias("b"), n(after).alias("a"), n(~before & unsafe).alias("bu"), n(~after & unsafe).alias("au"))
    of = lambda name, held, bad: F.struct(F.lit(name).alias("gate"), (F.col("n") - F.col(held)).alias("auto"), F.col(held).alias("review"), F.col(bad).alias("unsafe_auto"))
    return counts.select(F.explode(F.array(of("old", "b", "bu"), of("candidate", "a", "au"))).alias("g"), (F.col("b") - F.col("a")).alias("review_reduction")).select("g.*", "review_reduction")


def review_reduction(rows: DataFrame, group: str, verdict: str) -> DataFrame:
    """Per group: items that reviews began with, those that are left to people, and the share that is not, in per cent to one place."""
    counts = rows.groupBy(group).agg(F.count("*").alias("start_review"), F.count_if(F.col(verdict).isin(*HUMAN_VERDICTS)).alias("human_remaining"))
    return counts.withColumn("reduction_pct", F.round((F.col("start_review") - F.col("human_remaining")) / F.col("start_review") * 100, 1))


def sidebar_owners(bars: DataFrame, boxes: DataFrame, page: str = "page", item: str = "item") -> DataFrame:
    """Which box of its page each side bar stands beside, by vertical overlap: (page, bar, owner, overlap, ambiguous, auto_allowed).

    bars: page, bar, y, h; boxes: page, item, y, h. Of equal overlaps the smallest item owns; bars beside nothing have no owner.
    """
    b = bars.select(page, "bar", F.col("y").alias("by"), F.col("h").alias("bh"))
    overlap = F.least(F.col("by") + F.col("bh"), F.col("y") + F.col("h")) - F.greatest("by", "y")
    met = b.join(boxes, page).select(page, "bar", F.col(item).alias("owner"), overlap.alias("overlap")).where(F.col("overlap") > LEAST_OVERLAP)
    ranked = met.withColumn("nth", F.row_number().over(W.partitionBy(page, "bar").orderBy(F.desc("overlap"), "owner"))).where("nth <= 2")
    best = ranked.groupBy(page, "bar").agg(F.max(F.when(F.col("nth") == 1, F.col("owner"))).alias("owner"), F.max("overlap").alias("overlap"), F.max(F.when(F.col("nth") == 2, F.col("overlap"))).alias("second"))
    rival = F.coalesce(F.col("second") > F.col("overlap") * RIVAL, F.lit(False))
    out = b.select(page, "bar").join(best, [page, "bar"], "left").withColumn("ambiguous", rival)
    return out.select(page, "bar", "owner", F.coalesce("overlap", F.lit(0.0)).alias("overlap"), "ambiguous", (F.col("owner").isNotNull() & ~F.col("ambiguous") & (F.coalesce("overlap", F.lit(0.0)) >= SURE_OVERLAP)).alias("auto_allowed"))


def copy_versions(versions: DataFrame, asked: DataFrame, *, item: str = "item", version: str = "version", status: str = "status", payload: str = "payload", new_item: str = "new_item") -> DataFrame:
    """What becomes of requests (item, version, kind, new_item) to copy a version: (item, version, kind, action, to_item, to_version, to_status, payload).

    FORK gives a draft after the newest version, unless the item has a draft already, which is then named (EXISTING). RESTORE gives a current version after
    the newest. DUPLICATE gives version 1 of new_item. A version that is not there is MISSING. Nothing is changed in place; requests are
    one row per item, version and kind.
    """
    source = versions.select(item, version, F.col(payload).alias("__p"), F.lit(True).alias("__there"))
    last = versions.groupBy(item).agg(F.max(version).alias("__last"), F.max(F.when(F.col(status) == "DRAFT", F.col(version))).alias("__draft"))
    rows = asked.dropDuplicates([item, version, "kind"]).join(source, [item, version], "left").join(last, item, "left")
    there = F.coalesce("__there", F.lit(False))
    draft = there & (F.col("kind") == "FORK") & F.col("__draft").isNotNull()
    action = F.when(~there, "MISSING").when(draft, "EXISTING").otherwise("CREATE")
    to_item = F.when(there, F.when(F.col("kind") == "DUPLICATE", F.col(new_item)).otherwise(F.col(item)))
    to_version = F.when(draft, F.col("__draft")).when(there, F.when(F.col("kind") == "DUPLICATE", F.lit(1)).otherwise(F.col("__last") + 1))
    to_status = F.when(there, F.when(F.col("kind") == "RESTORE", "CURRENT").otherwise("DRAFT"))
    return rows.select(item, version, "kind", action.alias("action"), to_item.alias("to_item"), to_version.cast("long").alias("to_version"), to_status.alias("to_status"), F.when(there & ~draft, F.col("__p")).alias("payload"))


def relation_faults(relations: DataFrame, a: str, b: str, level: str) -> DataFrame:
    """Verified relations that break a rule: (a, b, level, faults): PAIR_ORDER, LEVEL and REPEATED_PAIR. A rule on a null does not fail, but for the ends."""
    many = relations.groupBy(a, b).count().where("count > 1").select(F.col(a).alias("__a"), F.col(b).alias("__b"))
    known = relations.join(many, (F.col(a) == F.col("__a")) & (F.col(b) == F.col("__b")), "left")
    ordered = F.coalesce(F.col(a) < F.col(b), F.lit(False))
    faults = tags(PAIR_ORDER=~ordered, LEVEL=F.coalesce(~F.col(level).isin(*RELATION_LEVELS), F.lit(False)), REPEATED_PAIR=F.col("__a").isNotNull())
    return known.select(a, b, level, faults.alias("faults")).where(F.size("faults") > 0)


def page_groups(candidates: DataFrame, listed: DataFrame, keys: list[str], page: str = "page", number: str = "number") -> DataFrame:
    """Candidates by page and keys: how many, and the least and greatest number listed on the page (of the candidates where none is), as 0001~0099."""
    on = listed.groupBy(page).agg(F.min(number).alias("__lo"), F.max(number).alias("__hi"))
    met = candidates.groupBy(page, *keys).agg(F.count("*").alias("candidates"), F.min(number).alias("__a"), F.max(number).alias("__z")).join(on, page, "left")
    pad = lambda c: F.lpad(c.cast("string"), 4, "0")
    return met.select(page, *keys, "candidates", F.concat(pad(F.coalesce("__lo", "__a")), F.lit("~"), pad(F.coalesce("__hi", "__z"))).alias("number_range"))
