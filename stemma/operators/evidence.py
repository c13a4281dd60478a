"""Types strengthened by evidence: stem, heading, structure, strategy and neighbours for and against a type, and why an item stays in review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import decide
from .scan import running

#: The types that say nothing and that are new, the confidence that makes a type certain, the most that it can be, and what evidence adds.
UNCLEAR, NEW_TYPE, LEAST, MOST = "TYPE_UNCLEAR", "CUBIC_QUARTIC_EQ", 0.78, 0.93
BOOSTS = {"math_structure": 0.10, "strategy": 0.08, "key_point": 0.04, "heading_alias": 0.04, "neighbor_cluster": 0.03}
#: The shortest stem that can be judged, and words that name a condition.
LEAST_STEM, CONDITION_WORDS = 12, r"단,|\(가\)"


def with_neighbours(rows: DataFrame, group: list[str], order: list[str], type_col: str = "type", auto_col: str = "auto", parts: int | None = None) -> DataFrame:
    """Rows with neighbour_type: the type of the rows just before and after them in their group, if both are certain and of one type; groups of any size (see scan.running())."""
    own = F.struct(F.col(type_col).alias("t"), F.coalesce(F.col(auto_col), F.lit(False)).alias("a"))
    before = running(rows, group, order, {"__before": ("last", own)}, strict=True, parts=parts)
    both = running(before, group, [F.col(c).desc() for c in order], {"__after": ("last", own)}, strict=True, parts=parts)
    same = F.col("__before.a") & F.col("__after.a") & (F.col("__before.t") == F.col("__after.t"))
    return both.withColumn("neighbour_type", F.when(same, F.col("__before.t"))).drop("__before", "__after")


def strengthened_types(rows: DataFrame) -> DataFrame:
    """Rows with found: struct(type, confidence, coverage, overall, reason, boosts, conflicts, candidate).

    rows: type, confidence, stem, stem_intent, heading, inferred (types by the stem's words, by the heading, by the structure), agreement (map of type to SUPPORT, WEAK or CONFLICT),
    strategies, key_points, requested (arrays of the types that the stem's strategy, key points and requested quantity fit), neighbour_type, review_reasons, conditions (how many),
    unit_auto, insufficient, anchor, old_auto. The candidate is the stem's type, else the structure's if it is supported, else the row's. A candidate that its
    structure, strategy and key points support, with no conflict and not by heading or neighbours alone, becomes certain (NEW_AUTO) from LEAST on. What was
    certain stays (OLD_AUTO); all else stays in review with the first reason that holds. Null flags are false, null arrays empty, and agreement that is not known is WEAK.
    """
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    none = F.array().cast("array<string>")
    has = lambda name, value: yes(F.array_contains(F.coalesce(c(name), none), value))
    agrees = lambda t: F.coalesce(F.try_element_at("agreement", t), F.lit("WEAK"))
    names = rows.columns
    known = F.coalesce("stem_intent", F.when(c("inferred").isNotNull() & (agrees(c("inferred")) == "SUPPORT"), c("inferred")), F.when(c("type") != UNCLEAR, c("type")))
    step = rows.withColumn("__candidate", known)
    candidate = c("__candidate")
    step = step.withColumn("__math", F.when(candidate.isNotNull(), agrees(candidate)).otherwise("WEAK"))
    support = c("__math") == "SUPPORT"
    heading, neighbour = c("heading"), c("neighbour_type")
    strategy = candidate.isNotNull() & has("strategies", candidate)
    step = step.withColumns({
        "__strategy": strategy, "__key": candidate.isNotNull() & (has("key_points", candidate) | support), "__agrees": yes(heading == candidate), "__same": yes(neighbour == candidate), "__fits": candidate.isNotNull() & has("requested", candidate),
        "__heading_only": heading.isNotNull() & c("stem_intent").isNull() & ~support,
    })
    neighbour_only = c("__same") & ~support & c("stem_intent").isNull()
    mismatch = yes(heading != candidate) & support
    differs = ~c("__agrees") & yes(heading != c("inferred")) & has("requested", c("inferred"))
    conflicts: list[tuple[Column, str]] = [
        (mismatch | has("review_reasons", F.lit("TYPE_HEADING_STEM_MISMATCH")), "heading_vs_math"), (yes(neighbour != candidate) & c("__strategy"), "neighbor_vs_strategy"), (differs, "alias_vs_requested_quantity"),
        (has("review_reasons", F.lit("UNIT_CONFLICT")), "unit_conflict"), (c("__math") == "CONFLICT", "math_conflict"),
    ]
    full = support & c("__strategy")
    boosts = {"math_structure": support, "strategy": c("__strategy"), "key_point": c("__key") & support, "heading_alias": c("__agrees") & full, "neighbor_cluster": c("__same") & c("__agrees") & full}
    raised = sum((F.when(t, BOOSTS[n]).otherwise(0.0) for n, t in boosts.items()), F.coalesce("confidence", F.lit(0.0)))
    told = lambda pairs: F.array_compact(F.array(*[F.when(t, v) for t, v in pairs]))
    step = step.withColumns({"__conflicts": told(conflicts), "__boosts": told([(t, n) for n, t in boosts.items()]), "__confidence": F.least(F.lit(MOST), F.round(raised, 3)), "__neighbour_only": neighbour_only})
    certain = candidate.isNotNull() & ~yes(candidate.isin(UNCLEAR, NEW_TYPE)) & support & c("__strategy") & c("__key") & (F.size("__conflicts") == 0) & ~c("__heading_only") & ~c("__neighbour_only") & (c("__confidence") >= LEAST)
    stem = F.coalesce("stem", F.lit(""))
    reason = decide(
        [
            (yes(c("insufficient")) | (F.length(stem) < LEAST_STEM), "OCR_INSUFFICIENT", ""), (c("__heading_only"), "HEADING_ONLY", ""), (c("__neighbour_only"), "NEIGHBOR_ONLY", ""), (F.size("__conflicts") > 0, "HEADING_CONFLICT", ""), (has("review_reasons", F.lit("UNIT_CONFLICT")), "UNIT_CONFLICT", ""),
            (yes(c("type") == NEW_TYPE) | yes(c("stem_intent") == NEW_TYPE), "NEW_TYPE_SUSPECTED", ""), (yes(c("stem_intent") != c("inferred")) & (c("__math") == "CONFLICT"), "MULTI_TYPE", ""), (yes(c("type") == UNCLEAR) & ~support, "TYPE_UNCLEAR", ""), (~support, "MATH_STRUCTURE_AMBIGUOUS", ""),
            (~c("__strategy"), "STRATEGY_AMBIGUOUS", ""), (has("review_reasons", F.lit("SUBUNIT_HEADING_RISK")), "SUBUNIT_UNCERTAIN", ""), (yes(c("conditions") == 0) & ~stem.rlike(CONDITION_WORDS) & ~c("__fits"), "CONDITION_UNCLEAR", ""), (~yes(c("anchor")), "NO_ANCHOR", ""),
        ],
        "TYPE_PROFILE_INSUFFICIENT",
    )["verdict"]
    old = yes(c("old_auto"))
    step = step.withColumn("__certain", certain & ~old)
    found = F.struct(
        F.when(c("__certain"), candidate).otherwise(c("type")).alias("type"), F.when(c("__certain"), c("__confidence")).otherwise(c("confidence")).alias("confidence"), F.when(old, "OLD_AUTO").when(c("__certain"), "NEW_AUTO").otherwise("REVIEW").alias("coverage"),
        F.when(old | (c("__certain") & yes(c("unit_auto")) & ~yes(c("insufficient"))), "AUTO").otherwise("REVIEW").alias("overall"), F.when(~old & ~c("__certain"), reason).alias("reason"), F.when(old, none).otherwise(c("__boosts")).alias("boosts"), c("__conflicts").alias("conflicts"), candidate.alias("candidate"),
    )
    return step.select(*names, found.alias("found"))
