"""Decision lists: gates, routers and judges as CASE chains over evidence columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the gates.
HIGH, FIGURE_OWNERSHIP, UNIT, TYPE, OVERLAP = 0.78, 0.85, 0.8, 0.7, 0.25


def decide(rules: Sequence[tuple[Column, str, str]], otherwise: str) -> Column:
    """struct(verdict, rule): the first (condition, verdict, name) that is known to hold."""
    out = None
    for condition, verdict, name in rules:
        one = F.struct(F.lit(verdict).alias("verdict"), F.lit(name).alias("rule"))
        out = F.when(condition, one) if out is None else out.when(condition, one)
    rest = F.struct(F.lit(otherwise).alias("verdict"), F.lit("DEFAULT").alias("rule"))
    return out.otherwise(rest) if out is not None else rest


def confidence_gate(e: Mapping[str, Column]) -> Column:
    """AUTO_APPROVED, HUMAN_REVIEW or BLOCKED. e: math_conflict, neighbour_blocking, crop_unsafe, identity, ingested, has_stem, paid_ocr, compare_fail, figure, structure, checker_a and _b (least of four fields)."""
    human, blocked = "HUMAN_REVIEW", "BLOCKED"
    return decide(
        [
            (e["math_conflict"], human, "MATH_CONFLICT"),
            (e["neighbour_blocking"] | e["crop_unsafe"], blocked, "CROP"),
            (e["identity"] < 0.5, blocked, "IDENTITY"),
            (~e["ingested"] & ~e["has_stem"], blocked, "NOTHING_READ"),
            (~e["ingested"], human, "NOT_INGESTED"),
            (e["paid_ocr"], blocked, "PAID_OCR"),
            (e["compare_fail"], human, "IMAGE_COMPARE"),
            (e["figure"] < FIGURE_OWNERSHIP, human, "FIGURE"),
            ((e["identity"] < HIGH) | (e["structure"] < HIGH), human, "LOW_CONFIDENCE"),
            ((e["checker_a"] < HIGH) | (e["checker_b"] < HIGH), human, "CHECKERS"),
        ],
        "AUTO_APPROVED",
    )


def lifecycle_of(verdict: Column) -> Column:
    """What a verdict turns a draft into: struct(lifecycle, review_status, use_status, queued)."""
    as_ = lambda life, review, use, queued: F.struct(F.lit(life).cast("string").alias("lifecycle"), F.lit(review).cast("string").alias("review_status"), F.lit(use).cast("string").alias("use_status"), F.lit(queued).alias("queued"))
    return F.when(verdict == "AUTO_APPROVED", as_("DRAFT", "AUTO_CLASSIFIED", "INTERNAL_ONLY", False)).when(verdict == "HUMAN_REVIEW", as_("DRAFT", "NEEDS_REVIEW", "REVIEW_ONLY", True)).when(verdict == "BLOCKED", as_(None, None, None, True)).otherwise(as_(None, None, None, False))


def qa_judge(flags: Mapping[str, Column], type_conf: Column, unit_conf: Column, overlap: Column) -> Column:
    """struct(passed, residuals): reasons left after checks (name -> condition that is a fault) and thresholds; passed iff there are none."""
    faults = {**flags, "TYPE_CONFIDENCE": type_conf < TYPE, "UNIT_CONFIDENCE": unit_conf < UNIT, "BBOX_INTRUSION": overlap >= OVERLAP}
    left = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in faults.items()]))
    return F.struct((F.size(left) == 0).alias("passed"), left.alias("residuals"))


def crop_gate(hard: Sequence[Column], soft: Sequence[Column], image_known: Column) -> Column:
    """UNSAFE on any hard blocker, REVIEW on any soft one or without image features, else SAFE."""
    any_ = lambda cs: F.exists(F.array(*[F.coalesce(c, F.lit(False)) for c in cs]), lambda x: x)
    return F.when(any_(hard), "UNSAFE").when(any_(soft) | ~F.coalesce(image_known, F.lit(False)), "REVIEW").otherwise("SAFE")


def ocr_verdict(failed: Column, critical: Column, hit: Column, korean: Column) -> Column:
    """GREEN, YELLOW or RED of a reading; critical: number of critical errors; korean: null if nothing was required."""
    hit = F.when(hit.isNull(), F.when(failed, 0.0).otherwise(0.5)).otherwise(hit)
    fine = ~failed & (critical == 0)
    return F.when(fine & (hit >= 0.75) & (korean.isNull() | (korean >= 0.7)), "GREEN").when(fine & ((hit >= 0.4) | (F.coalesce(korean, F.lit(0.0)) >= 0.5)), "YELLOW").otherwise("RED")


def agreement(a: Sequence[Column], b: Sequence[Column], least: float = HIGH) -> Column:
    """struct(agree, widest): both checkers at least so sure of every field, and the widest difference."""
    sure = F.least(*a, *b) >= least
    return F.struct(sure.alias("agree"), F.greatest(*[F.abs(x - y) for x, y in zip(a, b, strict=True)]).alias("widest"))


def burden(verdict: Column, critical: Column, korean: Column) -> Column:
    """How much of a reading must be corrected."""
    return F.when((verdict == "GREEN") & (critical == 0), "NONE").when((verdict == "YELLOW") & (critical == 0), "LIGHT").when((critical <= 2) & (F.coalesce(korean, F.lit(1.0)) >= 0.5), "HEAVY").otherwise("RETYPE")


def error_class(status: Column) -> Column:
    """FATAL for refused requests, RETRY for rate limits, server errors and no answer, else OK."""
    return F.when(status.isNull() | (status == 429) | (status >= 500), "RETRY").when(status >= 400, "FATAL").otherwise("OK")


def confirm_type(content: Column, source: Column, cluster: Column, section: Column, ai: Column, cached_auto: Column, fingerprint_ok: Column) -> Column:
    """struct(type, by): which of the candidate types counts, and on what evidence."""
    pick = lambda t, by: F.struct(t.alias("type"), F.lit(by).alias("by"))
    top = F.coalesce(content, source, cluster)
    agree = lambda a, b: a.isNotNull() & (a == b)
    return (
        F.when(cached_auto & (top.isNotNull() | fingerprint_ok), pick(F.coalesce(top, ai), "SOURCE_CONFIRMED"))
        .when(agree(cluster, section) & (content.isNull() | (content == cluster)), pick(cluster, "CLUSTER_CONFIRMED"))
        .when(cluster.isNotNull() & content.isNotNull() & (cluster != content) & ((ai == cluster) | (ai == content)), pick(ai, "AI_CONFIRMED"))
        .when(agree(content, source), pick(source, "SOURCE_CONFIRMED"))
        .when(agree(content, ai), pick(ai, "AI_CONFIRMED"))
        .when(F.coalesce(content, cluster, section).isNotNull() & fingerprint_ok, pick(F.coalesce(content, cluster, section), "CLUSTER_CONFIRMED"))
        .otherwise(pick(F.coalesce(content, cluster, section, ai), "LOW_CONFIDENCE_REVIEW"))
    )


def strengthen(confidence: Column, boosts: Sequence[tuple[Column, float]], blocked: Column, cap: float = 0.93) -> Column:
    """A confidence raised by each piece of evidence that holds, up to a cap; unchanged where a conflict blocks it."""
    total = confidence
    for condition, boost in boosts:
        total = total + F.when(F.coalesce(condition, F.lit(False)), F.lit(boost)).otherwise(0.0)
    return F.when(F.coalesce(blocked, F.lit(False)), confidence).otherwise(F.greatest(confidence, F.least(F.lit(cap), total)))


def label_confidence(hits: Column, pages: Column) -> Column:
    """How sure the labels of a source are, by how often and on how many pages they were met."""
    return F.when((hits >= 6) & (pages >= 3), 0.9).when(hits >= 8, 0.72).when(hits > 0, 0.4).otherwise(0.15)


def all_hold(gates: Mapping[str, Column]) -> Column:
    """struct(safe, failed): whether every gate is known to hold, and the names of those that do not."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in gates.items()]))
    return F.struct((F.size(failed) == 0).alias("safe"), failed.alias("failed"))


def review_decision(e: Mapping[str, Column]) -> Column:
    """struct(verdict, rule) on an item in review: AUTO_SAFE (its text may be put right), PASS_FALSE_POSITIVE (nothing is wrong), REVIEW_REQUIRED or BLOCKED.

    e: hidden, protected; signals duplicate_body, own_range, too_short, packaging, range_leak, next_leak, number_dup; and what was found: later (a later
    range's mark), siblings, covered, page_prompt, atom, trimmed, on_next, next_listed, leak_found, leak_packaging, original. Unknown evidence does not hold.
    """
    has = {k: F.coalesce(c, F.lit(False)) for k, c in e.items()}
    auto, fine, human, blocked = "AUTO_SAFE", "PASS_FALSE_POSITIVE", "REVIEW_REQUIRED", "BLOCKED"
    own, short, leak, next_ = has["own_range"] & ~has["later"], has["too_short"], has["range_leak"], has["next_leak"]
    return decide(
        [
            (has["hidden"], blocked, "HIDDEN"),
            (has["protected"], human, "PROTECTED"),
            (has["duplicate_body"], human, "DUPLICATE_BODY"),
            (own & ~has["siblings"], fine, "OWN_RANGE"),
            (own, human, "GLUED_SIBLINGS"),
            (short & has["covered"], fine, "SHORT_COVERED"),
            (short & has["page_prompt"], auto, "PROMPT_FROM_PAGE"),
            (short & has["atom"], fine, "SHORT_ATOM"),
            (short, human, "SHORT_UNPROVEN"),
            (has["trimmed"], auto, "GLUED_ITEMS_TRIMMED"),
            (has["packaging"], auto, "PACKAGING"),
            (leak & has["later"] & has["on_next"], auto, "RANGE_ON_NEXT"),
            (leak, human, "RANGE_LEAK"),
            (next_ & ~has["next_listed"], human, "NEXT_MISSING"),
            (next_ & has["leak_packaging"], auto, "NEXT_IS_PACKAGING"),
            (next_ & ~has["leak_found"], fine, "NEXT_NOT_FOUND"),
            (next_, human, "NEXT_UNEQUAL"),
            (has["number_dup"] & has["atom"], fine, "NUMBER_OF_ATOM"),
            (~has["original"], blocked, "NO_ORIGINAL"),
        ],
        human,
    )


#: The least confidence of a detected figure, owners that are sure, and boxes that spoil it.
FIGURE_DETECTED = 0.7
SURE_OWNERS, SPOILT_BOXES = ("SINGLE_OWNER_HIGH", "SHARED_OWNER_HIGH"), ("MAJOR_CUT", "WRONG_REGION")


def figure_safe(e: Mapping[str, Column]) -> Column:
    """struct(safe, failed) of a figure that is kept without review. e: identity_stable, boundary_safe, confidence, crop, ownership, required_complete, neighbour_figure, shared_unresolved, choices_safe, box_quality, owner_correct."""
    return all_hold(
        {
            "IDENTITY": e["identity_stable"],
            "BOUNDARY": e["boundary_safe"],
            "DETECTION": e["confidence"] >= FIGURE_DETECTED,
            "CROP": e["crop"] == "FIGURE_CROP_SAFE",
            "OWNERSHIP": e["ownership"].isin(*SURE_OWNERS),
            "INCOMPLETE": e["required_complete"],
            "NEIGHBOUR": ~e["neighbour_figure"],
            "SHARED": ~e["shared_unresolved"],
            "CHOICES": e["choices_safe"],
            "BOX": ~e["box_quality"].isin(*SPOILT_BOXES),
            "OWNER": e["owner_correct"],
        }
    )


def figure_reason(e: Mapping[str, Column]) -> Column:
    """Why a person should look at a figure. e: detected, formula, table_confusion, box_quality, crop, ownership, sidebar; unknown ones do not hold, but for detected."""
    return decide(
        [
            (~F.coalesce(e["detected"], F.lit(False)), "FIGURE_NOT_DETECTED", "DETECTED"),
            (e["formula"], "FORMULA_FALSE_POSITIVE", "FORMULA"),
            (e["table_confusion"], "TABLE_CONFUSION", "TABLE"),
            (e["box_quality"] == "WRONG_REGION", "FIGURE_BBOX_UNCERTAIN", "BOX"),
            ((e["box_quality"] == "MAJOR_CUT") | (e["crop"] == "FIGURE_CROP_UNSAFE"), "FIGURE_CUT_RISK", "CUT"),
            (e["crop"] == "FIGURE_CROP_REVIEW", "LABEL_CUT_RISK", "CROP"),
            (e["ownership"].isin("UNRESOLVED", "SINGLE_OWNER_REVIEW"), "FIGURE_OWNER_AMBIGUOUS", "OWNER"),
            (e["ownership"] == "SHARED_OWNER_REVIEW", "SHARED_OWNER_AMBIGUOUS", "SHARED"),
            (e["sidebar"], "SIDEBAR_FIGURE", "SIDEBAR"),
        ],
        "OTHER",
    )["verdict"]


def pipeline_status(e: Mapping[str, Column], least_choices: int = 5) -> Column:
    """struct(status, complete, warnings) of a recognised item. e: crop_safe, number_ok, has_stem, expects_choices, choices, expects_figure, figures, conflicts; what is unknown is not fine."""
    fine = {k: F.coalesce(e[k], F.lit(False)) for k in ("crop_safe", "number_ok", "has_stem")}
    lacks = lambda expected, n, least: F.coalesce(expected, F.lit(False)) & (F.coalesce(n, F.lit(0)) < least)
    faults = {
        "crop_not_safe": ~fine["crop_safe"],
        "stem_missing": ~fine["has_stem"],
        "missing_choice": lacks(e["expects_choices"], e["choices"], least_choices),
        "missing_figure": lacks(e["expects_figure"], e["figures"], 1),
        "OCR_CONFLICT": F.coalesce(e["conflicts"], F.lit(0)) > 0,
    }
    complete = fine["number_ok"] & fine["has_stem"] & ~faults["missing_choice"] & ~faults["missing_figure"]
    warnings = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in faults.items()]))
    return F.struct(F.when(complete & (F.size(warnings) == 0), "DRAFT").otherwise("PIPELINE_REVIEW").alias("status"), complete.alias("complete"), warnings.alias("warnings"))


#: How sure a unit and a type are, by what the heading above and the text itself say, and a key point that is known.
UNIT_SURE = {"both": 0.96, "heading": 0.88, "content": 0.55, "neither": 0.35, "conflict": 0.2}
TYPE_SURE = {"both": 0.92, "heading": 0.8, "content": 0.62, "neither": 0.3, "conflict": 0.48}
KEY_POINT_SURE, KEY_POINT_OPEN = 0.82, 0.2


def _evidence(heading: Column, content: Column) -> Column:
    return F.when(heading.isNull() & content.isNull(), "neither").when(content.isNull(), "heading").when(heading.isNull(), "content").when(heading == content, "both").otherwise("conflict")


def draft_class(e: Mapping[str, Column], least_unit: float, least_type: float, least_difficulty: float) -> Column:
    """struct(unit, unit_confidence, type, type_confidence, key_point_confidence, unit_auto, type_auto, difficulty_auto, auto, reasons) of a first classification.

    e: heading_unit, content_unit, heading_type, content_type, key_point, difficulty (its confidence). The heading gives the unit unless the text says otherwise, the text the type
    unless only the heading does. Each is automatic where sure enough and not in conflict (unit) or unclear (type); the whole where unit and type are.
    """
    unit_by, type_by = _evidence(e["heading_unit"], e["content_unit"]), _evidence(e["heading_type"], e["content_type"])
    sure = lambda by, table: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), by)
    known = F.coalesce(e["key_point"] != "REVIEW", F.lit(False))
    unit_sure, type_sure = sure(unit_by, UNIT_SURE), sure(type_by, TYPE_SURE)
    unit_auto = (unit_sure >= least_unit) & (unit_by != "conflict")
    type_auto = (type_sure >= least_type) & (type_by != "neither")
    faults = {"UNIT_CONFLICT": unit_by == "conflict", "TYPE_FROM_STEM_ONLY": type_by == "content", "TYPE_HEADING_STEM_MISMATCH": type_by == "conflict", "TYPE_UNCLEAR": type_by == "neither", "KEY_POINT_REVIEW": ~known}
    return F.struct(
        F.coalesce(e["content_unit"], e["heading_unit"]).alias("unit"),
        unit_sure.alias("unit_confidence"),
        F.coalesce(e["content_type"], e["heading_type"], F.lit("TYPE_UNCLEAR")).alias("type"),
        type_sure.alias("type_confidence"),
        F.when(known, KEY_POINT_SURE).otherwise(KEY_POINT_OPEN).alias("key_point_confidence"),
        unit_auto.alias("unit_auto"),
        type_auto.alias("type_auto"),
        F.coalesce(e["difficulty"] >= least_difficulty, F.lit(False)).alias("difficulty_auto"),
        (unit_auto & type_auto).alias("auto"),
        F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in faults.items()])).alias("reasons"),
    )
