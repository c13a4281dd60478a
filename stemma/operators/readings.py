"""Readings held against the truth, caches merged by key, homes of numbers, and what keeps a row from being stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cues import leading_index
from ..functions.repair import CIRCLED
from ..functions.text import bound, ranges, tags

#: Words that speak of a figure and of a neighbour's text.
FIGURE_READ = r"(?i)그림|도형|graph|triangle|반원|포물선"
NEIGHBOUR_READ = r"소개기|논이기|본이기"
#: Lines and letters of a truth that are looked for, and the shares that must be found.
LEAST_LINE, LINES, LINE_LETTERS, MATH_LETTERS, LINE_SHARE, MATH_SHARE = 8, 4, 16, 12, 0.5, 0.34
#: Where the number of an item stands on a page (x, y), and how many numbers a mark may cover.
INDEX_X, INDEX_Y, MOST_COVERED = (0.08, 0.22), (0.06, 0.92), 20


def compared(text: Column) -> Column:
    """A text as it is compared: no dollar signs or white space, one hyphen, powers with a caret, lower case."""
    plain = F.translate(text, "−–$", "--")
    return F.lower(F.regexp_replace(F.replace(F.replace(plain, F.lit("²"), F.lit("^2")), F.lit("³"), F.lit("^3")), r"\s+", ""))


def reading_checks(text: Column, *, number: Column, truth: Column, choices: Column, maths: Column, figure: Column) -> Column:
    """struct(identity, stem, choices, math, figure, boundary) of a cached reading: PASS or FAIL each, NOT_COMPARED where nothing was read.

    number, truth and maths (an array) are the truth's, choices is how many it has, figure whether it has one; null ones count as absent.
    """
    names = ("identity", "stem", "choices", "math", "figure", "boundary")
    trim = lambda t: F.regexp_replace(t, r"^\s+|\s+\z", "")
    truth, number, maths = F.coalesce(truth, F.lit("")), F.coalesce(number, F.lit("")), F.coalesce(maths, F.array().cast("array<string>"))
    lines = F.slice(F.filter(F.transform(F.split(truth, "\n"), trim), lambda t: F.length(t) > LEAST_LINE), 1, LINES)
    marks = sum((F.contains(text, F.lit(c)).cast("int") for c in CIRCLED), F.lit(0))

    def judge(read: Column) -> Column:
        within = lambda t, n: bound(F.substring(compared(t), 1, n), lambda s: (s != "") & F.contains(read, s))
        share = lambda found, n: F.size(F.filter(found, lambda t: within(t, n))) / F.size(found)
        holds = {
            "identity": (number != "") & (F.contains(read, compared(number)) | F.contains(text, number)),
            "stem": F.when(F.size(lines) == 0, trim(truth) == "").otherwise(share(lines, LINE_LETTERS) >= LINE_SHARE),
            "choices": (F.coalesce(choices, F.lit(0)) == 0) | (marks == choices),
            "math": F.when(F.size(maths) == 0, True).otherwise(share(maths, MATH_LETTERS) >= MATH_SHARE),
            "figure": ~F.coalesce(figure, F.lit(False)) | text.rlike(FIGURE_READ),
            "boundary": ~text.rlike(NEIGHBOUR_READ),
        }
        return F.struct(*[F.when(holds[n], "PASS").otherwise("FAIL").alias(n) for n in names])

    nothing = F.struct(*[F.lit("NOT_COMPARED").alias(n) for n in names])
    return F.when(F.coalesce(trim(text), F.lit("")) == "", nothing).otherwise(bound(compared(text), judge))


def leading_anchors(blocks: DataFrame, content: str = "content") -> DataFrame:
    """Blocks (with x and y) where an item's number stands that begin with one, and that number: index as printed, value as long."""
    found = blocks.where(F.col("x").between(*INDEX_X) & F.col("y").between(*INDEX_Y)).withColumn("index", leading_index(F.col(content)))
    return found.where(F.col("index").isNotNull()).withColumn("value", F.col("index").cast("long"))


def merge_cached(items: DataFrame, cached: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Items with what a cache holds of them, as cached_<column>; the last cached row of a key counts, items without one get nulls."""
    last = cached.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__c"))
    return items.join(last, key, "left").select(*items.columns, *[F.col("__c")[c].alias(f"cached_{c}") for c in columns])


def number_homes(listed: DataFrame, wanted: DataFrame, *, item: str = "item", number: str = "number", stem: str = "stem") -> DataFrame:
    """Wanted numbers with how many listed items bear each, and the first item (the smallest) in whose stem an [a~b] of at most 20 steps covers it, or null.

    Marks are spread over their at most 21 numbers, so both joins are on the number.
    """
    homes = listed.groupBy(number).agg(F.count("*").alias("homes"))
    spread = listed.select(item, F.explode(ranges(F.col(stem), span=MOST_COVERED)).alias("__r")).select(item, F.explode(F.sequence("__r.a", "__r.b")).alias(number))
    cover = spread.groupBy(number).agg(F.min(item).alias("covered_by"))
    out = wanted.select(number).distinct().join(homes, number, "left").join(cover, number, "left")
    return out.select(number, F.coalesce("homes", F.lit(0)).cast("long").alias("homes"), "covered_by")


def segmentation_scores(found: DataFrame, truth: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Per page (keys): numbers expected, found, matched, missed and extra, with precision and recall; null where there is nothing to divide by. Repeats count once."""
    side = lambda df, name: df.select(*keys, number).distinct().withColumn(name, F.lit(True))
    both = side(found, "__f").join(side(truth, "__t"), [*keys, number], "full")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = both.groupBy(*keys).agg(n(F.col("__t")).alias("expected"), n(F.col("__f")).alias("found"), n(F.col("__f") & F.col("__t")).alias("matched"))
    rate = lambda of: F.when(F.col(of) > 0, F.col("matched") / F.col(of))
    return out.withColumns({"missed": F.col("expected") - F.col("matched"), "extra": F.col("found") - F.col("matched"), "precision": rate("found"), "recall": rate("expected")})


def segmentation_totals(pages: DataFrame, group: str) -> DataFrame:
    """Pages' scores of each group: sums of the counts, means of the rates over the pages that have one, and pages without a fault."""
    sums = [F.sum(c).alias(c) for c in ("expected", "found", "matched", "missed", "extra")]
    means = [F.avg(c).alias(f"mean_{c}") for c in ("precision", "recall")]
    return pages.groupBy(group).agg(F.count("*").alias("pages"), F.count_if((F.col("missed") == 0) & (F.col("extra") == 0)).alias("whole_pages"), *sums, *means)


def preflight(rows: DataFrame, problems: DataFrame, sources: DataFrame, profiles: DataFrame, document: Column) -> DataFrame:
    """(item, passed, reasons): what speaks against storing classified rows, in order; rows pass that have no reason.

    rows: item, overall, unit_decision, type_decision, key_point_decision, strategy_decision, review_reasons (how many), type, unit, unit_code, page, number,
    evidence_insufficient. problems: item, version, review_status; sources: item, document, page, number; profiles: type, unit; one row a key each.
    """
    there = F.lit(True)
    p = problems.select("item", F.col("version").alias("p_version"), F.col("review_status").alias("p_status"), there.alias("p_there"))
    s = sources.select("item", F.col("document").alias("s_document"), F.col("page").alias("s_page"), F.col("number").alias("s_number"), there.alias("s_there"))
    t = profiles.select("type", F.col("unit").alias("t_unit"), there.alias("t_there"))
    c = F.col
    other = lambda a, b: ~a.eqNullSafe(b)
    auto = lambda name: other(c(f"{name}_decision"), F.lit("AUTO"))
    unclear_unit = c("unit").isNull() | c("unit").isin("", "미정")
    reasons = tags(
        NOT_OVERALL_AUTO=other(c("overall"), F.lit("AUTO")),
        UNIT_NOT_AUTO=auto("unit"),
        TYPE_NOT_AUTO=auto("type"),
        KEY_POINT_NOT_AUTO=auto("key_point"),
        STRATEGY_NOT_AUTO=auto("strategy"),
        HAS_REVIEW_REASON=c("review_reasons") > 0,
        TYPE_UNCLEAR=c("type").isNull() | c("type").isin("", "TYPE_UNCLEAR"),
        UNIT_UNCLEAR=unclear_unit,
        UNIT_CODE_MISSING=c("unit_code").isNull(),
        PROBLEM_MISSING=c("p_there").isNull(),
        DRAFT_VERSION_MISSING=c("p_there") & c("p_version").isNull(),
        VERIFIED_BLOCKED=c("p_status") == "VERIFIED",
        SOURCE_MISSING=c("s_there").isNull(),
        WRONG_DOCUMENT=c("s_there") & other(c("s_document"), document),
        PAGE_MISMATCH=c("s_there") & other(c("s_page"), c("page")),
        NUMBER_MISMATCH=c("s_there") & other(c("s_number"), c("number")),
        TYPE_PROFILE_MISSING=c("t_there").isNull(),
        UNIT_TYPE_INCONSISTENT=c("t_there") & other(c("t_unit"), c("unit")),
        EVIDENCE_INSUFFICIENT=c("evidence_insufficient"),
    )
    met = rows.join(p, "item", "left").join(s, "item", "left").join(t, "type", "left").select("item", reasons.alias("reasons"))
    return met.select("item", (F.size("reasons") == 0).alias("passed"), "reasons")
