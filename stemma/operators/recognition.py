"""The recogniser: raw texts of problems to structures with a verdict, step by step as columns; nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import recognition as R


def recognised(rows: DataFrame, text: str = "text", *, scan: bool = False) -> DataFrame:
    """Rows with a column `found`: struct(status, verdict, number, stem, formulas, choices, answer, has_figure, has_table, components, warnings).

    A text of fewer than three letters or digits is FAILED and RED, with OCR_UNAVAILABLE. Else the first line gives the number, lines of answers and
    choices are taken out, the rest is the stem, and formulas are read from stem and choices. RED without a stem or with a lost exponent, YELLOW if any
    component needs review or has a figure or table, else GREEN. scan: as read by an OCR engine; never GREEN, RED also for a letter beside a digit
    in a text without any exponent, and the number may be four digits at the start of a line. Null is an empty text; the columns of `rows` stay.
    """
    names = rows.columns
    step = rows.withColumn("__t", R.strip(F.coalesce(F.col(text), F.lit("")))).withColumn("__lines", R.split_lines(F.col("__t"))).withColumn("__n", R.problem_number(F.coalesce(F.get("__lines", F.lit(0)), F.lit(""))))
    after = F.when(F.col("__n.number").isNotNull(), F.concat(F.array("__n.rest"), F.slice("__lines", 2, F.greatest(F.size("__lines"), F.lit(1))))).otherwise(F.col("__lines"))
    answers = F.filter("__lines", lambda s: s.rlike(R.ANSWER_LINE))
    step = step.withColumn("__lines", after).withColumn("__answer", F.nullif(R.strip(F.regexp_extract(F.get(answers, F.lit(0)), R.ANSWER_LINE, 1)), F.lit("")))
    step = step.withColumn("__marked", F.transform(F.filter("__lines", lambda s: ~s.rlike(R.ANSWER_LINE)), lambda s: F.struct(s.alias("line"), R.choice_of(s).alias("choice"))))
    step = step.withColumn("__choices", F.transform(F.filter("__marked", lambda m: m["choice"].isNotNull()), lambda m: m["choice"]))
    left = R.strip(F.array_join(F.transform(F.filter("__marked", lambda m: m["choice"].isNull()), lambda m: m["line"]), " "))
    step = step.withColumn("__stem", F.when(left != "", left).otherwise(F.col("__n.rest")))
    step = step.withColumn("__math", R.formulas(F.concat("__stem", F.lit(" "), F.array_join(F.transform("__choices", lambda c: c["text"]), " "))))
    t, choices, math = F.col("__t"), F.col("__choices"), F.col("__math")
    # what is asked of whole texts is a column, so that it is worked out once
    step = step.withColumns({
        "__figure": R.shows_figure(t), "__table": R.shows_table(t), "__broken": (F.size(choices) > 0) & ~R.in_order(F.transform(choices, lambda c: c["order"])), "__poor": F.exists(math, lambda m: ~m["structure_ok"]),
        "__mathy": F.when(F.size(math) == 0, R.looks_mathematical(t)).otherwise(False), "__fell": t.rlike(r"[A-Za-z]\d") & ~t.rlike("[²³^]") if scan else F.lit(False), "__nothing": ~R.has_text(t),
    })
    figure, table, broken, poor, fell, numbered = *map(F.col, ("__figure", "__table", "__broken", "__poor", "__fell")), F.col("__n.number").isNotNull()
    weak = poor | F.col("__mathy")
    parts = [F.lit("TEXT_OK"), F.when(numbered, "NUMBER_OK").otherwise("NUMBER_REVIEW_REQUIRED"), F.when(broken, "CHOICES_REVIEW_REQUIRED").when(F.size(choices) > 0, "CHOICES_OK"), F.when(weak, "MATH_REVIEW_REQUIRED").when(F.size(math) > 0, "MATH_OK"), F.when(figure, "FIGURE_DETECTED"), F.when(table, "TABLE_DETECTED")]
    told = [F.when(F.col("__n.circled"), "circled_number").when(~numbered, "number_left_in_stem"), F.when(broken, "choice_missing_or_out_of_order"), F.when(poor, "formula_incomplete").when(weak, "formula_not_structured"), F.when(figure, "figure_detected"), F.when(table, "table_detected"), F.when(F.col("__answer").isNotNull(), "answer_copied")]
    if scan:
        parts += [F.lit("LOW_CONFIDENCE"), F.when(~weak, "MATH_REVIEW_REQUIRED")]
        told += [F.lit("raw_scan"), F.when(fell, "exponent_maybe_lost")]
    step = step.withColumns({"__parts": F.array_compact(F.array(*parts)), "__told": F.array_compact(F.array(*told))})
    lost = F.exists(math, lambda m: F.array_contains(m["notes"], "lost_exponent"))
    review = F.exists("__parts", lambda p: p.rlike("REVIEW_REQUIRED|FIGURE_DETECTED|TABLE_DETECTED"))
    red = (F.col("__stem") == "") | lost | fell
    verdict = F.when(red, "RED").when(F.lit(True) if scan else review, "YELLOW").otherwise("GREEN")
    nothing = F.col("__nothing")
    number = F.col("__n.number")
    if scan:
        number = F.coalesce(number, F.nullif(F.regexp_extract(t, R.SCAN_NUMBER, 1), F.lit("")))
    some = lambda c, kind: F.when(~nothing, c).otherwise(F.array().cast(kind))
    kinds = dict(step.select("__math", "__choices").dtypes)
    gone = F.array(*map(F.lit, ("OCR_UNAVAILABLE", "LOW_CONFIDENCE", "MATH_REVIEW_REQUIRED", "FIGURE_DETECTED")))
    found = F.struct(
        F.when(nothing, "FAILED").when(verdict == "GREEN", "SUCCEEDED").otherwise("REVIEW_REQUIRED").alias("status") if not scan else F.when(nothing, "FAILED").otherwise("REVIEW_REQUIRED").alias("status"),
        F.when(nothing, "RED").otherwise(verdict).alias("verdict"), F.when(~nothing, number).alias("number"), F.when(nothing, "").otherwise(F.col("__stem")).alias("stem"), some(math, kinds["__math"]).alias("formulas"), some(choices, kinds["__choices"]).alias("choices"),
        F.when(~nothing, F.col("__answer")).alias("answer"), (nothing | figure).alias("has_figure"), (~nothing & table).alias("has_table"), F.when(nothing, gone).otherwise(F.col("__parts")).alias("components"), F.when(nothing, F.array(F.lit("no_usable_text"))).otherwise(F.col("__told")).alias("warnings"),
    )
    return step.select(*names, found.alias("found"))
