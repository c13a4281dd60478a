"""A problem's raw text as a structure: lines, number, choices, answer, formulas with what was lost in them, and anchors of a workbook; and what two readings' formulas disagree on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cues import shows_figure, shows_table
from .text import bound

#: Forms of a problem's number (only the first stands at the start), of a scanned one, of an answer's line, of choices, and the circled numbers.
PROBLEM_NUMBER = r"^(?:문제\s+)(\d{1,2})\s+|(\d{1,2})\s*[.)]\s+|\[(\d{1,2})\]\s+"
SCAN_NUMBER = r"(?:^|\n)\s*(\d{4})\b"
ANSWER_LINE = r"^(?:정답|답)\s*[:：]\s*(.+)\z"
CHOICE_FORMS = ((r"^([①-⑩])\s*(.*)\z", "{0}"), (r"^\((\d{1,2})\)\s*(.*)\z", "({0})"), (r"^(\d{1,2})\)\s+(.*)\z", "{0})"))
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩"
#: Signs of a formula, digits beside letters or brackets, a lost exponent, what looks like mathematics, and the letters that count as text.
FORMULA_SIGN = r"(?=[=<>^±²³s√-≥])(?:[=≠≤≥<>±√^²³]|sqrt)"
BESIDE = (r"([A-Za-z]\d(?<![0-9][A-Za-z]\d))(?![0-9])", r"(\)\d)(?![0-9])")
LOST_EXPONENT = r"(?<![0-9])([A-Za-z])(\d)(?![0-9])|\)\d"
FRACTION, SUM = r"/(?<=\d/)\d", r"[A-Za-z]\s*[+-]\s*[A-Za-z0-9]"
MEANINGFUL = "[0-9A-Za-z\u3131-\ud79d]"
LEAST_MEANINGFUL = 3
#: Fixed value: white space that is not one blank already.
SQUEEZED = r"\s{2,}|[\t\n\x0B\f\r]"
#: How signs are written in TeX, in the order in which they are replaced.
TEX = (("<=", r"\\le "), (">=", r"\\ge "), ("≤", r"\\le "), ("≥", r"\\ge "), ("≠", r"\\neq "), ("±", r"\\pm "), ("√", r"\\sqrt "), (r"sqrt\(([^)]+)\)", r"\\sqrt{$1}"), (r"\^(\d+)", "^{$1}"), ("²", "^{2}"), ("³", "^{3}"))
#: Labels of choices and titles of sections, which are no problems; numbers of four digits and of sections, and other heads.
WORKBOOK_CHOICE = r"^[①-⑩]|^[ㄱㄴㄷ]\s|^보기(?![A-Za-z0-9_])|^\(가\)|^\(나\)|^\(\d{1,2}\)\s|^\d{1,2}\)\s"
WORKBOOK_TITLE = r"^(?:유형|개념|정답|풀이)(?=[A-Za-z0-9_])"
FOUR_DIGITS, SECTION_NUMBER, DOTTED = r"^(\d{4})(?![A-Za-z0-9_])", r"^(\d{2}-\d)(?![A-Za-z0-9_])", r"^(?:문제\s+)?\d{1,2}\s*[.)]|^\[\d{1,2}\]"
#: Formulas in one way of writing, in the order in which it is reached.
COMPARED = ((r"\\left|\\right", ""), (r"\\bar\{([A-Za-z])\}", "$1bar"), (r"\\overline\{([A-Za-z])\}", "$1bar"), ("²", "^2"), ("³", "^3"), (r"\^\{(\d+)\}", "^$1"), (r"_\{(\d+)\}", "_$1"), (r"\\frac\{([^}]*)\}\{([^}]*)\}", "FRAC($1/$2)"), (r"\\sqrt\{([^}]*)\}", "SQRT($1)"), (r"\\le\b|≤", "<="), (r"\\ge\b|≥", ">="), (r"\\neq\b|≠", "!="), (r"\s+", ""))


#: White space, as patterns have it.
SPACE = " \t\n\x0b\f\r"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACE))


def split_lines(raw: Column) -> Column:
    """Lines that hold something, white space squeezed."""
    return F.filter(F.transform(F.split(F.replace(raw, F.lit("\r"), F.lit("\n")), r"\n+"), lambda s: strip(F.regexp_replace(s, SQUEEZED, " "))), lambda s: s != "")


def problem_number(raw: Column) -> Column:
    """struct(number, rest, circled): the first number with a mark of a problem; as many characters as it takes are left out at the start."""

    def read(t: Column) -> Column:
        part = lambda k: F.nullif(F.regexp_extract(t, PROBLEM_NUMBER, k), F.lit(""))
        circled = t.rlike("^[①-⑩]")
        number = F.when(~circled, F.coalesce(part(1), part(2), part(3)))
        return F.struct(number.alias("number"), F.when(number.isNotNull(), strip(F.substring(t, F.length(F.regexp_extract(t, PROBLEM_NUMBER, 0)) + 1, F.length(t)))).otherwise(t).alias("rest"), circled.alias("circled"))

    return bound(strip(raw), read)


def choice_of(line: Column) -> Column:
    """struct(order, label, text) of a line that is a choice, in one of three ways of writing; else null."""
    out = F.lit(None)
    for pattern, label in reversed(CHOICE_FORMS):
        mark = F.regexp_extract(line, pattern, 1)
        before, after = label.split("{0}")
        order = F.instr(F.lit(CIRCLED), mark) if label == "{0}" else mark.cast("int")
        out = F.when(line.rlike(pattern), F.struct(order.cast("int").alias("order"), F.concat(F.lit(before), mark, F.lit(after)).alias("label"), strip(F.regexp_extract(line, pattern, 2)).alias("text"))).otherwise(out)
    return out


def in_order(orders: Column) -> Column:
    """Whether numbers, sorted, go on by one each from the first."""
    return bound(F.array_sort(orders), lambda s: F.forall(F.transform(s, lambda v, i: v == s[0] + i), lambda ok: ok))


def formulas(text: Column) -> Column:
    """array of struct(original, latex, structure_ok, notes): words that hold a sign of mathematics, then digits beside letters and brackets; each once.

    A digit beside a letter may be an exponent that was lost: it has no TeX. Carets, sqrt() and slashes are noted, as nothing was seen of their layout.
    """
    # most texts hold no sign at all, and are not cut into words
    words = F.when(text.rlike(FORMULA_SIGN), F.filter(F.split(text, r"[\s,]+"), lambda w: w.rlike(FORMULA_SIGN))).otherwise(F.array().cast("array<string>"))
    beside = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in BESIDE]
    bare = F.transform(F.concat(words, *beside), lambda c: F.regexp_replace(c, r"[.;]+\z", ""))

    def read(w: Column) -> Column:
        tex = w
        for pattern, sign in TEX:
            tex = F.regexp_replace(tex, pattern, sign)
        lost = w.rlike(LOST_EXPONENT) & ~w.rlike("[²³^]")
        notes = F.array_compact(F.array(F.when(lost, "lost_exponent"), F.when(w.rlike(r"\^|(?i:sqrt\()"), "ascii_notation"), F.when(w.rlike(r"\d/\d"), "slash_fraction")))
        return F.struct(w.alias("original"), F.when(~lost, tex).alias("latex"), (~lost & (F.size(notes) == 0) & w.rlike("[²³≤≥≠±√]")).alias("structure_ok"), notes.alias("notes"))

    return F.transform(F.filter(F.array_distinct(bare), lambda w: F.length(w) >= 2), read)


def looks_mathematical(text: Column) -> Column:
    """Whether a text holds a sign of mathematics, a fraction of digits or a sum that begins with a letter; each is looked for by itself, the last only where there is a plus or minus."""
    return text.rlike(FORMULA_SIGN) | text.rlike(FRACTION) | ((text.contains("+") | text.contains("-")) & text.rlike(SUM))


def has_text(text: Column) -> Column:
    """Whether a text has as many letters and digits as can be read; the first few are looked for, not all counted."""
    return text.rlike(rf"(?:{MEANINGFUL}[\s\S]*?){{{LEAST_MEANINGFUL}}}")


def workbook_anchor(raw: Column) -> Column:
    """struct(number, kind, confidence, reason): what a workbook's line says of a problem's number: four_digit, section, dotted, or why it has none."""
    said = lambda number, kind, confidence, reason: F.struct(number.cast("string").alias("number"), F.lit(kind).cast("string").alias("kind"), F.lit(confidence).cast("double").alias("confidence"), F.lit(reason).alias("reason"))
    none = F.lit(None)

    def read(t: Column) -> Column:
        four, section = F.regexp_extract(t, FOUR_DIGITS, 1), F.regexp_extract(t, SECTION_NUMBER, 1)
        dotted = F.when(t.rlike(DOTTED), problem_number(t)["number"])
        return (
            F.when(t == "", said(none, None, 0, "empty"))
            .when(t.rlike(WORKBOOK_CHOICE), said(none, None, 0, "choice_or_보기_label"))
            .when(t.rlike(WORKBOOK_TITLE), said(none, None, 0, "section_title_not_problem"))
            .when(four != "", said(four, "four_digit", 0.9, "leading_four_digit"))
            .when(section != "", said(section, "section", 0.55, "theory_section_id"))
            .when(dotted.isNotNull(), said(dotted, "dotted", 0.7, "dotted_or_bracket_number"))
            .otherwise(said(none, None, 0, "no_problem_number"))
        )

    plain = F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), r"!\[[^\]]*\]\([^)]*\)", " "), r"^#{1,6}\s*", "")
    return bound(strip(F.regexp_replace(plain, r"\s+", " ")), read)


def comparable(latex: Column) -> Column:
    """A formula in one way of writing: brackets' sizes, braces of single exponents and white space of no account."""
    for pattern, other in COMPARED:
        latex = F.regexp_replace(latex, pattern, other)
    return latex


_NO_CONFLICTS = "array<struct<code:string,detail:string>>"


def _other_values(x: Column, y: Column, code: str, sign: str) -> Column:
    """Letters that both formulas raise or index, each with another number."""
    pattern = rf"([A-Za-z])\{sign}(\d+)"
    part = lambda t, k: F.regexp_extract_all(t, F.lit(pattern), F.lit(k))

    def last(t: Column, letter: Column) -> Column:
        pairs = F.filter(F.arrays_zip(part(t, 1).alias("k"), part(t, 2).alias("v")), lambda q: q["k"] == letter)
        return F.try_element_at(pairs, F.lit(-1))["v"]

    def told(p: Column) -> Column:
        return F.struct(F.lit(code).alias("code"), F.concat(p["k"], F.lit(sign), p["a"], F.lit(" vs "), p["k"], F.lit(sign), p["b"]).alias("detail"))

    pairs = F.transform(F.array_distinct(part(x, 1)), lambda k: F.struct(k.alias("k"), last(x, k).alias("a"), last(y, k).alias("b")))
    return F.transform(F.filter(pairs, lambda p: p["b"].isNotNull() & (p["a"] != p["b"])), told)


def _none_shared(x: Column, y: Column, code: str, name: str) -> Column:
    """Both have parts of one name, and none in common."""
    a, b = (F.regexp_extract_all(t, F.lit(rf"{name}\(([^)]+)\)"), F.lit(1)) for t in (x, y))
    detail = F.concat(F.array_join(a, ","), F.lit(" vs "), F.array_join(b, ","))
    return F.when((F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b), F.array(F.struct(F.lit(code).alias("code"), detail.alias("detail")))).otherwise(F.array().cast(_NO_CONFLICTS))


def formula_conflicts(a: Column, b: Column) -> Column:
    """array of struct(code, detail): what two readings' formulas (arrays of TeX) disagree on.

    exponent_mismatch and subscript_mismatch for each letter that both have with another value (its last counts), fraction_mismatch and
    radical_mismatch where both have some and none in common. Nothing if one has no formulas.
    """
    joined = lambda c: F.array_join(F.transform(c, comparable), " || ")
    told = lambda s: F.concat(_other_values(s["x"], s["y"], "exponent_mismatch", "^"), _other_values(s["x"], s["y"], "subscript_mismatch", "_"), _none_shared(s["x"], s["y"], "fraction_mismatch", "FRAC"), _none_shared(s["x"], s["y"], "radical_mismatch", "SQRT"))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), bound(F.struct(joined(a).alias("x"), joined(b).alias("y")), told)).otherwise(F.array().cast(_NO_CONFLICTS))


def critical_errors(text: Column, collapses: Column, radicals: Column, inequalities: Column, bars: Column) -> Column:
    """Codes of errors that change a formula's meaning. collapses: array of struct(whole, collapsed), the rest arrays of what the truth holds.

    COLLAPSED:<whole> if only the collapsed form is there (white space apart); RADICAL_MISSING, LE_FLATTENED, GE_FLATTENED, BARS_MISSING.
    """
    said = F.coalesce(text, F.lit(""))
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    fell = bound(bare(said), lambda t: F.transform(F.filter(F.coalesce(collapses, F.array().cast("array<struct<whole:string,collapsed:string>>")), lambda r: (bare(r["whole"]) != "") & (bare(r["collapsed"]) != "") & ~F.contains(t, bare(r["whole"])) & F.contains(t, bare(r["collapsed"]))), lambda r: F.concat(F.lit("COLLAPSED:"), r["whole"])))
    wants = lambda c, test: F.coalesce(F.exists(c, test), F.lit(False))
    missing = F.array_compact(F.array(
        F.when(wants(radicals, lambda r: r.contains("√")) & ~said.contains("√"), "RADICAL_MISSING"),
        F.when(wants(inequalities, lambda r: r == "≤") & ~said.rlike("≤|<=") & said.contains("<"), "LE_FLATTENED"),
        F.when(wants(inequalities, lambda r: r == "≥") & ~said.rlike("≥|>=") & said.contains(">"), "GE_FLATTENED"),
        F.when(wants(bars, lambda r: r.contains("|")) & (F.regexp_count(said, F.lit(r"\|")) < 2), "BARS_MISSING"),
    ))
    return F.concat(fell, missing)

