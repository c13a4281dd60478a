"""Columns that put item texts right: leaked answer keys, numbers glued to texts, left-over signs, shared prompts and doubled codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bare, bound, squeeze

#: Marks of an answer key, and its heading in front of an item.
LEAK = r"정답\s*및\s*\S+|정답\s*:|\[정답\]|정답\s+\d"
LEAK_HEADING = r"^\s*정답\s*및\s*\S+(?:\s*[•●·⦁]?\s*\d+\s*쪽)?\s*"
LEAK_CUT = r"정답\s*및\s*\S+|\[정답\]\s*|정답\s*:|정답\s+(?=\d)"
#: What is deleted of an answer key; the first of them alone where too little would be left.
LEAK_LINES = (
    (r"(?:^|\n)[^\S\n]*정답\s*및\s*풀이\s*\d+\s*쪽[^\n]*", ""),
    (r"\n*정답\s*및\s*풀이\s*\z", ""),
    (r"정답\s*:[^\n]*", ""),
    (r"(^|\n)풀이\s*:[^\n]*", "$1"),
    (r"(?:\n답\s*[:：]?\s*\S[^\n]*)+\z", ""),
)
LONG_STEM, LEAST_LEFT, LEAST_SHARE = 80, 40, 0.4
#: Forms of printed numbers, in the order in which they are tried.
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩"
NUMBER_FORMS = (
    (r"^\[(\d{1,4})\]", "BOXED", "boxed_number"),
    (r"^\((\d{1,2})\)", "PAREN", "paren_list_or_choice"),
    (r"^(\d{1,4})[.)]", "NUMBER_PUNCT", "number_punctuation"),
)
STEP, STEM_START = r"^(?:STEP|Step|step)\d", r"^[가-힣A-Za-z($\\]"
#: A type's code and a heading's code printed twice.
DOUBLED_CODES = ((r"^(유형 \d{1,3})(?: \1)+(?=\s|\z)", "$1"), (r"^([IVX]+)(?: \1)+(?=\s|\z)", "$1"), (r"^(\d{1,3})(?: \1)+(?=\s|\z)", "$1"))


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def split_leak(text: Column) -> Column:
    """struct(leaked, stem, answer, explanation) of a text with an answer key in it; other texts are their own stem, the rest null.

    A heading in front goes to explanation. Else the text is cut at the first mark: what follows explains, and its first line (80 characters) answers.
    """
    none = F.lit(None).cast("string")
    heading = F.regexp_extract(text, LEAK_HEADING, 0)
    behind = _trim(F.regexp_replace(F.regexp_replace(text, LEAK_HEADING, ""), r"^[#\s•●·⦁]+", ""))

    def cut(parts: Column) -> Column:
        rest = _trim(F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "\n"))
        answer = F.nullif(_trim(F.regexp_extract(rest, r"^\s*([^\n]{1,80})", 1)), F.lit(""))
        return F.struct(F.lit(True).alias("leaked"), _trim(parts[0]).alias("stem"), answer.alias("answer"), F.nullif(rest, F.lit("")).alias("explanation"))

    whole = F.struct(F.lit(False).alias("leaked"), text.alias("stem"), none.alias("answer"), none.alias("explanation"))
    fronted = F.struct(F.lit(True).alias("leaked"), behind.alias("stem"), none.alias("answer"), _trim(heading).alias("explanation"))
    return F.when(F.coalesce(~text.rlike(LEAK), F.lit(True)), whole).when(heading != "", fronted).otherwise(bound(F.split(text, LEAK_CUT), cut))


def strip_leak(text: Column) -> Column:
    """The text without the lines of an answer key. Where a long text would lose most of itself, only its page headings go."""

    def apply(rules, t: Column) -> Column:
        return _trim(F.regexp_replace(reduce(lambda c, r: F.regexp_replace(c, *r), rules, t), r"\n{3,}", "\n\n"))

    def check(t: Column) -> Column:
        enough = lambda c: (F.length(t) < LONG_STEM) | (F.length(c) >= F.greatest(F.lit(LEAST_LEFT), F.length(t) * LEAST_SHARE))
        return bound(apply(LEAK_LINES, t), lambda c: F.when(enough(c), c).otherwise(apply(LEAK_LINES[:1], t)))

    return bound(_trim(text), check)


def _number(display: Column | None, value: Column | None, style: Column | str | None, rest: Column, glued: Column, ambiguous: bool, reason: Column | str) -> Column:
    text = lambda c: F.lit(c).cast("string") if c is None or isinstance(c, str) else c
    return F.struct(text(display).alias("display"), (F.lit(None) if value is None else value).cast("long").alias("value"), text(style).alias("style"), rest.alias("rest"), glued.alias("glued"), F.lit(ambiguous).alias("ambiguous"), text(reason).alias("reason"))


def _digits(run: Column) -> Column:
    return F.concat(F.length(run).cast("string"), F.lit("_DIGIT"))


def glued_number(raw: Column) -> Column:
    """struct(display, value, style, rest, glued, ambiguous, reason): the number that a text begins with, white space left out, and what is glued to it.

    A run of more than four digits is ambiguous; resolve_digits() reads it by its neighbours' numbers.
    """

    def read(t: Column) -> Column:
        behind = lambda pattern: F.regexp_replace(t, pattern, "")
        yes, no = F.lit(True), F.lit(False)
        out = F.when(t == "", _number(None, None, None, t, no, False, "empty")).when(t.rlike(STEP), _number(None, None, "VISUAL_MARKER", t, no, False, "step_marker"))
        ring = F.substring(t, 1, 1)
        out = out.when(t.rlike(f"^[{CIRCLED}]"), _number(ring, F.instr(F.lit(CIRCLED), ring), "CIRCLED", F.substring(t, F.lit(2), F.length(t)), F.length(t) > 1, False, "circled_token"))
        for pattern, style, reason in NUMBER_FORMS:
            n = F.regexp_extract(t, pattern, 1)
            out = out.when(t.rlike(pattern), _number(n, n, style, behind(pattern), behind(pattern) != "", False, reason))
        run, rest = F.regexp_extract(t, r"^(\d{1,4})", 1), behind(r"^\d{1,4}")
        out = out.when(~t.rlike(r"^\d"), _number(None, None, None, t, no, False, "no_leading_number"))
        out = out.when(rest.rlike(r"^\d"), _number(run, run, _digits(run), rest, yes, True, "digit_run_continues"))
        out = out.when(rest.rlike(STEM_START), _number(run, run, _digits(run), rest, yes, False, "glued_number_plus_stem"))
        return out.otherwise(_number(run, run, _digits(run), rest, no, False, "plain_leading_digits"))

    return bound(bare(F.coalesce(raw, F.lit(""))), read)


def resolve_digits(run: Column, rest: Column, near: Column) -> Column:
    """As glued_number(), for a run of digits of which a first part is next to one of the numbers `near` (array of long); doubtful if none or several are."""
    option = lambda k: F.struct(F.substring(run, F.lit(1), k).alias("n"), F.concat(F.substring(run, k + 1, F.length(run)), rest).alias("rest"))
    fits = F.filter(F.transform(F.sequence(F.lit(1), F.length(run)), option), lambda o: F.exists(near, lambda n: F.abs(n - o["n"].cast("long")) == 1))

    def judge(found: Column) -> Column:
        one = found[0]
        clean = ~one["rest"].rlike(r"^\d") | one["rest"].rlike(r"^\d[가-힣]")
        yes = F.lit(True)
        return (
            F.when(F.size(found) != 1, _number(run, run, _digits(run), rest, yes, True, "ambiguous_glued_digits"))
            .when(clean, _number(one["n"], one["n"], _digits(one["n"]), one["rest"], one["rest"] != "", False, "sequence_resolved_glue"))
            .otherwise(_number(one["n"], one["n"], _digits(one["n"]), one["rest"], yes, True, "sequence_fit_but_rest_still_digits"))
        )

    return bound(fits, judge)


def math_token(token: Column) -> Column:
    """KEEP, REVIEW (nothing or one bracket) or REMOVE_ARTIFACT (two-digit sums, which are references to pages)."""
    token = bare(F.coalesce(token, F.lit("")))
    return F.when(token.rlike(r"^\d{2}\+\d{2}$"), "REMOVE_ARTIFACT").when(token.isin("", "(", ")"), "REVIEW").otherwise("KEEP")


def filter_math(tokens: Column) -> Column:
    """struct(kept, dropped, warnings) of the mathematics found in a text, in order; single letters are kept with a warning."""
    lone = lambda t: F.regexp_replace(F.coalesce(t, F.lit("")), r"\s+", "").rlike("^[A-Za-z]$")
    gone = lambda t: math_token(t) == "REMOVE_ARTIFACT"
    note = lambda t: F.when(gone(t), F.concat(F.lit("dropped_page_type_ref:"), t)).when(math_token(t) == "REVIEW", F.concat(F.lit("review_math_token:"), F.coalesce(t, F.lit("")))).when(lone(t), F.concat(F.lit("possible_lone_math_token:"), t))
    return F.struct(F.filter(tokens, lambda t: ~gone(t)).alias("kept"), F.filter(tokens, gone).alias("dropped"), F.array_compact(F.transform(tokens, note)).alias("warnings"))


def later_range(text: Column, number: Column) -> Column:
    """struct(mark, a, b, keep, shared) of the first [a~b] that begins after the item's own number: what stands before it, and it with all that follows; null without one."""
    pattern = r"\[\s*(\d{1,4})\s*~\s*(\d{1,4})\s*\]"
    part = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    marks = F.transform(F.arrays_zip(part(0).alias("m"), part(1).alias("a"), part(2).alias("b")), lambda p: F.struct(p["m"].alias("m"), p["a"].cast("long").alias("a"), p["b"].cast("long").alias("b")))

    def cut(first: Column) -> Column:
        # a mark that stands earlier too would begin after the number there as well, so its first place is the right one
        at = F.instr(text, first["m"])
        return F.when(first.isNotNull(), F.struct(first["m"].alias("mark"), first["a"].alias("a"), first["b"].alias("b"), _trim(F.substring(text, F.lit(1), at - 1)).alias("keep"), _trim(F.substring(text, at, F.length(text))).alias("shared")))

    return bound(F.try_element_at(F.filter(marks, lambda p: (p["a"] > number) & (p["a"] <= p["b"])), F.lit(1)), cut)


def outline_title(code: Column, title: Column, is_type: Column) -> Column:
    """A heading to show: code and title without printing a code twice; types have their word in front."""
    once = lambda c: reduce(lambda t, r: F.regexp_replace(t, *r), DOUBLED_CODES, squeeze(c))
    empty = F.lit("")

    def join(c: Column, t: Column) -> Column:
        front = F.concat(t, F.lit(" "))
        has = front.startswith(F.concat(c, F.lit(" "))) | front.startswith(F.concat(F.lit("유형 "), c, F.lit(" "))) | (is_type & t.startswith("유형 "))
        coded = F.when(c == "", t).when(t == "", c).when(has, t).otherwise(F.concat(c, F.lit(" "), t))
        return once(F.when(is_type & (coded != "") & ~coded.startswith("유형 "), F.concat(F.lit("유형 "), coded)).otherwise(coded))

    return bound(F.struct(F.trim(F.coalesce(code, empty)).alias("c"), once(F.coalesce(title, empty)).alias("t")), lambda s: join(s["c"], s["t"]))
