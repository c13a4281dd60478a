"""The recogniser against a plain one, text by text, and known cases."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import stemma.queries  # noqa: F401
from stemma.catalog import QUERIES
from stemma.functions import recognition as R
from stemma.operators.recognition import recognised
from stemma.queries.recognition import raw_problems

SPACE = " \t\n\x0b\f\r"


def lines_of(raw):
    return [s for line in re.split("\n+", raw.replace("\r", "\n")) if (s := re.sub(f"[{SPACE}]+", " ", line).strip(SPACE))]


def number_of(raw):
    t = raw.strip(SPACE)
    m = re.search(rf"\A(?:문제[{SPACE}]+)([0-9]{{1,2}})[{SPACE}]+|([0-9]{{1,2}})[{SPACE}]*[.)][{SPACE}]+|\[([0-9]{{1,2}})\][{SPACE}]+", t)
    if re.match("[①-⑩]", t) or not m:
        return None, t
    return m[1] or m[2] or m[3], t[len(m[0]) :].strip(SPACE)


def formulas_of(text):
    chunks = [w for w in re.split(f"[{SPACE},]+", text) if re.search("[=≠≤≥<>±√^²³]|sqrt", w)] + re.findall("(?<![0-9])[A-Za-z][0-9](?![0-9])", text) + re.findall(r"\)[0-9](?![0-9])", text)
    out, seen = [], set()
    for c in chunks:
        w = re.sub(r"[.;]+\Z", "", c)
        if len(w) < 2 or w in seen:
            continue
        seen.add(w)
        tex = w
        for a, b in (("<=", r"\le "), (">=", r"\ge "), ("≤", r"\le "), ("≥", r"\ge "), ("≠", r"\neq "), ("±", r"\pm "), ("√", r"\sqrt ")):
            tex = tex.replace(a, b)
        tex = re.sub(r"sqrt\(([^)]+)\)", r"\\sqrt{\1}", tex)
        tex = re.sub(r"\^([0-9]+)", r"^{\1}", tex).replace("²", "^{2}").replace("³", "^{3}")
        lost = bool(re.search(r"(?<![0-9])[A-Za-z][0-9](?![0-9])|\)[0-9]", w)) and not re.search("[²³^]", w)
        notes = ["lost_exponent"] * lost + ["ascii_notation"] * bool(re.search(r"\^|(?i:sqrt\()", w)) + ["slash_fraction"] * bool(re.search("[0-9]/[0-9]", w))
        out.append((w, None if lost else tex, not notes and bool(re.search("[²³≤≥≠±√]", w)), notes))
    return out


def plain(raw, scan=False):
    t = (raw or "").strip(SPACE)
    if len(re.findall("[0-9A-Za-z\u3131-\ud79d]", t)) < 3:
        return ("FAILED", "RED", None, "", [], [], None, True, False, ["OCR_UNAVAILABLE", "LOW_CONFIDENCE", "MATH_REVIEW_REQUIRED", "FIGURE_DETECTED"], ["no_usable_text"])
    lines = lines_of(t)
    number, rest = number_of(lines[0])
    circled = bool(re.match("[①-⑩]", lines[0]))
    if number:
        lines = [rest, *lines[1:]]
    answer, choices, left = None, [], []
    for s in lines:
        if m := re.match(rf"(?:정답|답)[{SPACE}]*[:：][{SPACE}]*(.+)\Z", s):
            answer = answer or m[1].strip(SPACE)
        elif m := re.match(rf"([①-⑩])[{SPACE}]*(.*)\Z", s):
            choices.append(("①②③④⑤⑥⑦⑧⑨⑩".index(m[1]) + 1, m[1], m[2].strip(SPACE)))
        elif m := re.match(rf"\(([0-9]{{1,2}})\)[{SPACE}]*(.*)\Z", s):
            choices.append((int(m[1]), f"({m[1]})", m[2].strip(SPACE)))
        elif m := re.match(rf"([0-9]{{1,2}})\)[{SPACE}]+(.*)\Z", s):
            choices.append((int(m[1]), f"{m[1]})", m[2].strip(SPACE)))
        else:
            left.append(s)
    stem = " ".join(left).strip(SPACE) or rest
    math = formulas_of(stem + " " + " ".join(c[2] for c in choices))
    orders = sorted(c[0] for c in choices)
    broken = any(o != orders[0] + i for i, o in enumerate(orders))
    poor = any(not m[2] for m in math)
    mathy = re.search(rf"[=≠≤≥<>±√]|\^|²|³|sqrt|[0-9]/[0-9]|[A-Za-z][{SPACE}]*[+-][{SPACE}]*[A-Za-z0-9]", t)
    weak = poor or not math and bool(mathy)
    figure, table_ = bool(re.search("(?i)그림|도형|그래프|figure|diagram", t)), bool(re.search(rf"(?i)다음 표|표[{SPACE}]*[0-9]|table", t))
    parts = ["TEXT_OK", "NUMBER_OK" if number else "NUMBER_REVIEW_REQUIRED"] + (["CHOICES_REVIEW_REQUIRED"] if broken else ["CHOICES_OK"] * bool(choices)) + (["MATH_REVIEW_REQUIRED"] if weak else ["MATH_OK"] * bool(math)) + ["FIGURE_DETECTED"] * figure + ["TABLE_DETECTED"] * table_
    told = (["circled_number"] if circled else ["number_left_in_stem"] * (not number)) + ["choice_missing_or_out_of_order"] * broken + (["formula_incomplete"] if poor else ["formula_not_structured"] * weak) + ["figure_detected"] * figure + ["table_detected"] * table_ + ["answer_copied"] * bool(answer)
    fell = bool(re.search("[A-Za-z][0-9]", t)) and not re.search("[²³^]", t)
    red = not stem or any("lost_exponent" in m[3] for m in math)
    if scan:
        parts += ["LOW_CONFIDENCE"] + ["MATH_REVIEW_REQUIRED"] * (not weak)
        told += ["raw_scan"] + ["exponent_maybe_lost"] * fell
        m = re.search(rf"(?:\A|\n)[{SPACE}]*([0-9]{{4}})(?![A-Za-z0-9_])", t)
        number, red = number or (m and m[1]), red or fell
    verdict = "RED" if red else "YELLOW" if scan or any("REVIEW_REQUIRED" in p for p in parts) or figure or table_ else "GREEN"
    return ("SUCCEEDED" if verdict == "GREEN" else "REVIEW_REQUIRED", verdict, number, stem, math, choices, answer, figure, table_, parts, told)


CASES = [
    None, "", " \n ", "①②", "1. 2x + 3 = 11일 때 x를 구하여라.\n정답: 4", "01. Find x.", "[1] Find x.", "문제 2 다음을 풀어라.", "① 2", "4. x2 - 5x + 6 = 0", "4. x² - 5x + 6 = 0", "4. x^2 - 5x + 6 = 0", "3. a\n① 2\n③ 6\n⑤ 10", "3. b\n② 4\n① 2", "7. \n", "7. (2) only\n(3) x",
    "0123 scanned y)2 and (x+1)2", "stem 3. inside", "12. 1/2 + sqrt(3), sqrt(x; a<=b >= c ± d √5", "5) \r\n답：√2\r\n", "다음 표 그림 table", "x" * 100_000 + "=", "a=b " * 20_000, "= " * 5, "abc - d", "그래프\u3000①",
]


def as_rows(df):
    keep = lambda r: (r.status, r.verdict, r.number, r.stem, [(m.original, m.latex, m.structure_ok, list(m.notes)) for m in r.formulas], [tuple(c) for c in r.choices], r.answer, r.has_figure, r.has_table, list(r.components), list(r.warnings))
    return {r.k: keep(r.found) for r in df.collect()}


@pytest.mark.parametrize("scan", [False, True])
def test_recognised(spark, scan):
    """Nulls, texts without letters, very long ones, clashing columns, an empty table."""
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(CASES)], "k int, text string, found string").repartition(3)
    found = as_rows(recognised(rows.drop("found"), scan=scan))
    for i, t in enumerate(CASES):
        assert found[i] == plain(t, scan), (i, (t or "")[:40])
    assert recognised(rows.limit(0)).count() == 0
    plan = recognised(rows, scan=scan)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


@pytest.mark.parametrize("name", ["recognised_items", "scanned_items"])
def test_queries(spark, sf, name):
    """Whole texts of all documents."""
    want = {r.doc_id: plain(r.raw, name == "scanned_items") for r in raw_problems(spark, sf).collect()}
    rows = QUERIES[name](spark, sf).collect()
    assert len(rows) == len(want)
    for r in rows:
        w = want[r.doc_id]
        formulas = " ".join("|".join([m[0], m[1] if m[1] is not None else "-", str(m[2]).lower(), "+".join(m[3])]) for m in w[4])
        assert (r.status, r.verdict, r.number, r.stem_sha256, r.formulas, r.choices, r.answer, r.has_figure, r.has_table, r.components, r.warnings) == (*w[:3], hashlib.sha256(w[3].encode()).hexdigest(), formulas, ";".join("|".join(map(str, c)) for c in w[5]), *w[6:9], ",".join(w[9]), ",".join(w[10]))
    assert {w[1] for w in want.values()} >= {"RED", "YELLOW"}


def test_workbook_anchor(spark):
    cases = {
        "0159 | 대표 문제": ("0159", "four_digit"), "# 0274": ("0274", "four_digit"), "0161 • ② • ③ 서술형": ("0161", "four_digit"), "05-3 이차함수의 최대, 최소": ("05-3", "section"), "① 10": (None, None), "ㄱ. a > b": (None, None),
        "보기": (None, None), "유형 02 수치 대입법": (None, None), "(가) 2 ≤ x ≤ 10": (None, None), "함수 $f(x)$": (None, None), "12. x": ("12", "dotted"), "[3] y": ("3", "dotted"), "![a](b)": (None, None), None: (None, None),
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", R.workbook_anchor(F.col("t")).alias("a")).collect()
    assert {r.t: (r.a.number, r.a.kind) for r in rows} == cases


def test_conflicts_and_errors(spark):
    told = lambda a, b: [tuple(c) for c in spark.range(1).select(R.formula_conflicts(F.array(*map(F.lit, a)).cast("array<string>"), F.array(*map(F.lit, b)).cast("array<string>"))).first()[0]]
    assert told(["x^{2} + y^3"], ["x^3 + y³"]) == [("exponent_mismatch", "x^2 vs x^3")]
    assert told(["a_{1} x^2 x^4"], ["a_2 x^4 x^5"]) == [("exponent_mismatch", "x^4 vs x^5"), ("subscript_mismatch", "a_1 vs a_2")]
    assert told([r"\frac{1}{2}", r"\sqrt{3}"], [r"\frac{ 1 }{2} \sqrt{5}"]) == [("radical_mismatch", "3 vs 5")]
    assert told([r"\frac{1}{2}"], [r"\frac{1}{3}"]) == [("fraction_mismatch", "1/2 vs 1/3")] and told([], ["x^2"]) == [] and told(["x^2"], ["y^3"]) == []
    rows = spark.createDataFrame([(1, "x2 < 3", [("x²", "x2")], ["√2"], ["≤", "≥"], ["|x|"]), (2, "x² <= |y| √", [("x²", "x2")], ["√2"], ["≤"], ["|x|"]), (3, None, None, None, None, None)], "k int, t string, c array<struct<whole:string,collapsed:string>>, r array<string>, i array<string>, b array<string>")
    found = {r.k: list(r.e) for r in rows.select("k", R.critical_errors(F.col("t"), F.col("c"), F.col("r"), F.col("i"), F.col("b")).alias("e")).collect()}
    assert found == {1: ["COLLAPSED:x²", "RADICAL_MISSING", "LE_FLATTENED", "BARS_MISSING"], 2: [], 3: []}


def test_patterns_as_plain(spark):
    """What is looked for by parts or first letters is what the plain patterns find."""
    from stemma.functions import cues as C

    parts = ["a", "1", "22", "/", "+", " - ", " ", "\n", "x2", ")3", "=", "²", "≥", "sqrt", "그림", "표", "Table", "FIGURE", "다음 표", "\t"]
    texts = spark.createDataFrame([("".join(random.Random(i).choices(parts, k=3)),) for i in range(500)], "t string")
    t = F.col("t")
    all_of = lambda p: F.regexp_extract_all(t, F.lit(p), F.lit(1))
    same = [
        R.looks_mathematical(t) == t.rlike(r"[=≠≤≥<>±√]|<=|>=|\^|²|³|sqrt|\d/\d|[A-Za-z]\s*[+-]\s*[A-Za-z0-9]"), t.rlike(R.FORMULA_SIGN) == t.rlike(r"[=≠≤≥<>±√^²³]|sqrt"),
        all_of(R.BESIDE[0]) == all_of(r"(?<![0-9])([A-Za-z]\d)(?![0-9])"), F.regexp_replace(t, R.SQUEEZED, " ") == F.regexp_replace(t, r"\s+", " "), R.strip(t) == F.regexp_replace(t, r"^\s+|\s+\z", ""),
        C.shows_figure(t) == t.rlike(r"(?i)그림|도형|그래프|figure|diagram"), C.shows_table(t) == t.rlike(r"(?i)다음 표|표\s*\d|table"),
    ]
    assert texts.where(~F.forall(F.array(*same), lambda ok: ok)).count() == 0
