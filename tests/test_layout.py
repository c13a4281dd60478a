"""Layouts of pages against a walk over each page, block by block."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import stemma.queries  # noqa: F401
from stemma.catalog import QUERIES
from stemma.functions import layout as L
from stemma.operators import layout as Q
from stemma.sources.views import text_blocks

ROLES = {"EXERCISE_PROBLEM", "WORKED_EXAMPLE", "THEORY_LIST", "SOLUTION_STEP", "UNKNOWN", "PAGE_DECORATION"}


def has(pattern, text):
    return re.search(pattern.replace(r"\z", r"\Z"), text) is not None


def bare(text):
    return re.sub(r"\s+", "", text)


def read_number(text):
    """display, value, style, rest, glued, ambiguous"""
    t = bare(text)
    if re.match("(?:STEP|Step|step)[0-9]", t):
        return dict(display=None, value=None, style="VISUAL_MARKER", rest=t, glued=False, ambiguous=False, step=True)
    if t and t[0] in "①②③④⑤⑥⑦⑧⑨⑩":
        return dict(display=t[0], value="①②③④⑤⑥⑦⑧⑨⑩".index(t[0]) + 1, style="CIRCLED", rest=t[1:], glued=len(t) > 1, ambiguous=False, step=False)
    for pattern, style in ((r"\[([0-9]{1,4})\]", "BOXED"), (r"\(([0-9]{1,2})\)", "PAREN"), (r"([0-9]{1,4})[.)]", "NUMBER_PUNCT")):
        if m := re.match(pattern, t):
            return dict(display=m[1], value=int(m[1]), style=style, rest=t[m.end() :], glued=m.end() < len(t), ambiguous=False, step=False)
    if not (m := re.match("[0-9]{1,4}", t)):
        return dict(display=None, value=None, style=None, rest=t, glued=False, ambiguous=False, step=False)
    rest = t[m.end() :]
    return dict(display=m[0], value=int(m[0]), style=f"{len(m[0])}_DIGIT", rest=rest, glued=bool(re.match(r"[0-9가-힣A-Za-z($\\]", rest)), ambiguous=bool(re.match("[0-9]", rest)), step=False)


def read_run(run, rest, near):
    fits = [(run[:k], run[k:] + rest) for k in range(1, len(run) + 1) if any(abs(n - int(run[:k])) == 1 for n in near)]
    if len(fits) != 1:
        return dict(display=run, value=int(run), style=f"{len(run)}_DIGIT", rest=rest, glued=True, ambiguous=True, step=False)
    n, left = fits[0]
    clean = not re.match("[0-9]", left) or re.match("[0-9][가-힣]", left)
    return dict(display=n, value=int(n), style=f"{len(n)}_DIGIT", rest=left, glued=bool(left) or not clean, ambiguous=not clean, step=False)


def regions(blocks):
    body = [b for b in blocks if 0.07 < b["y"] < 0.93]
    gap, cut, last = 0, 0.5, None
    for x in sorted({b["x"] for b in body if 0.18 <= b["x"] <= 0.88}):
        if last is not None and x - last > gap:
            gap, cut = x - last, (x + last) / 2
        last = x
    sides = [b for b in body if b["x"] + b["w"] / 2 < cut], [b for b in body if b["x"] + b["w"] / 2 >= cut]
    middle = lambda v: sorted(v)[len(v) // 2] if v else 0
    lw, rw = (middle([b["w"] for b in s]) for s in sides)
    rx = middle([b["x"] for b in sides[1]])
    lc, rc = (sum(len(b["content"]) for b in s) for s in sides)
    if not body:
        return "UNKNOWN", gap, cut
    if gap >= 0.08 and 0 < rw < 0.32 and rx >= 0.62 and rw / max(lw, 0.2) < 0.62 and sides[1] and lc > rc:
        return "MAIN_PLUS_SIDEBAR", gap, cut
    if gap >= 0.08 and min(map(len, sides)) >= 2 and rw >= 0.28 and lw >= 0.28 and 0.38 < cut < 0.62:
        return "TWO_COLUMN", gap, cut
    return "MIXED" if gap >= 0.08 and all(sides) else "ONE_COLUMN", gap, cut


def region(kind, cut, x, y):
    if y <= 0.07:
        return "HEADER"
    if y >= 0.93:
        return "FOOTER"
    if kind == "MAIN_PLUS_SIDEBAR" and min(0.92, cut) <= x <= min(0.92, cut) + max(0.08, 0.98 - cut):
        return "SIDEBAR"
    return "MAIN_COLUMN_2" if kind == "TWO_COLUMN" and x >= cut else "MAIN_COLUMN_1"


def walk(blocks):
    """Anchors and problems of one page."""
    blocks = [b | {"content": b["content"] or "", "x": min(0.98, max(0, b["x"] or 0)), "y": min(0.98, max(0, b["y"] or 0))} for b in blocks]
    blocks = [b | {"w": min(1 - b["x"], max(0.002, b["w"] or 0))} for b in blocks]
    kind, _, cut = regions(blocks)
    ns = [read_number(b["content"]) for b in blocks]
    seeds = [n["value"] for n, b in zip(ns, blocks) if n["value"] is not None and n["style"] not in ("CIRCLED", "PAREN") and b["x"] <= 0.38 and (n["style"] == "4_DIGIT" or n["value"] >= 10 or n["glued"])]
    for i, b in enumerate(blocks):
        run, near = re.match("[0-9]{3,4}", bare(b["content"])), [s for s in seeds if 10 <= s <= 999]
        if run and len(run[0]) == 4 and len(near) >= 2:
            ns[i] = read_run(run[0], bare(b["content"])[4:], near)
        elif ns[i]["ambiguous"] and run and len(seeds) >= 2:
            ns[i] = read_run(run[0], ns[i]["rest"], seeds)
    page_text = "\n".join(b["content"] for b in blocks)
    ask = lambda t: has(L.PROBLEM_BODY, t)
    body = [b for b in blocks if 0.07 < b["y"] < 0.93]
    key = len(body) >= 8 and sum(ask(b["content"]) for b in body) <= 1 and sum(bool(re.match("[0-9]{2,}", bare(b["content"]))) for b in body) >= 8
    catalog = sum(bool(re.match("[0-9]{2,4}가", bare(b["content"]))) and not ask(b["content"]) for b in blocks) >= 6 and sum(ask(b["content"]) for b in blocks) <= 3
    out = []
    for i, (b, n) in enumerate(zip(blocks, ns)):
        where = region(kind, cut, b["x"], b["y"])
        if n["step"]:
            out.append(dict(pos=b["pos"], x=b["x"], y=b["y"], display="STEP", kind="STEP_MARKER", score=0.1, region=where, preview="", ambiguous=False, evidence=[]))
            continue
        if n["display"] is None:
            continue
        rest, following = n["rest"], "".join(o["content"] for o in blocks[i : i + 4])
        blob, text = f"{rest} {following}", rest + following
        attached = ask(blob) or n["style"] == "4_DIGIT" and len(re.sub(r"[|\s#]", "", rest)) >= 4 or has(r"[=^\\]|frac|sqrt|\d+x", blob) and len(bare(blob)) >= 8 or has(L.CIRCLED, blob) or has(L.STEM_START, rest) and len(rest) >= 4 and not has(L.THEORY_HEAD, rest[:12])
        theory = not ask(blob) and (has(L.LIST_MARK, blob) or has(L.THEORY_HEAD, rest) or has(L.EXAMPLE_PAGE, page_text[:400]) and len(rest) < 18)
        hit = n["style"] != "CIRCLED" and any(abs(s - n["value"]) == 1 for s in seeds)
        aligned = sum(m["display"] is not None and abs(o["x"] - b["x"]) < 0.05 for m, o in zip(ns, blocks))
        leftish, main = 0.05 <= b["x"] <= 0.36, where.startswith("MAIN")
        choice = n["style"] == "CIRCLED" or n["style"] == "PAREN" and has(L.CIRCLED, following)
        score = 0.15 + 0.12 * leftish + 0.18 * attached + 0.14 * hit + 0.08 * (aligned >= 2) + 0.08 * main + 0.05 * has(r"[=^\\]", text) - 0.45 * choice - 0.28 * theory - 0.3 * (not main) - 0.2 * n["ambiguous"] - 0.15 * (n["style"] == "NUMBER_PUNCT" and len(rest) < 8 and theory)
        score = max(0, min(1, score))
        if choice:
            a = "CHOICE_MARKER"
        elif where in ("HEADER", "FOOTER"):
            a = "PAGE_DECORATION"
        elif (n["style"] == "PAREN" or theory) and not ask(text) or n["style"] == "1_DIGIT" and len(rest) < 28 and not ask(text) and not has(r"[=^\\]", rest):
            a = "THEORY_LIST"
        else:
            a = "PROBLEM_ANCHOR" if attached and (leftish or hit) else "UNKNOWN"
        if len(n["display"]) >= 2 and n["display"][0] == "0" and n["style"] != "4_DIGIT":
            a, score = "PAGE_DECORATION", min(score, 0.3)
        if (key or catalog) and a == "PROBLEM_ANCHOR" and not ask(rest[:80] + following):
            a, score = "PAGE_DECORATION", min(score, 0.25)
        said = [("left_of_main_band", leftish), ("stem_or_instruction", attached), ("neighbor_plus_minus_one", hit), ("same_x_band_count", aligned >= 2), ("choice_marker", choice), ("definition_or_list", theory), ("inside_rail", where == "SIDEBAR"), ("left_index_cluster", aligned >= 2 and hit)]
        out.append(dict(pos=b["pos"], x=b["x"], y=b["y"], display=n["display"], kind=a, score=score, region=where, preview=rest[:80], ambiguous=n["ambiguous"], evidence=[k for k, v in said if v]))
    ps = sorted((a for a in out if a["kind"] == "PROBLEM_ANCHOR"), key=lambda a: (a["y"], a["x"], a["pos"]))
    for i, p in enumerate(ps):
        top = max(0.07, p["y"] - 0.004)
        low = ps[i + 1]["y"] - 0.006 if i + 1 < len(ps) else 0.93 - 0.01
        p |= {"bx": max(0.05, min(0.5, p["x"] - 0.012)), "by": top, "bh": min(0.93, max(top + 0.04, low)) - top}
    runs, run = [], []
    for p in [*ps, None]:
        if p and run and abs(int(p["display"]) - int(run[-1]["display"])) <= 2 and abs(p["bx"] - run[-1]["bx"]) < 0.08:
            run.append(p)
            continue
        if len(run) > 1:
            runs.append((run[0]["by"], run[-1]["by"] + run[-1]["bh"], len(run)))
        run = [p]
    for i, p in enumerate(ps):
        until = "".join(b["content"] for b in blocks if b["y"] >= p["by"] - 0.002 and (i + 1 == len(ps) or b["y"] < ps[i + 1]["by"] - 0.002))
        p["role"] = role(p, until, blocks, any(a - 0.02 <= p["by"] <= z + 0.02 for a, z, _ in runs), any(abs(int(o["display"]) - int(p["display"])) == 1 for o in ps))
    return out, ps, runs


def role(p, until, blocks, exercise, sequence):
    if p["region"] in ("HEADER", "FOOTER"):
        return "PAGE_DECORATION", 0.2, 0.9
    body, text = bare(p["preview"]), bare(until)
    nearby = "".join(b["content"] for b in blocks if abs(b["y"] - p["by"]) < 0.08 and abs(b["x"] - p["bx"]) < 0.25)
    local = False
    for b in blocks:
        t = bare(b["content"])
        local |= p["by"] - 0.01 <= b["y"] <= p["by"] + p["bh"] and b["x"] <= 0.55 and not has(L.ANSWER_HEADER, t) and (has(L.LOCAL_HEAD, t) or has(L.SOLUTION_HEAD, t))
    asks = has(L.PROBLEM_BODY, text) or has(L.PROBLEM_BODY, body)
    derived = has(L.SOLUTION_HEAD, text) and not has(L.ANSWER_HEADER, text) and has(L.EQUALS_CHAIN, text)
    example = has(L.EXAMPLE_HEAD, nearby) or has(L.EXAMPLE_HEAD, body[:12])
    scores = {
        "EXERCISE_PROBLEM": 0.28 * exercise + 0.18 * sequence + 0.22 * asks + 0.12 * has(L.CHOICES, text),
        "WORKED_EXAMPLE": 0.34 * example + 0.22 * (local or has(L.EXPLAIN_HEAD, text)) + 0.5 * local + 0.18 * derived,
        "THEORY_LIST": 0.35 * (has(L.SECTIONISH, body) and not asks and len(p["display"]) <= 2) + 0.4 * (has(L.DEFINITION, body) and not asks),
        "SOLUTION_STEP": 0.2 * derived + 0.25 * (len(p["display"]) == 1 and not asks and not exercise),
    }
    order = sorted(scores, key=lambda r: -scores[r])
    best, second = scores[order[0]], scores[order[1]]
    if best < 0.28:
        return "UNKNOWN", best, 0.35
    if best - second < 0.08:
        return "UNKNOWN", best, 0.4
    if order[0] == "WORKED_EXAMPLE" and asks and exercise and sequence and not local:
        return "EXERCISE_PROBLEM", scores["EXERCISE_PROBLEM"], min(0.9, 0.5 + scores["EXERCISE_PROBLEM"])
    return order[0], best, min(0.95, 0.45 + best)


def pages_of(blocks):
    pages = defaultdict(list)
    for r in sorted(blocks.collect(), key=lambda r: (r.page, r.pos)):
        pages[r.page].append(r.asDict())
    return pages


def held(blocks, anchors, roles, runs):
    kinds, met = set(), set()
    anchors, roles, runs = ({k: sorted(v) for k, v in x.items()} for x in (anchors, roles, runs))
    for page, bs in pages_of(blocks).items():
        want, ps, spans = walk(bs)
        near = lambda v: pytest.approx(v, abs=2e-6)
        for w, h in zip(sorted((w["pos"], w["display"], w["kind"], w["region"], w["preview"], w["ambiguous"], ",".join(w["evidence"]), w["score"]) for w in want), anchors.get(page, []), strict=True):
            assert h[:-1] == w[:-1] and h[-1] == near(w[-1]), (page, h, w)
            kinds.add(w[2])
        for w, h in zip(sorted((p["pos"], p["display"], p["role"][0], p["bx"], p["by"], p["bh"], *p["role"][1:]) for p in ps), roles.get(page, []), strict=True):
            assert h[:3] == w[:3] and h[3:] == near(w[3:]), (page, h, w)
            met.add(w[2])
        assert [x for r in runs.get(page, []) for x in r] == near([x for r in sorted(spans) for x in r])
    return kinds, met


def grouped(df, *columns):
    out = defaultdict(list)
    for r in df.select("page", *columns).collect():
        out[r.page].append(tuple(r[c] for c in columns))
    return out


def test_queries(spark, sf):
    """The registered queries over whole tables, on every page."""
    run = lambda name: QUERIES[name](spark, sf)
    kinds, met = held(
        text_blocks(spark, sf), grouped(run("anchor_classes"), "pos", "display", "kind", "region", "preview", "ambiguous", "evidence", "score"),
        grouped(run("context_roles"), "pos", "display", "role", "bx", "by", "bh", "role_score", "confidence"), grouped(run("exercise_runs"), "start", "end", "problems"),
    )
    assert kinds == {"PROBLEM_ANCHOR", "THEORY_LIST", "CHOICE_MARKER", "STEP_MARKER", "PAGE_DECORATION", "UNKNOWN"} and len(met) >= 3


def odd_pages(seed=0):
    rng = random.Random(seed)
    words = ["구하시오", "값은?", "예제", "풀이", "설명", "정의", "x=3", "=", "이므로", "①", "②", "정리", "보기", "text", "(", "그림", "항:", "다음 중", "정답 및 풀이", "⑴"]
    rows = []
    for page in range(150):
        for pos in range(rng.choice([1, 4, 9, 14])):
            number = rng.choice(["", "", "1 ", "2. ", "12", "13 ", f"{10 + pos} ", f"{20 + pos}.", "0007 ", "007 ", "[14] ", "(3) ", "③ ", "STEP 2", "1213", "12345", "10가", "9876"])
            text = number + " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 6])))
            rows.append((page, pos, rng.choice([0.02, 0.1, 0.12, 0.2, 0.3, 0.55, 0.7, 0.95, 1.2]), rng.choice([0.01, 0.1, 0.1, 0.2, 0.21, 0.5, 0.8, 0.95, -0.1]), rng.choice([0.0, 0.1, 0.3, 0.5]), 0.02, rng.choice([text, text, text, None, "\n" + text])))
    return rows + [(900, 0, None, None, None, None, "12 구하시오"), (901, 0, 0.1, 0.5, 0.2, 0.1, "가" * 200_000), (902, 5, 0.1, 0.5, 0.2, 0.1, None), (902, 5, 0.1, 0.5, 0.2, 0.1, None), (903, 0, 0.1, 0.2, 0.3, 0.02, "3 x=1 abcdef"), (903, 1, 0.7, 0.4, 0.2, 0.02, "풀이 ) x = 1 이므로 y = 2")]


def test_odd_pages(spark):
    """Nulls, boxes beyond the page, ties, repeated blocks and very long texts; all roles are met."""
    rows = odd_pages()
    blocks = spark.createDataFrame([(*r, "n") for r in rows], "page long, pos long, x double, y double, w double, h double, content string, kind string").repartition(3)
    anchors, roles = Q.number_anchors(blocks), Q.context_roles(blocks)
    kinds, met = held(
        blocks, grouped(anchors.selectExpr("*", "array_join(evidence, ',') AS said"), "pos", "display", "kind", "region", "preview", "ambiguous", "said", "score"), grouped(roles, "pos", "display", "role", "bx", "by", "bh", "role_score", "confidence"),
        grouped(Q.exercise_runs(Q.problem_boxes(anchors)), "start", "end", "problems"),
    )
    assert met == ROLES - {"PAGE_DECORATION"} and len(kinds) == 6
    found = {r.page: (r.layout, r.gap, r.cut) for r in Q.page_regions(blocks).collect()}
    for page, bs in pages_of(blocks).items():
        clean = [b | {"content": b["content"] or "", "x": min(0.98, max(0, b["x"] or 0)), "y": min(0.98, max(0, b["y"] or 0))} for b in bs]
        want = regions([b | {"w": min(1 - b["x"], max(0.002, b["w"] or 0))} for b in clean])
        assert found[page][0] == want[0] and found[page][1:] == pytest.approx(want[1:])
    assert Q.context_roles(blocks.limit(0)).count() == 0
    # one exchange of blocks, by page
    plan = roles._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_blocks_without_numbers_are_not_sorted(spark):
    """Rows that no window needs are left out below the sort, and patterns that look for first letters find what the plain ones do."""
    blocks = spark.createDataFrame([(1, 0, 0.2, 0.1, 0.6, 0.02, "21. 값은?")], "page long, pos long, x double, y double, w double, h double, content string")
    plan = Q.number_anchors(blocks)._jdf.queryExecution().optimizedPlan().toString()
    assert "step_marker" in plan[plan.rindex("Window") :].split("Generate")[0].split("Filter")[1]
    plain = [
        (L.PROBLEM_BODY, r"구하시오|구하여라|구하라|값은\?|값은\b|고르시오|다음 중|다음중|서술하시오|증명하시오|말하시오|만족시키|고르면"), (L.THEORY_HEAD, r"용어|정의|정리|성질|개념|주의|보기|예제|풀이|설명|항:|상수항|동류항|내림차순|오름차순"),
        (L.LIST_MARK, r"[⑴⑵⑶⑷⑸⑹⑺⑻⑼⑽㈎㈏㈐]"), (L.CIRCLED, r"[①②③④⑤⑥⑦⑧⑨⑩]"), (L.CHOICES, r"[①②③④⑤]"), (L.EXAMPLE_PAGE, r"보기|예제|정의|정리"), (L.FORMULA, r"[=^\\]|frac|sqrt|\d+x"),
    ]
    parts = ["값은", "?", "구하라", " ", "다음", "중", "항", ":", "상수항", "⑽", "⑾", "⑿", "㈐", "㈑", "⑩", "⑪", "⑥", "⑤", "frac", "fra", "2x", "2 x", "\\", "보기", "x", "말하", "시오"]
    texts = spark.createDataFrame([("".join(random.Random(i).choices(parts, k=3)),) for i in range(400)], "t string")
    assert texts.where(" OR ".join(f"(rlike(t, r'{a}') <> rlike(t, r'{b}'))" for a, b in plain)).count() == 0


def test_pages_are_not_sorted_once_a_problem(spark):
    """What context_roles() sorts holds the blocks of a page in one row; blocks without a page are a page."""
    blocks = spark.createDataFrame([(p, i, 0.2, 0.1 + i / 10, 0.6, 0.02, f"{21 + i}. 다음 중 옳은 것을 고르시오") for p in (None, 7) for i in range(4)], "page long, pos long, x double, y double, w double, h double, content string")
    found = Q.context_roles(blocks)
    rows = [(r.page, r.pos, r.display, r.role) for r in found.collect()]
    assert len(rows) == 8 and {r[1:] for r in rows if r[0] is None} == {r[1:] for r in rows if r[0] == 7}
    # both sorts, that of blocks and that of problems, are of rows of which the first of a page alone has its blocks
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("= 0) THEN bs#") == 1 and plan.count("= 1) THEN bs#") == 1


def test_runs_of_digits_are_read_once(spark):
    """The digits that a text begins with are cut off once, not at every place where they are used."""
    assert str(L.number_among(F.col("n"), F.col("content"), F.col("seeds"))).count("{3,4}") == 1
