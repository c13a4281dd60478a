"""Folds over parts, and the replay of headings, against a walk row by row; no group needs one task."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stemma.operators import replay as R
from stemma.operators import scan as S


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("parts", [1, 7, 40])
def test_running(spark, parts, strict):
    """One group of most rows over many parts, a null group, nulls in values, an empty table."""
    rng = random.Random(parts)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), i, rng.choice([None, None, rng.randrange(100)]), rng.random() < 0.01) for i in range(900)]
    t = spark.createDataFrame(rows, "g string, i long, v long, flag boolean").repartition(5)
    folds = {"last": ("last", F.col("v")), "s": ("sum", F.col("v")), "n": ("count", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v")), "any": ("any", F.col("flag"))}
    found = {r.i: r for r in S.running(t, ["g"], ["i"], folds, strict=strict, parts=parts).collect()}
    assert len(found) == len(rows)
    before = defaultdict(list)
    for g, i, v, flag in rows:
        seen = before[g] if strict else [*before[g], (v, flag)]
        vs = [x for x, _ in seen if x is not None]
        want = (vs[-1] if vs else None, sum(vs) if vs else None, len(vs), min(vs, default=None), max(vs, default=None), any(f for _, f in seen) if seen else None)
        r = found[i]
        assert (r.last, r.s, r.n or 0, r.lo, r.hi, r.any) == want
        before[g].append((v, flag))
    assert S.running(t.limit(0), ["g"], ["i"], folds).count() == 0


def test_parts_are_bounded(spark):
    """All rows of one group: the windows of the plan are over parts, and each task has its share."""
    t = spark.range(20_000).select(F.lit(1).alias("g"), (F.col("id") * 7919 % 20_011).alias("v"))
    placed = S.in_order(t, ["g"], ["v"], parts=10)
    sizes = [r["count"] for r in placed.groupBy("__part").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 4000
    plan = S.ranked(t, ["g"], ["v"], parts=10)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__part" in plan and "hashpartitioning(g#" not in plan.split("BroadcastExchange")[0]
    # equal rows too are spread
    same = S.in_order(spark.range(10_000).select(F.lit(1).alias("g"), F.lit(5).alias("v")), ["g"], ["v"], parts=10)
    assert max(r["count"] for r in same.groupBy("__part").count().collect()) < 3000


def test_quantiles(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "b"]), rng.choice([None, rng.randrange(50), 7])) for _ in range(500)] + [("one", 3), ("two", 1), ("two", 2), ("none", None)]
    t = spark.createDataFrame(rows, "g string, v long")
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = {r.g: (r.n, list(r.q)) for r in S.quantiles(t, ["g"], "v", shares, parts=9).collect()}
    want = t.where("v IS NOT NULL").groupBy("g").agg(F.count("v").alias("n"), F.expr(f"percentile(v, array({', '.join(map(str, shares))}))").alias("q"))
    assert set(found) == {"hot", "b", "one", "two"}
    for r in want.collect():
        assert found[r.g][0] == r.n and found[r.g][1] == pytest.approx(list(r.q))


def walk(items, headings, types):
    """The replay of all headings for each item, and the carry from item to item."""
    allowed = {(s, c): (n, t) for s, c, n, t in types}
    stream = sorted((h for h in headings if h["section"] is not None), key=lambda h: (h["page"], h["x"] >= 0.48, h["y"], h["x"]))
    last, out = {}, {}
    for it in sorted(items, key=lambda r: (r["number"], r["page"], r["top"], r["item"])):
        inherit, c_stage, blocked = None, False, False
        for h in stream:
            at, mine = (h["page"], h["x"] >= 0.48), (it["page"], it["x"] >= 0.48)
            if h["section"] != it["section"] or not (at < mine or at == mine and h["y"] <= it["top"] + 0.06):
                continue
            if h["kind"] == "c_stage":
                inherit, c_stage, blocked = None, True, True
            elif c_stage or h["code"] is None and h["node"] is None and h["type"] is None and not h["ambiguous"]:
                continue
            elif h["ambiguous"]:
                inherit, blocked = None, True
            else:
                inherit, blocked = h, False
        s = it["section"]
        stem = list(dict.fromkeys(c for c in it["stem_codes"] or [] if (s, c) in allowed))
        page = list(dict.fromkeys(c for c in it["page_codes"] or [] if (s, c) in allowed))
        got = None
        if s is not None:
            if len(stem) == 1 and (c_stage or inherit is None or inherit["code"] == stem[0]):
                got = (stem[0], *allowed[s, stem[0]], "stem_type_marker")
            elif not c_stage and len(page) == 1:
                got = (page[0], *allowed[s, page[0]], "page_ocr_unique_type")
            elif not c_stage and inherit:
                got = (inherit["code"], inherit["node"], inherit["type"], "inherit_concept_heading" if (inherit["how"] or "").startswith("concept") else "inherit_previous_in_section")
            elif not c_stage and not blocked and s in last:
                got = (*last[s][:3], "inherit_previous_in_section")
            if got and got[1] is not None and got[2] is not None and not c_stage and len(stem) <= 1:
                last[s] = got
        typed = got and (got[1] is not None or got[2] is not None)
        reason = "NO_SECTION" if s is None else "TYPE_MARKER_AMBIGUOUS" if len(stem) > 1 else "" if typed else "TYPE_MARKER_MISSING"
        out[it["item"]] = (*(got or (None,) * 4), reason, s is not None and c_stage, s is not None and blocked)
    return out


@pytest.mark.parametrize("parts", [1, 13])
def test_replay(spark, parts):
    """The stage, ambiguous headings and the last type given, in one section over many parts; nulls, ties and clashing names."""
    rng = random.Random(4)
    section = lambda: rng.choice([1, 1, 1, 1, 2, 3, None])
    headings = [dict(section=section(), page=rng.randrange(60), x=rng.choice([0.1, 0.6]), y=round(rng.random(), 3), kind=rng.choice(["type_pill"] * 20 + ["c_stage", None]), code=rng.choice([None, 1, 2, 3, 4]), node=rng.choice([None, 1, 2]), type=rng.choice([None, 11, 12]), how=rng.choice(["concept_pill", "type_pill", None]), ambiguous=rng.choice([None, False, False, True])) for _ in range(200)]
    items = [dict(item=i, number=rng.randrange(200), section=section(), page=rng.randrange(60), x=rng.choice([0.1, 0.6]), top=round(rng.random(), 3), stem_codes=rng.choice([None, [], [], [1], [2, 2], [1, 3], [9]]), page_codes=rng.choice([None, [], [], [3], [1, 2]]), code=99, how="x") for i in range(400)]
    types = [(s, c, c * 10 if c < 4 else None, c * 100) for s in (1, 2, 3) for c in (1, 2, 3, 4)]
    hs = spark.createDataFrame(headings, "section long, page long, x double, y double, kind string, code long, node long, type long, how string, ambiguous boolean").repartition(3)
    its = spark.createDataFrame(items, "item long, number long, section long, page long, x double, top double, stem_codes array<long>, page_codes array<long>, code long, how string").repartition(3)
    ts = spark.createDataFrame(types, "section long, code long, node long, type long")
    found = R.replayed_types(its, hs, ts, parts)
    got = {r.item: (r.code, r.node, r.type, r.how, ",".join(r.reasons), r.c_stage, r.blocked) for r in found.collect()}
    want = walk(items, headings, types)
    assert got == want
    assert {w[3] for w in want.values()} == {None, "stem_type_marker", "page_ocr_unique_type", "inherit_concept_heading", "inherit_previous_in_section"} and any(w[5] for w in want.values())
    assert R.replayed_types(its.limit(0), hs, ts, parts).count() == 0
    assert R.replayed_types(its, hs.limit(0), ts.limit(0), parts).where("code IS NOT NULL").count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_stages(spark, parts):
    """A book without stages, a null book, fillers, what was seen before what is named, early pages, and an empty table."""
    rng = random.Random(9)
    pages = [(b, p, rng.choice([None] * 6 + ["A", "B"]), rng.choice([0.72, 0.9]), rng.choice([None, False, False, True])) for b in (1, 2, None) for p in range(1, 60)] + [(4, 1, "A", 0.9, False), (4, 2, None, None, False)]
    seen = [(b, p, "S", c) for b in (1, None) for p in (3, 30, 30, 58) for c in (0.98, 0.6)]
    ps = spark.createDataFrame([(b, p, c, c, f, fill) for b, p, c, f, fill in pages], "book long, page long, code string, label string, confidence double, filler boolean").repartition(3)
    ss = spark.createDataFrame([(b, p, c, c, f) for b, p, c, f in seen], "book long, page long, code string, label string, confidence double")
    want, ranges = {}, []
    for book in {p[0] for p in pages}:
        own = [p for p in pages if p[0] == book]
        hits = {}
        for _, p, c, f, _ in own:
            if c and p >= 8:
                hits[p] = (c, f, "TEXT_HEADING")
        for b, p, c, f in sorted(seen, key=lambda x: x[3]):
            if b == book:
                hits[p] = (c, f, "VISUAL_HEADING")
        at = sorted(hits)
        ranges += [(book, p, (q - 1 if q else max(x[1] for x in own)), hits[p][0]) for p, q in zip(at, [*at[1:], None])]
        for _, p, _, _, fill in own:
            last = max([q for q in at if q <= p], default=at[0] if at else None)
            want[book, p] = ("UNKNOWN", 0.0, "UNKNOWN") if fill or last is None else (hits[last][0], pytest.approx(hits[last][1] if last == p else max(0.55, hits[last][1] - 0.08)), hits[last][2] if last == p else "LAYOUT_BOUNDARY")
    assert {(r.book, r.page): (r.code, r.confidence, r.evidence) for r in R.stage_map(ps, ss, parts).collect()} == want
    found = R.stage_ranges(R.stage_hits(ps, ss), ps.groupBy("book").agg(F.max("page").alias("last_page")), parts).collect()
    assert sorted(map(str, ((r.book, r.page_start, r.page_end, r.code) for r in found))) == sorted(map(str, ranges))
    assert R.stage_map(ps.limit(0), ss.limit(0), parts).count() == 0


def test_replayed_types_deals_narrow_rows(spark, sf, monkeypatch):
    """Items are not dealt anew with the types of their section."""
    from stemma.operators import replay
    from stemma.sources.views import section_headings, section_items, section_types

    seen, real = [], replay.running
    monkeypatch.setattr(replay, "running", lambda rows, *a, **k: seen.append(rows.columns) or real(rows, *a, **k))
    replay.replayed_types(section_items(spark, sf).where("page < 400"), section_headings(spark, sf).where("page < 400"), section_types(spark, sf))
    assert len(seen) == 2 and not {"__types", "__stem", "stem_codes"} & set(seen[1])
