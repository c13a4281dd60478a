"""Strengthened types against a plain judge, row by row."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

import stemma.queries  # noqa: F401
from stemma.catalog import QUERIES
from stemma.operators.evidence import strengthened_types, with_neighbours
from stemma.queries.evidence import typed_documents


def judge(r, neighbour):
    agree = lambda t: (r["agreement"] or {}).get(t, "WEAK")
    inside = lambda name, t: t is not None and t in (r[name] or [])
    stem_intent, heading, inferred = r["stem_intent"], r["heading"], r["inferred"]
    cand = stem_intent or (inferred if inferred and agree(inferred) == "SUPPORT" else None) or (r["type"] if r["type"] != "TYPE_UNCLEAR" else None)
    math = agree(cand) if cand else "WEAK"
    support, strategy = math == "SUPPORT", inside("strategies", cand)
    key = bool(cand) and (inside("key_points", cand) or support)
    agrees, same = bool(heading and cand and heading == cand), bool(neighbour and cand and neighbour == cand)
    heading_only, neighbour_only = bool(heading and not stem_intent and not support), same and not support and not stem_intent
    conflicts = []
    if heading and cand and heading != cand and support or inside("review_reasons", "TYPE_HEADING_STEM_MISMATCH"):
        conflicts.append("heading_vs_math")
    if neighbour and cand and neighbour != cand and strategy:
        conflicts.append("neighbor_vs_strategy")
    if not agrees and heading and inferred and heading != inferred and inside("requested", inferred):
        conflicts.append("alias_vs_requested_quantity")
    if inside("review_reasons", "UNIT_CONFLICT"):
        conflicts.append("unit_conflict")
    if math == "CONFLICT":
        conflicts.append("math_conflict")
    tests = [("math_structure", support, 0.1), ("strategy", strategy, 0.08), ("key_point", key and support, 0.04), ("heading_alias", agrees and support and strategy, 0.04), ("neighbor_cluster", same and agrees and support and strategy, 0.03)]
    confidence = min(0.93, round((r["confidence"] or 0.0) + sum(v for _, t, v in tests if t) + 1e-12, 3))
    boosts = [n for n, t, _ in tests if t]
    if r["old_auto"]:
        return r["type"], "OLD_AUTO", "AUTO", None, cand, r["confidence"], [], conflicts
    sure = bool(cand) and cand not in ("TYPE_UNCLEAR", "CUBIC_QUARTIC_EQ") and support and strategy and key and not conflicts and not heading_only and not neighbour_only and confidence >= 0.78
    if sure:
        return cand, "NEW_AUTO", "AUTO" if r["unit_auto"] and not r["insufficient"] else "REVIEW", None, cand, confidence, boosts, conflicts
    stem = r["stem"] or ""
    if r["insufficient"] or len(stem) < 12:
        why = "OCR_INSUFFICIENT"
    elif heading_only:
        why = "HEADING_ONLY"
    elif neighbour_only:
        why = "NEIGHBOR_ONLY"
    elif conflicts:
        why = "HEADING_CONFLICT"
    elif "CUBIC_QUARTIC_EQ" in (r["type"], stem_intent):
        why = "NEW_TYPE_SUSPECTED"
    elif r["type"] == "TYPE_UNCLEAR" and not support:
        why = "TYPE_UNCLEAR"
    elif not support:
        why = "MATH_STRUCTURE_AMBIGUOUS"
    elif not strategy:
        why = "STRATEGY_AMBIGUOUS"
    elif inside("review_reasons", "SUBUNIT_HEADING_RISK"):
        why = "SUBUNIT_UNCERTAIN"
    elif r["conditions"] == 0 and "단," not in stem and "(가)" not in stem and not inside("requested", cand):
        why = "CONDITION_UNCLEAR"
    else:
        why = "TYPE_PROFILE_INSUFFICIENT" if r["anchor"] else "NO_ANCHOR"
    return r["type"], "REVIEW", "REVIEW", why, cand, r["confidence"], boosts, conflicts


def neighbours(rows, group, order):
    by, out = defaultdict(list), {}
    for r in rows:
        by[r[group]].append(r)
    for rs in by.values():
        rs.sort(key=lambda r: r[order])
        for a, r, b in zip([None, *rs], rs, [*rs[1:], None]):
            out[r[order]] = a["type"] if a and b and a["auto"] and b["auto"] and a["type"] == b["type"] else None
    return out


def flat(f):
    return f.type, f.coverage, f.overall, f.reason, f.candidate, pytest.approx(f.confidence, abs=1e-6), list(f.boosts), list(f.conflicts)


def test_query(spark, sf):
    """The registered query on whole texts of all documents."""
    rows = [r.asDict() for r in typed_documents(spark, sf).collect()]
    near = neighbours(rows, "source", "doc_id")
    want = {r["doc_id"]: judge(r, near[r["doc_id"]]) for r in rows}
    got = QUERIES["strengthened_documents"](spark, sf).collect()
    assert len(got) == len(rows)
    cut = lambda s: s.split(",") if s else []
    for r in got:
        assert (r.type, r.coverage, r.overall, r.reason, r.candidate, pytest.approx(r.confidence, abs=1e-6), cut(r.boosts), cut(r.conflicts)) == want[r.doc_id]


@pytest.mark.parametrize("parts", [1, 9])
def test_odd_rows(spark, parts):
    """Nulls everywhere, one group over many parts, all reasons; an empty table."""
    rng = random.Random(7)
    types = ["A", "B", "TYPE_UNCLEAR", "CUBIC_QUARTIC_EQ"]
    some = lambda: rng.choice([None, [], ["A"], ["B"], ["A", "B"], ["A", "B"]])
    flag = lambda: rng.choice([None, False, False, True])
    rows = [dict(k=i, g=rng.choice(["x", "x", "x", "y", None]), type=rng.choice(types), confidence=rng.choice([0.5, 0.6, 0.7, 0.75]), stem=rng.choice([None, "short", "a long enough stem", "a long enough stem", "a long enough stem", "a long stem 단, x", "a long stem (가) x"]), stem_intent=rng.choice([None, None, "A", "B", "CUBIC_QUARTIC_EQ"]), heading=rng.choice([None, None, "A", "B"]), inferred=rng.choice([None, "A", "B"]),
        agreement=rng.choice([None, {}, {"A": "SUPPORT", "B": "CONFLICT"}, {"A": "SUPPORT", "B": "SUPPORT"}, {"A": "WEAK", "CUBIC_QUARTIC_EQ": "SUPPORT"}]), strategies=some(), key_points=some(), requested=some(), review_reasons=rng.choice([None, [], [], ["UNIT_CONFLICT"], ["SUBUNIT_HEADING_RISK"]]), conditions=rng.choice([None, 0, 0, 2]), unit_auto=flag(), insufficient=rng.choice([None, False, False, False, True]), anchor=flag(), old_auto=rng.choice([None, False, False, False, False, True]), auto=rng.choice([None, True, True, True, False])) for i in range(6000)]
    names = "k int, g string, type string, confidence double, stem string, stem_intent string, heading string, inferred string, agreement map<string,string>, strategies array<string>, key_points array<string>, requested array<string>, review_reasons array<string>, conditions int, unit_auto boolean, insufficient boolean, anchor boolean, old_auto boolean, auto boolean"
    t = spark.createDataFrame([tuple(r[n.split()[0]] for n in names.split(", ")) for r in rows], names).repartition(3)
    near = neighbours(rows, "g", "k")
    found = {r.k: flat(r.found) for r in strengthened_types(with_neighbours(t, ["g"], ["k"], parts=parts)).collect()}
    want = {r["k"]: judge(r, near[r["k"]]) for r in rows}
    assert all(found[k] == w for k, w in want.items()) and len(found) == len(want)
    assert {w[3] for w in want.values()} == {None, "OCR_INSUFFICIENT", "HEADING_ONLY", "NEIGHBOR_ONLY", "HEADING_CONFLICT", "NEW_TYPE_SUSPECTED", "TYPE_UNCLEAR", "MATH_STRUCTURE_AMBIGUOUS", "STRATEGY_AMBIGUOUS", "SUBUNIT_UNCERTAIN", "CONDITION_UNCLEAR", "NO_ANCHOR", "TYPE_PROFILE_INSUFFICIENT"}
    assert {w[1] for w in want.values()} == {"OLD_AUTO", "NEW_AUTO", "REVIEW"}
    assert strengthened_types(with_neighbours(t.limit(0), ["g"], ["k"])).count() == 0
