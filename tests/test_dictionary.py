"""Rules by automaton against a plain search."""

from __future__ import annotations

import random

import pytest

from stemma.operators import dictionary as D


def test_automaton():
    rng = random.Random(0)
    for _ in range(60):
        patterns = sorted({"".join(rng.choice("ab가") for _ in range(rng.randint(1, 5))) for _ in range(12)})
        text = "".join(rng.choice("ab가c") for _ in range(80))
        want = {i: n for i, p in enumerate(patterns) if (n := sum(text.startswith(p, k) for k in range(len(text))))}
        assert D.Automaton(patterns).search(text) == want


@pytest.mark.parametrize("most", [D.AUTOMATON_BYTES, 40])
def test_first_rules(spark, most):
    """Also with rules in many blocks; nulls, empty and very long texts, ties, repeated rules and rows, clashing columns, no rules."""
    rng = random.Random(1)
    rules = [("".join(rng.choice("abAB ") for _ in range(rng.randint(1, 4))), rng.randrange(5), rng.choice(["x", "y", None]), 0.5) for _ in range(40)] + [(None, 0, "n", 1.0), ("", 0, "e", 1.0), ("zzz", None, "last", 0.1), ("zzz", None, "last", 0.1), ("é", 1, "x", 0.2), ("É", 1, "w", 0.3)]
    texts = [(i, "".join(rng.choice("abcAB ") for _ in range(rng.randrange(12)))) for i in range(60)] + [(90, None), (91, ""), (92, "c" * 300_000 + "zzz"), (93, "É"), (93, "É")]
    t = spark.createDataFrame([(*r, "old", 7) for r in texts], "k int, text string, label string, hits int").repartition(3)
    rs = spark.createDataFrame(rules, "pattern string, priority int, label string, confidence double")
    want = []
    for k, text in texts:
        low = (text or "").lower()
        found = [(p is None, p or 0, label is None, label or "", w.lower(), label) for w, p, label, _ in rules if w and w.lower() in low]
        best = min(found, key=lambda x: x[:5], default=None)
        want.append(str((k, best and best[5], best and (None if best[0] else best[1]), best and best[4], len({f[4] for f in found}))))
    got = D.first_rules(t, rs, most=most)
    assert sorted(str((r.k, r.label, r.priority, r.pattern and r.pattern.lower(), r.hits)) for r in got.collect()) == sorted(want)
    assert D.first_rules(t, rs.limit(0)).where("label IS NOT NULL OR hits > 0").count() == 0 and D.first_rules(t.limit(0), rs).count() == 0
    assert "Exchange" not in D.first_rules(t.sparkSession.range(3).selectExpr("id AS k", "'a' AS text"), rs)._jdf.queryExecution().executedPlan().toString()


def test_dictionary_grows(spark):
    types = spark.createDataFrame([("t", ["b", "a"]), ("u", [])], "type string, aliases array<string>")
    heads = spark.createDataFrame([("a", "t", "1", 9), ("c", "t", "1", 3), ("c", "t", "1", 3), (None, "t", "1", 1), ("q", "no", "7", 5), ("r", None, None, None)] + [("c", "t", "1", i) for i in range(20, 40)], "title string, type string, code string, example int")
    found = {r.type: (list(r.aliases), list(r.examples)) for r in D.grown_dictionary(types, heads).collect()}
    assert found == {"t": (["b", "a", "c"], [1, 3, 9, 20, 21]), "u": ([], []), "REVIEW_7": (["q"], [5]), "REVIEW_": (["r"], [])}


def test_many_texts_at_once(monkeypatch):
    """Texts met many at a time and in steps: nothing is found across texts or lost at a step's edge, and one pass holds rules that took many."""
    rng = random.Random(2)
    patterns = sorted({"".join(rng.choice("ab가") for _ in range(rng.randint(1, 20))) for _ in range(300)})
    texts = ["".join(rng.choice("ab가c") for _ in range(rng.randrange(60))) for _ in range(80)] + ["", patterns[7] * 9]
    for step in (1 << 18, 64):
        monkeypatch.setattr(D, "STEP_BYTES", step)
        found = {i: set(n.tolist()) for i, n in D.Automaton(patterns).texts(texts)}
        assert found == {i: want for i, t in enumerate(texts) if (want := {k for k, p in enumerate(patterns) if p in t})}
    assert not list(D.Automaton([]).texts(["a", ""])) and D.AUTOMATON_BYTES >= 4 << 20
