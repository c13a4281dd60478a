"""Golden cases of texts put right, completion, the index and the kernels that SQL cannot express."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.functions import repair as X
from stemma.operators import kernels as K
from stemma.operators import repair as R
from stemma.operators import search as S
from stemma.operators import sequence as Q
from stemma.operators.dedup import CLASS_ORDER, pick_decision
from stemma.sources.files import provider_layout


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_leaks(spark):
    v = one(spark, X.split_leak(F.lit("다음을 구하시오. $x^2$. 정답 : $4$ 풀이 전개한다.")))
    assert tuple(v) == (True, "다음을 구하시오. $x^2$.", "$4$ 풀이 전개한다.", "$4$ 풀이 전개한다.")
    assert one(spark, X.split_leak(F.lit("정답 및 풀이 ● 9쪽 # 0094 오른쪽 그림"))).stem == "0094 오른쪽 그림"
    assert tuple(one(spark, X.split_leak(F.lit("")))) == (False, "", None, None)
    assert one(spark, X.split_leak(F.lit(None).cast("string"))).leaked is False
    assert one(spark, X.strip_leak(F.lit("최댓값을 구하시오.\n정답 및 풀이 83쪽\n답 4"))) == "최댓값을 구하시오."
    assert one(spark, X.strip_leak(F.lit("정답 및 풀이 140쪽\n1005\n근의 개수"))) == "1005\n근의 개수"
    long = "a" * 30 + "\n정답: " + "b" * 100
    assert one(spark, X.strip_leak(F.lit(long))) == long


def test_numbers(spark):
    read = lambda t: one(spark, X.glued_number(F.lit(t).cast("string")))
    assert read("12가")[:6] == ("12", 12, "2_DIGIT", "가", True, False) and read("12+")[4] is False
    assert read("⑩")[:5] == ("⑩", 10, "CIRCLED", "", False) and read(None)[6] == "empty"
    assert read("12345")[:6] == ("1234", 1234, "4_DIGIT", "5", True, True)
    v = one(spark, X.resolve_digits(F.lit("123"), F.lit("x"), F.array().cast("array<bigint>")))
    assert v.reason == "ambiguous_glued_digits" and v.display == "123"
    assert one(spark, X.outline_title(F.lit("07"), F.lit(" Sums"), F.lit(True))) == "유형 07 Sums"
    assert one(spark, X.outline_title(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(True))) == ""
    assert tuple(one(spark, X.later_range(F.lit("a [2~3] b [5~6] c [5~6]"), F.lit(3)))) == ("[5~6]", 5, 6, "a [2~3] b", "[5~6] c [5~6]")
    assert one(spark, X.later_range(F.lit("a [2~3]"), F.lit(3))) is None
    assert tuple(one(spark, X.filter_math(F.array().cast("array<string>")))) == ([], [], [])


def test_range_restore_composes_several_prompts(spark):
    rows = [(1, 1, 1, "s", "One\n[3~3] Find a.", True, False), (1, 2, 1, "s", "Two\n[3~4] Find b.", True, False), (1, 3, 1, "s", "Three", True, False), (1, 4, 2, "s", "Four [9~9] Find", True, True), (1, 4, 2, "s", "Hidden", False, False), (1, 5, None, None, None, True, None)]
    items = spark.createDataFrame(rows, "book long, number long, page long, section string, text string, listed boolean, protected boolean")
    got = {r.number: r.text for r in R.range_restore(items, "Find").collect()}
    assert got == {1: "One", 2: "Two", 3: "[3~4] Find b.\n[3~3] Find a.\nThree", 4: "[3~4] Find b.\nFour [9~9] Find"}
    reasons = {r.number: r.reasons for r in R.range_candidates(items, "Find").collect()}
    assert reasons[1] == [] and reasons[4] == ["TARGETS", "PAGES", "SECTION", "PROTECTED"]
    assert R.range_restore(items.limit(0), "Find").count() == 0


def test_siblings(spark):
    rows = [(1, 1, "0001 a 0002 b 0077 c", False), (1, 2, "see 0001", False), (1, 3, "0003 d 0001 e", True), (2, 1, None, False)]
    items = spark.createDataFrame(rows, "book long, number long, text string, protected boolean")
    got = {(r.number, r.action): (r.text, r.from_number) for r in R.sibling_rebuilds(items).collect()}
    assert got == {(1, "TRIM"): ("0001 a\n0077 c", 1), (2, "SIBLING"): ("0002 b", 1)}


def test_provider_layout(spark):
    box = {"top_left_x": 10, "top_left_y": 20, "bottom_right_x": 60, "bottom_right_y": 300}
    page = {"dimensions": {"width": 100, "height": 200}, "blocks": [{"type": "text", "content": "a", **box}, {"type": "text"}, {"type": "image", "id": "i1", **box}], "images": [{"id": "i1", **box}, {"id": "i2", **box}]}
    rows = spark.createDataFrame([(1, json.dumps(page)), (2, json.dumps({"blocks": [box]})), (3, "no json"), (4, None)], "page long, raw string")
    got = sorted((r.kind, r.pos, r.content, round(r.x, 3), round(r.y, 3), round(r.width, 3), round(r.height, 3)) for r in provider_layout(rows).collect())
    at = (0.1, 0.1, 0.5, 0.9)
    assert [g[:2] for g in got] == [("block", 0), ("block", 1), ("image", 0), ("image", 1)] and all(g[3:] == at for g in got) and got[0][2] == "a"


def test_titles_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcd"), rng.integers(0, 9)))
    titles, names = [word() for _ in range(40)] + [None], sorted({word() for _ in range(30)})
    rows = spark.createDataFrame(list(enumerate(titles)), "id long, t string")
    dimension = spark.createDataFrame([(f"c{i:02}", n) for i, n in enumerate(names)], "code string, candidate_title string")

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    want = {}
    for i, t in enumerate(titles):
        if t is None:
            want[i] = (None, None, False)
            continue
        s = sorted((-(lcs(t, n) / max(len(t), len(n)) if t and n else 0.0), f"c{k:02}") for k, n in enumerate(names))[:2]
        best, second = -s[0][0], -s[1][0]
        want[i] = (s[0][1], round(best, 6), best >= 0.88 or (best >= 0.72 and best - second >= 0.1))
    for most in (5000, 7):
        monkeypatch.setattr(K, "MOST_CANDIDATES", most)
        got = {r.id: (r.code, r.score if r.score is None else round(r.score, 6), r.accepted) for r in K.match_titles(rows, dimension, "id", "t").collect()}
        assert got == want


@pytest.mark.parametrize("lists", [100, 4])
def test_index_recall(spark, sf, monkeypatch, lists):
    monkeypatch.setattr(S, "LEAST_PER_LIST", 5)
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    exact = {(r.query_id, r.vec_id) for r in S.top_k(e, asked, 5).collect()}
    centres = S.fit_centres(e, lists)
    indexed = S.index_vectors(e, centres)
    probes = S.measured_probes(indexed, asked, centres)
    near = {(r.query_id, r.vec_id) for r in S.search_index(indexed, asked, centres, 5, probes=probes).collect()}
    assert len(near & exact) >= 0.9 * len(exact) and len(centres) == lists and probes < lists + 1
    whole = {(r.query_id, r.vec_id) for r in S.search_index(indexed, asked, centres, 5, probes=len(centres)).collect()}
    assert whole == exact


def test_index_of_odd_vectors(spark, monkeypatch):
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", None), ("d", [0.0, 0.0]), ("e", [float("nan"), 1.0]), ("f", [None, 1.0]), ("g", [1.0])]
    v = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    asked = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    centres = S.fit_centres(v)
    indexed = S.index_vectors(v, centres)
    assert {r.vec_id for r in indexed.where("list = -1").collect()} == set("cdefg")
    for most in (20_000, 2):
        monkeypatch.setattr(S, "MOST_BROADCAST", most)
        assert {(r.query_id, r.vec_id, r["rank"]) for r in S.search_index(indexed, asked, centres, 3).collect()} == {("a", "b", 1), ("b", "a", 1)}
    none = v.limit(0)
    assert S.search_index(S.index_vectors(none, S.fit_centres(none)), asked, S.fit_centres(none)).count() == 0


def test_page_kernels(spark):
    b = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.4, 0.4), (1, 2, 0.0, 0.35, 0.4, 0.4), (2, 1, 0.0, 0.0, 0.4, 0.4)], "page long, item long, x double, y double, w double, h double")
    got = {(r.page, r.item): (r.y, r.h, r.before, r.after, r.applied) for r in K.correct_boxes(b).collect()}
    assert got[1, 2] == pytest.approx((0.404, 0.346, 0.125, 0.0, True)) and got[2, 1] == pytest.approx((0.0, 0.4, 0.0, 0.0, False))
    sheet = spark.createDataFrame([(1, i, h, f) for i, (h, f) in enumerate([(200.0, False), (100.0, False), (150.0, False), (100.0, False), (10.0, True)])], "sheet long, n long, tall double, brk boolean")
    assert [tuple(r)[4:] for r in K.paginate(sheet, "sheet", "n", "tall", force="brk").orderBy("n").collect()] == [(1, 1, 0.0), (1, 2, 0.0), (1, 2, 100.0), (2, 1, 0.0), (3, 1, 0.0)]
    truth = spark.createDataFrame([(1, 1, 7, 0.0, 0.0, 0.2, 0.2), (1, 2, 8, 0.5, 0.5, 0.2, 0.2)], "page long, t long, number long, x double, y double, w double, h double")
    found = spark.createDataFrame([(1, 1, 9, 0.0, 0.0, 0.2, 0.2), (1, 2, 7, 0.6, 0.0, 0.2, 0.2), (1, 3, 5, 0.9, 0.9, 0.1, 0.1)], "page long, p long, number long, x double, y double, w double, h double")
    # the number counts more than the place; the first prediction then fits no truth left
    assert {(r.t, r.p, r.iou) for r in K.greedy_match(truth, found).collect()} == {(1, 2, 0.0), (2, None, None), (None, 1, None), (None, 3, None)}
    labels = spark.createDataFrame([(1, i, 0.1 * i, 0.1, 0.02, 0.02) for i in range(1, 4)] + [(1, 9, 0.9, 0.9, 0.02, 0.02)], "page long, item long, x double, y double, w double, h double")
    assert [tuple(r) for r in K.cluster_labels(labels).collect()] == [(1, 1, 3, 0.1, 0.1, pytest.approx(0.22), 0.02)]
    assert [tuple(s) for s in one(spark, K.math_spans(F.lit("a $x$ b $$y$$")))] == [(2, 5), (8, 13)] and one(spark, K.strip_math(F.lit("a $x$ b"))) == "a   b"


def test_word_errors_and_decisions(spark):
    rows = spark.createDataFrame([("a b c", "a x c d"), ("", ""), ("a", None), (None, "a")], "h string, t string")
    assert [r[0] for r in rows.select(K.word_error_rate("h", "t")).collect()] == [0.5, 0.0, 1.0, 1.0]
    kinds = spark.createDataFrame([(1, CLASS_ORDER[1]), (1, CLASS_ORDER[0]), (2, "other"), (2, CLASS_ORDER[-1]), (3, "other")], "item long, kind string")
    assert {tuple(r) for r in pick_decision(kinds, "item").collect()} == {(1, CLASS_ORDER[0]), (2, CLASS_ORDER[-1]), (3, "other")}


def test_numbers_without_one_task(spark):
    rows = spark.createDataFrame([(w, i) for w in ["b", "a", None, "é", "z"] for i in (3, 1, 2)], "w string, n long")
    key = lambda r: (r.w is not None, (r.w or "").encode(), r.n)
    want = [(r.w, r.n) for r in sorted(rows.collect(), key=key)]
    got = {r.at: (r.w, r.n) for r in Q.numbered(rows, ["w", "n"], "at").collect()}
    assert [got[i] for i in range(1, 16)] == want and len(got) == 15
    assert Q.numbered(rows.limit(0), ["w", "n"], "at").count() == 0


def test_labels_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 3 == 0), f"L{i % 4}" if i % 5 else None, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(120)] + [(900, 0, None, None), (901, 0, "L1", [float("nan")] * 4), (902, None, "L1", [1.0] * 4), (903, 0, "L1", [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, label long, kind string, embedding array<double>")
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)) if np.any(a) and np.any(b) else -1.0
    want = {}
    for i, s, k, e in rows[:120]:
        if k is None:
            near = sorted((-round(cos(e, f), 12), j, m) for j, t, m, f in rows[:120] if m is not None and t == s and round(cos(e, f), 12) >= 0.5)[:3]
            if near:
                want[i] = (near[0][2], round(-near[0][0], 9), len(near))
    for part in (4096, 7):
        monkeypatch.setattr(S, "PART_ROWS", part)
        got = {r.vec_id: (r.label, round(r.similarity, 9), r.neighbours) for r in S.transfer_labels(v, F.col("kind").isNotNull(), "kind", "label", least=0.5).collect()}
        assert got == want
