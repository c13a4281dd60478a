"""Golden cases of column builders and kernels."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stemma.functions import rules as U
from stemma.functions import text as X
from stemma.functions.geometry import Box, from_pixels
from stemma.functions.scores import cosine, mean_of
from stemma.operators import kernels as K
from stemma.operators import sequence as Q
from stemma.operators import stats as S
from stemma.plans import append_new, append_versions, identity_upsert, merge_plan


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def box(x, y, w, h):
    return Box(*(F.lit(float(v)) for v in (x, y, w, h)))


def test_boxes(spark):
    b = from_pixels(F.lit(50.0), F.lit(80.0), F.lit(400.0), F.lit(120.0), F.lit(500.0), F.lit(800.0))
    assert one(spark, F.array(b.x, b.y, b.w, b.h)) == pytest.approx([0.1, 0.1, 0.8, 0.15])
    b = from_pixels(F.lit(180.0), F.lit(220.0), F.lit(-80.0), F.lit(-40.0), F.lit(200.0), F.lit(400.0))
    assert one(spark, F.array(b.x, b.y, b.w, b.h)) == pytest.approx([0.5, 0.45, 0.4, 0.1])
    a, c = box(0, 0, 0.4, 0.4), box(0.2, 0, 0.4, 0.4)
    assert one(spark, a.iou(c)) == pytest.approx(one(spark, c.iou(a))) == pytest.approx(1 / 3)
    assert one(spark, a.coverage(box(0.1, 0.1, 0.1, 0.1))) == pytest.approx(1)
    assert not one(spark, box(0.9, 0, 0.2, 0.1).valid())


def test_numbers_and_texts(spark):
    rows = spark.createDataFrame([("12.",), (" 7 ",), ("12345",), ("a1",), (None,)], "n string")
    assert [r.c for r in rows.select(X.canonical_number(F.col("n")).alias("c")).collect()] == ["0012", "0007", None, None, None]
    assert one(spark, X.normal_text(F.lit(" a ![x](y)  b $$z$$ \n\n c "))) == "a b $z$\nc"
    assert one(spark, X.public_code(F.lit(7))) == "QB-000007" and one(spark, X.public_code(F.lit(12345678))) == "QB-12345678"
    assert [tuple(p) for p in one(spark, X.ranges(F.lit("[3~9] x [9~3] [0~2] [10 ~ 12]")))] == [(3, 9), (10, 12)]
    assert one(spark, X.char_error_rate(F.lit(""), F.lit(""))) == 0 and one(spark, X.char_error_rate(F.lit("x"), F.lit(""))) == 1
    assert one(spark, X.token_hit_rate(F.lit("abc"), F.array(F.lit("a"), F.lit(""), F.lit("z")))) == pytest.approx(1 / 3)
    assert one(spark, X.sanitise_html(F.lit("<p class=x>a<script>b</script><i>c</i><div>d</div></p>"))) == "<p>a<i>c</i>d</p>"
    with pytest.raises(Exception, match="SHA-256"):
        one(spark, X.checked_sha256(F.lit("abc")))


def test_scores(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, cosine(v(1, 0), v(1, 0))) == pytest.approx(1) and one(spark, cosine(v(0, 0), v(1, 0))) == 0 and one(spark, cosine(v(1), v(1, 0))) == 0
    assert float(one(spark, mean_of(*[F.lit(1)] * 6))) == 1.0 and float(one(spark, mean_of(*[F.lit(1)] * 5, F.lit(2)))) == 1.17


def test_verdicts(spark):
    f, t = F.lit(False), F.lit(True)
    assert one(spark, U.ocr_verdict(f, F.lit(0), F.lit(0.8), F.lit(None).cast("double"))) == "GREEN"
    assert one(spark, U.ocr_verdict(f, F.lit(0), F.lit(0.8), F.lit(0.6))) == "YELLOW"
    assert one(spark, U.ocr_verdict(t, F.lit(0), F.lit(None).cast("double"), F.lit(None).cast("double"))) == "RED"
    assert one(spark, U.crop_gate([f], [t], t)) == "REVIEW" and one(spark, U.crop_gate([t], [t], t)) == "UNSAFE" and one(spark, U.crop_gate([f], [f], f)) == "REVIEW"


def test_number_flow(spark):
    rows = spark.createDataFrame([("b", 1, i, n) for i, n in enumerate([1, 2, 2, 5, None, 4])] + [("b", 2, 9, 40), ("b", 3, 10, 3)], "book string, page int, i int, number int")
    found = {r.i: (r.status, r.why) for r in Q.number_flow(rows, "book", "page", "number", ["page", "i"]).collect()}
    assert found[2] == ("REVIEW", "DUPLICATE") and found[3] == ("SUSPICIOUS", "GAP_ON_PAGE") and found[4] == ("REVIEW", "NOT_CANONICAL")
    assert found[5] == ("REVIEW", "REVERSED") and found[9] == ("EXPECTED_BOOK_STRUCTURE", "UNIT_JUMP") and found[10] == ("EXPECTED_BOOK_STRUCTURE", "CHAPTER_RESET")


def test_stitch(spark):
    rows = spark.createDataFrame([("g", i, c) for i, c in enumerate([True, True, True, False, True, False])], "g string, i int, c boolean")
    found = [(r.takes_next, r.taken) for r in Q.stitch(rows, "g", ["i"], F.col("c")).orderBy("i").collect()]
    assert found == [(True, False), (False, True), (True, False), (False, True), (True, False), (False, True)]


def test_empty_tables(spark):
    rows = spark.createDataFrame([], "g string, x double, y double")
    assert S.spearman(rows, "g", "x", "y").count() == 0 and S.describe(rows, "g", "x").count() == 0
    assert S.confusion(rows, F.col("x") > 0, F.col("y") > 0).first().precision == 1.0


def test_kernels(spark):
    assert K.lcs("abcbdab", "bdcaba") == 4 and K.lcs("", "a") == 0
    rows = spark.createDataFrame([(1, r"a $x$ b $$y$$ \begin{m}z\end{m}"), (2, None)], "i int, t string")
    assert [len(r.s) for r in rows.select("i", K.math_spans("t").alias("s")).orderBy("i").collect()] == [3, 0]
    n = spark.createDataFrame([("0012 a $0013$ 0013 b", 12), ("0012 a 00135", 12)], "t string, n int")
    assert [r.p for r in n.select(K.next_number_at("t", "n").alias("p")).collect()] == [14, -1]
    assert one(spark, K.tree_text(F.lit('{"type":"doc","content":[{"type":"paragraph","content":[{"type":"text","text":"a"},{"text":"b"}]},{"type":"paragraph","content":[{"text":"c"}]}]}'))) == "ab\nc"
    assert one(spark, K.fnv1a(F.lit("a"))) == 0xE40C292C
    boxes = spark.createDataFrame([(1, 1, 0.1, 0.1, 0.8, 0.25), (1, 2, 0.1, 0.2, 0.8, 0.4)], "page int, item int, x double, y double, w double, h double")
    second = K.correct_boxes(boxes).where("item = 2").first()
    assert second.applied and second.y > 0.35 and second.after < 0.25


def test_plans_run_twice(spark, tmp_path):
    new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = str(tmp_path / "store")
    append_new(merge_plan(new, new.limit(0), ["k"], ["v"]), path, ["k"])
    stored = spark.read.parquet(path)
    assert stored.count() == 2 and {r.action for r in merge_plan(new, stored, ["k"], ["v"]).collect()} == {"SKIP"}
    append_new(merge_plan(new, new.limit(0), ["k"], ["v"]), path, ["k"])
    assert spark.read.parquet(path).count() == 2
    versions = spark.createDataFrame([(1, 1, "x", "BOOK", False), (2, 1, "y", "TEACHER", False)], "k int, version_no int, text string, origin string, verified boolean")
    edits = spark.createDataFrame([(1, "z"), (2, "z"), (3, "z")], "k int, new_text string")
    assert {r.k: r.action for r in append_versions(versions, edits, "k", "text").collect()} == {1: "APPEND", 2: "SKIP_TEACHER", 3: "SKIP_MISSING"}
    drafts = spark.createDataFrame([("d", 1, "7", 1, False, 1), ("d", 1, "x", 2, True, 1)], "doc string, page int, number string, problem_id int, verified boolean, created int")
    assert [(r.identity, r.action) for r in identity_upsert(drafts, drafts).collect()] == [("d|1|0007", "EXISTING_DRAFT")]


def test_search_in_blocks(spark, monkeypatch):
    from stemma.operators import search as V

    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "vec_id long, embedding array<double>")
    asked = rows.where("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    whole = sorted(map(tuple, V.top_k(rows, asked, 4).collect()))
    monkeypatch.setattr(V, "MOST_BROADCAST", 6)
    assert sorted(map(tuple, V.top_k(rows, asked, 4).collect())) == whole and len(whole) == 80


@pytest.mark.parametrize("blocked", [False, True])
def test_nearest_by_products(spark, blocked, monkeypatch):
    """Copies, zeros, nulls, other lengths, not a number, infinite and tiny vectors, equal labels and blocked pairs, in small steps: the rows of the definition, of which no task writes or joins all pairs."""
    from stemma.functions.scores import cosine
    from stemma.operators import search as V

    for name, size in (("VECTOR_ROWS", 7), ("QUERY_ROWS", 3), ("PAIR_ROWS", 10)):
        monkeypatch.setattr(V, name, size)
    odd = [[0.0, 0.0, 0.0], None, [1.0, None, 2.0], [1.0, 2.0], [], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 0.0], [1e-200, 0.0, 0.0], [1e200, 0.0, 1e200], [1e-90, 1e-90, 0.0]]
    data = [(i, [(i * 7) % 5 - 2.0, (i * 3) % 4 - 1.0, i % 3 - 1.0], i % 4 if i % 9 else None) for i in range(80)] + [(80 + i, [0.3, 0.1, 0.7], 1) for i in range(30)] + [(200 + i, v, i % 2) for i, v in enumerate(odd)]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(3)
    asked = rows.where("vec_id % 5 = 0 OR vec_id >= 200").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), F.col("label").alias("ql"))
    gone = asked.select("query_id", F.explode(F.array(*[F.col("query_id") + i for i in (1, 5, 10)])).alias("vec_id"))
    found = V.top_k(rows, asked, 4, unlike=("label", "ql"), excluded=gone if blocked else None)
    pairs = rows.join(asked, (F.col("vec_id") != F.col("query_id")) & F.coalesce(F.col("label") != F.col("ql"), F.lit(True)))
    pairs = pairs.join(gone, ["query_id", "vec_id"], "left_anti") if blocked else pairs
    ranked = pairs.select("query_id", "vec_id", cosine(F.col("embedding"), F.col("query_vec")).alias("s")).selectExpr("query_id", "vec_id", "s", "row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS n").where("n <= 4")
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, map(tuple, ranked.collect()))) and found.count() == 4 * asked.count()
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_readings_and_choices(spark):
    from stemma.functions import mathtext as M

    d = one(spark, M.reading_diff(F.lit("x^2 + 3"), F.lit("x^3 - 3")))
    assert d.worst == "CRITICAL" and d.codes == ["NUMBERS", "EXPONENTS", "OPERATORS"]
    assert one(spark, M.reading_diff(F.lit("A b"), F.lit("ac"))).worst == "COSMETIC" and one(spark, M.reading_diff(F.lit(None).cast("string"), F.lit(""))).worst == "SAME"
    assert one(spark, M.conflicts(F.lit("x^1 x^2 y^3"), F.lit("x^2 y^4"))) == ["y"] and one(spark, M.index_conflicts(F.lit("a_1"), F.lit("a_2"))) == ["a"]
    c = one(spark, M.choices(F.lit("stem\n(1) a\n2) b\nnot (3) c")))
    assert [(x.label, x.text) for x in c] == [(1, "a"), (2, "b")]
    assert one(spark, M.in_sequence(F.array(F.lit(1), F.lit(2)))) and not one(spark, M.in_sequence(F.array(F.lit(1), F.lit(3))))


def test_files(spark, tmp_path):
    import json

    from pyspark.sql import types as T

    from stemma import sources as R
    from stemma.sources.files import text_kind

    item = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])
    (tmp_path / "a.json").write_text(json.dumps({"items": [{"id": "a", "n": 1}, {"id": "b"}]}))
    assert R.read_items(spark, str(tmp_path / "a.json"), item).count() == 2
    assert R.read_manifest(spark, str(tmp_path / "a.json"), item, ["id"], 2).count() == 2
    with pytest.raises(Exception, match="required field"):
        R.read_manifest(spark, str(tmp_path / "a.json"), item, ["n"]).collect()
    with pytest.raises(ValueError, match="not 3"):
        R.read_manifest(spark, str(tmp_path / "a.json"), item, ["id"], 3)
    report = R.write_report(spark.createDataFrame([(1, "a|b")], "k int, v string"), "Title")
    assert report.splitlines()[-1] == "| 1 | a\\|b |"
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.4 text")
    (tmp_path / "y.pdf").write_bytes(b"nothing")
    files = R.binary_guard(spark.read.format("binaryFile").load([str(tmp_path / "x.pdf"), str(tmp_path / "y.pdf")]))
    assert sorted((r.ok, r.reasons) for r in files.collect()) == [(False, ["MAGIC"]), (True, [])]
    layout = json.dumps({"pageWidth": 100, "pageHeight": 200, "blocks": [{"type": "text", "content": "a", "bbox": {"x": 10, "y": 20, "width": 50, "height": 40, "unit": "px"}, "confidence": 0.9}]})
    block = R.layout_blocks(spark.createDataFrame([(1, layout), (2, None)], "page int, layout string")).collect()
    assert [(b.page, b.x, b.y, b.width, b.height) for b in block] == [(1, 0.1, 0.1, 0.5, 0.2)]
    pages = spark.createDataFrame([("d", "x" * 50), ("d", ""), ("e", None)], "doc string, text string")
    assert {r.doc: r.kind for r in text_kind(pages, "doc", "text").collect()} == {"d": "MIXED", "e": "SCAN"}


def test_sparse_blocks(spark):
    boxes = [(1, 1, 0.1, 0.2, 0.3, 0.2, " a "), (1, 2, 0.1, 0.2, 0.05, 0.2, ""), (1, 3, 0.5, 0.01, 0.3, 0.2, None), (2, 1, 0.1, 0.6, 0.12, 0.09, None), (2, 2, 0.1, 0.5, 0.3, 0.2, "a long text here"), (2, 3, 0.6, 0.5, 0.3, 0.2, "① 3")]
    blocks = spark.createDataFrame(boxes, "page int, item int, x double, y double, w double, h double, content string")
    assert sorted(tuple(r) for r in K.cluster_labels(blocks, text="content").collect()) == [(1, 1, 1, 0.1, 0.2, 0.3, 0.2), (2, 1, 1, 0.1, 0.6, 0.12, 0.09)]
    assert K.cluster_labels(blocks).count() == 0


def test_hold_out_repair(spark):
    badges = {1: "MID", 2: "LOW_BADGE", 3: "LOW_BADGE", 4: "HIGH_BADGE", 5: None, 6: "HIGH_BADGE", 7: "LOW_BADGE"}
    rows = spark.createDataFrame([(g, i, b) for g, b in badges.items() for i in (2, 1)], "g int, i int, badge string")
    held = lambda **k: {(r.g, r.i) for r in Q.hold_out(rows, ["g"], **k).where("split = 'HOLDOUT'").collect()}
    assert held() == {(5, 1), (5, 2)} and held(start=1) == {(1, 1), (1, 2), (6, 1), (6, 2)}
    assert held(start=1, badge="badge", order=["i"]) == {(1, 1), (1, 2), (6, 1), (6, 2), (2, 1)}
    assert held(start=5, badge="badge", order=["i"]) == {(5, 1), (5, 2), (2, 1), (4, 1)}


def test_each_normal_form_is_worked_out_once(spark):
    """Plans of duplicate search name each pattern of the normal form a few times, not once for each use of it."""
    from stemma.functions import text as X
    from stemma.operators import dedup as D

    rows = spark.createDataFrame([(1, "x" * 20, 1, "1")], "k long, t string, p long, n string")
    for df in (D.exact_duplicates(rows, "k", "t"), D.duplicate_pairs(rows, "k", "t", "p", "n")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace") <= 5 * 4 + 4, plan.count("regexp_replace")
    rules = [(f"r{i}", f"a{i}", f"b{i}") for i in range(8)]
    traced = rows.select(X.traced_rules(X.F.lit("a1 a5 b").alias("t"), rules).alias("t")).select("t.text", "t.fired")
    assert tuple(traced.first()) == ("b1 b5 b", ["r1", "r5"])
    plan = rows.select(X.traced_rules(X.F.col("t"), rules).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 8
