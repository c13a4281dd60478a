"""Cues, readings and gates on cases worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.functions import cues as C
from stemma.functions import rules as U
from stemma.operators import readings as R


def one(spark, value, **columns):
    """The value over one row of these strings."""
    row = spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in columns.items()])
    return row.select(value.alias("v")).first()["v"]


def test_cues(spark):
    t = F.col("t")
    assert one(spark, C.type_markers(t), t="유형 07 덧셈, 유형3 유형 126") == ["07", "03", "12"]
    for text, code in {"유형 7": "07", "27 · 3": "03", "30": None, "3 of 12": "12", "3 of 40 x": "03", "1 2 x": None, "": None, None: None}.items():
        assert one(spark, C.badge_code(t), t=text) == code, text
    for text, heading in {"a 유형 07\n덧셈과 b": "유형 07 덧셈과", "유형3": "유형 3", "유형": None, None: None}.items():
        assert one(spark, C.type_heading(t), t=text) == heading, text
    for text, index in {"12. x": "12", " 1 2 3 x": "123", "1234": None, "07": None, "012": "012", "0": None, "000": None, "x1": None, "": None, None: None}.items():
        assert one(spark, C.leading_index(t), t=text) == index, text


def checks(spark, read, truth, number="7", choices=0, maths=(), figure=False):
    got = R.reading_checks(F.col("read"), number=F.col("number"), truth=F.col("truth"), choices=F.lit(choices), maths=F.array(*map(F.lit, maths)).cast("array<string>"), figure=F.lit(figure))
    return "".join(v[0] for v in one(spark, got, read=read, truth=truth, number=number))


def test_reading_checks(spark):
    truth = "Find the sum of both\nof these numbers now\nshort"
    assert checks(spark, "7 find THE sum of  both x² ①②", truth, choices=2, maths=["$x^2$"]) == "PPPPPP"
    # one of three lines, one of four expressions, no figure, another item's words
    assert checks(spark, "8 Find the sum of both x 본이기 ①", truth + "\nand a third long line", choices=2, maths=["x", "yy", "zz", "ww"], figure=True) == "FFFFFF"
    assert checks(spark, " \n", truth) == checks(spark, None, truth) == "NNNNNN"
    assert checks(spark, "x", None, number=None) == "FPPPPP" and checks(spark, "x", "short") == "FFPPPP"
    assert checks(spark, "7 " + "a" * 200_000 + " 도형", "a" * 200_000, figure=True) == "PPPPPP"


def test_merge_and_homes(spark):
    items = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    cached = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (None, 3, "c")], "k long, at long, v string")
    assert sorted(map(tuple, R.merge_cached(items, cached, "k", ["at"], ["v"]).collect()), key=str) == [(1, "b"), (2, None), (None, None)]
    listed = spark.createDataFrame([(1, 5, "[3~9]"), (2, 5, "[1 ~ 30] [8~10]"), (3, 8, None)], "item long, number long, stem string")
    wanted = spark.createDataFrame([(5,), (5,), (8,), (10,), (20,)], "number long")
    assert {tuple(r) for r in R.number_homes(listed, wanted).collect()} == {(5, 2, 1), (8, 1, 1), (10, 0, 2), (20, 0, None)}
    assert R.number_homes(listed.limit(0), wanted).where("homes = 0 and covered_by is null").count() == 4


def test_segmentation(spark):
    found = spark.createDataFrame([("a", 1, 1), ("a", 1, 1), ("a", 1, 2), ("a", 2, 9)], "book string, page long, n long")
    truth = spark.createDataFrame([("a", 1, 1), ("a", 1, 3), ("a", 3, 4)], "book string, page long, n long")
    pages = R.segmentation_scores(found, truth, ["book", "page"], "n")
    assert {tuple(r) for r in pages.collect()} == {("a", 1, 2, 2, 1, 1, 1, 0.5, 0.5), ("a", 2, 0, 1, 0, 0, 1, 0.0, None), ("a", 3, 1, 0, 0, 1, 0, None, 0.0)}
    assert tuple(R.segmentation_totals(pages, "book").first()) == ("a", 3, 0, 3, 3, 1, 2, 2, 0.25, 0.25)


def test_gates_on_unknown_evidence(spark):
    flags = "identity_stable boundary_safe required_complete neighbour_figure shared_unresolved choices_safe owner_correct formula table_confusion sidebar detected".split()
    unknown = {n: F.lit(None).cast("boolean") for n in flags} | {n: F.lit(None).cast("string") for n in ("crop", "ownership", "box_quality")} | {"confidence": F.lit(None).cast("double")}
    assert len(one(spark, U.figure_safe(unknown), x="")["failed"]) == 11
    assert one(spark, U.figure_reason(unknown), x="") == "FIGURE_NOT_DETECTED" and one(spark, U.figure_reason(unknown | {"detected": F.lit(True)}), x="") == "OTHER"
    none = {n: F.lit(None).cast("int") for n in ("choices", "figures", "conflicts")} | {n: F.lit(None).cast("boolean") for n in ("crop_safe", "number_ok", "has_stem", "expects_choices", "expects_figure")}
    assert tuple(one(spark, U.pipeline_status(none), x="")) == ("PIPELINE_REVIEW", False, ["crop_not_safe", "stem_missing"])
    fine = none | {n: F.lit(True) for n in ("crop_safe", "number_ok", "has_stem", "expects_choices")} | {"choices": F.lit(5)}
    assert tuple(one(spark, U.pipeline_status(fine), x="")) == ("DRAFT", True, [])


def test_transitions(spark):
    from stemma.operators.workflow import transitions

    versions = spark.createDataFrame([(1, 1, "NEEDS_REVIEW"), (1, 2, "VERIFIED")], "item long, version long, review_status string")
    items = spark.createDataFrame([(1, 2, "VERIFIED", "ARCHIVED"), (2, None, None, None)], "item long, current_version long, review_status string, lifecycle string")
    kind = "item long, version long, kind string, note string, gate boolean"
    cases = {
        (1, 1, "SUBMIT", None, None): (None, "NEEDS_REVIEW", 2, "VERIFIED", "ARCHIVED"),
        (1, 2, "SUBMIT", None, None): ("VERIFIED_LOCKED", "VERIFIED", 2, "VERIFIED", "ARCHIVED"),
        (1, 1, "VERIFY", None, True): (None, "VERIFIED", 1, "VERIFIED", "ACTIVE"),
        (1, 1, "VERIFY", None, None): ("GATE", "NEEDS_REVIEW", 2, "VERIFIED", "ARCHIVED"),
        (1, 2, "REJECT", "why", None): (None, "REJECTED", 2, "REJECTED", "ARCHIVED"),
        (1, 2, "REJECT", "  ", None): ("MISSING_NOTE", "VERIFIED", 2, "VERIFIED", "ARCHIVED"),
        (1, None, "RESTORE", None, None): (None, None, 2, "VERIFIED", "DRAFT"),
        (2, None, "ARCHIVE", None, None): ("MISSING_ITEM", None, None, None, None),
        (3, 1, "SUBMIT", None, None): ("MISSING_VERSION", None, None, None, None),
        (1, 1, None, None, None): ("UNKNOWN_KIND", "NEEDS_REVIEW", 2, "VERIFIED", "ARCHIVED"),
    }
    asked = spark.createDataFrame([(*k[:3], k[3], k[4]) for k in cases], kind).withColumn("note", F.col("note"))
    got = {(r.item, r.version, r.kind, r.error): tuple(r)[3:] for r in transitions(asked, versions, items).collect()}
    assert got == {(*k[:3], v[0]): v for k, v in cases.items()}


def test_packaging_and_atoms(spark):
    t = F.col("t")
    for text, packs in {"": True, "0123": True, "# 유형 3": True, "12쪽 유형 3 x": True, "12쪽 유형 3 " + "x" * 40: True, "12쪽 유형 3\nx\n" + "x" * 40: False, "대표 문제\nx\ny": True, "대표 문제\nx\ny를 구하시오": False, "대표 문제 " + "x" * 40: True, "a\n대표 문제": True, "x\ny 대표 문제를 구하시오": False, "3\n행렬": True, "3\nx": False, None: None}.items():
        assert one(spark, C.packaging_only(t), t=text) is packs, text
    for text, atom in {"0094 $x^2$": True, "x" * 16: True, "x" * 17: False, "": False, "0094": False, "x를 구하시오": False, "다음 중 x": False, None: False}.items():
        assert one(spark, C.short_atom(t), t=text) is atom, text
