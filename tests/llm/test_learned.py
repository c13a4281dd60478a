"""Learned operators: held-out accuracy and odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest

from stemma.llm import _learn, langid, quality, toxicity

ODD = [(9001, None), (9002, ""), (9003, " \n"), (9004, "12 34 !!"), (9005, "x"), (9005, "x"), (None, "some text"), (9006, "word " * 200_000)]


def corpus(seed=0, n=400):
    rng = random.Random(seed)
    syll = {"aa": ["the", "ing", "on", "er", "and"], "bb": ["qu", "eau", "ré", "le", "ux"], "cc": ["sch", "ung", "ei", "ü", "der"]}
    docs, toxic, grade = [], [], []
    for i in range(n):
        lang = rng.choice(list(syll))
        w = ["".join(rng.choice(syll[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(20, 200))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["blarfoo", "zorgnak", "plimbus"]))
        g = rng.choice([0, 1, 2])
        w = [x + ("%%%" if g == 0 and rng.random() < 0.4 else "!" if g == 1 and rng.random() < 0.3 else "") for x in w]
        docs.append((i, " ".join(w), lang))
        toxic.append((i, int(bad)))
        grade.append((i, g))
    return docs, toxic, grade


@pytest.fixture(scope="module")
def data(spark):
    docs, toxic, grade = corpus()
    d = spark.createDataFrame([(*r, 0.5) for r in docs] + [(k, t, None, 0.5) for k, t in ODD], "doc_id long, text string, lang string, score double").cache()
    return d, spark.createDataFrame(toxic, "doc_id long, toxic int"), spark.createDataFrame(grade, "doc_id long, quality int"), docs, toxic, grade


def held(spark, ids):
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    return {r.doc_id for r in rows.where(_learn.held_out("doc_id")).collect()}


def test_fold(spark):
    import zlib

    assert held(spark, range(200)) == {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2}


def test_language(spark, data):
    d, _, _, docs, *_ = data
    model = langid.train(d)
    found = {r.doc_id: r for r in langid.identify(d, model, keep=["lang", "score"]).select("doc_id", "lang_pred").collect()}
    out = held(spark, [k for k, *_ in docs])
    assert np.mean([found[k].lang_pred == lang for k, _, lang in docs if k in out]) > 0.97
    for k in (9001, 9002, 9003, 9004):
        assert found[k].lang_pred == "und"
    assert langid.identify(d, model).count() == d.count()
    kept = langid.known_languages(d, model)
    found = {r.doc_id: r.score for r in langid.identify(d, model).collect()}
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {k for k, s in found.items() if s >= 0.5}
    assert all(found[k] >= 0.5 for k, *_ in docs) and all(found[k] == 0 for k in (9001, 9002, 9003, 9004))
    assert {r.lang_pred for r in langid.identify(langid.known_languages(d, model, languages=["aa"]), model).collect()} == {"aa"}
    strange = spark.createDataFrame([(1, "Привет, это русский " * 20), (2, "这是一个中文文本。" * 30), (3, "xqzj vbnk wpqx zzxq " * 20)], "doc_id long, text string")
    assert all(r.score < 0.5 and r.lang_pred != "und" for r in langid.identify(strange, model).collect())
    assert langid.identify(d.limit(0), model).count() == 0
    assert langid.train(d.limit(0)) is None and langid.identify(d, None).where("lang_pred != 'und'").count() == 0


def test_rare_language(spark):
    """One row in ten thousand is learned from, and whole texts are: the language stands at the end of a long one."""
    rows = [(i, "the ing on er and " * 8, "aa") for i in range(10_000) if i != 777] + [(777, "\n" * 6000 + "zukk vrok zukk " * 40, "zz")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(d)
    assert model.labels == ["aa", "zz"]
    asked = spark.createDataFrame([(1, "zukk vrok zukk vrok " * 10), (2, "and the on er " * 10)], "doc_id long, text string")
    assert [r.lang_pred for r in langid.identify(asked, model).orderBy("doc_id").collect()] == ["zz", "aa"]


def test_repeated_ids_learn_alike(spark):
    """Of rows with one id the smallest text is learned from, however rows are spread."""
    docs = [(i, t) for i in range(40) for t in (f"good words {i} here", f"a bad plimbus text {i}")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    grades = labels.withColumnRenamed("toxic", "quality")
    made = [(toxicity.train(d, labels), quality.train(d, grades)) for d in (spark.createDataFrame(x, "doc_id long, text string").repartition(n) for x, n in ((docs, 2), (docs[::-1], 5)))]
    assert np.array_equal(made[0][0].weights, made[1][0].weights) and np.array_equal(made[0][1].weights, made[1][1].weights)
    none = made[0][0]
    assert toxicity.score_texts(spark.createDataFrame([], "doc_id long, text string"), none).count() == 0


def test_many_grades(spark):
    docs = spark.createDataFrame([(i, "ok " * 5 + "%%% " * (i % 50)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, float(i % 50) + 0.25) for i in range(400)], "doc_id long, quality double")
    model = quality.train(docs, labels)
    assert len(model.grades) == quality.LEVELS and (np.diff(model.thresholds) > 0).all()
    found = {r.doc_id: r.expected_grade for r in quality.grade(docs, model).collect()}
    assert np.corrcoef([found[i] for i in range(400)], [i % 50 for i in range(400)])[0, 1] > 0.6


def test_toxicity(spark, data):
    d, labels, _, docs, toxic, _ = data
    model = toxicity.train(d, labels)
    found = {r.doc_id: r.score for r in toxicity.score_texts(d, model).collect()}
    out = held(spark, [k for k, *_ in docs])
    assert np.mean([(found[k] >= 0.3) == y for k, y in toxic if k in out]) > 0.95
    one = lambda t: float(model.score(toxicity.worst_strings(model, np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])))[0])
    for t in ("the z-o-r-g-n-a-k on", "the z o r g n a k on", "the ZORGNAK on", "the zorgnnak on"):
        assert one(t) > one("the eringon ander")
    assert all(0 <= s <= 1 for s in found.values()) and len(found) == d.select("doc_id").distinct().count()
    assert found[9001] == found[9002] == found[9003]
    none = toxicity.train(d, labels.limit(0))
    assert toxicity.score_texts(d, none).where("score between 0 and 1").count() == d.count()


def test_kernel_is_a_product_of_maps():
    rng = np.random.default_rng(0)
    for _ in range(20):
        x, y = (rng.integers(1, 6, rng.integers(3, 9)).astype(np.uint8) for _ in range(2))
        want = toxicity._map(x) @ toxicity._map(y)
        assert toxicity.kernel(x[None], y[None])[0] == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_quality(spark, data):
    d, _, labels, docs, _, grades = data
    model = quality.train(d, labels)
    assert (np.diff(model.thresholds) > 0).all() and list(model.grades) == [0, 1, 2]
    found = {r.doc_id: r for r in quality.grade(d, model).collect()}
    out = held(spark, [k for k, *_ in docs])
    assert np.mean([round(found[k].expected_grade) == g for k, g in grades if k in out]) > 0.9
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.p_above <= 1 for r in found.values())
    top = quality.grade(d, model, above=1).collect()
    assert all(r.p_above <= found[r.doc_id].p_above + 1e-9 for r in top)
    alone = quality.train(d, labels.where("quality = 1"))
    assert {r.expected_grade for r in quality.grade(d, alone).collect()} == {1.0}
    assert quality.grade(d.limit(0), model).count() == 0


def test_no_language_model(spark):
    """Where there is nothing to learn from, texts with letters stay."""
    d = spark.createDataFrame([(*r, None) for r in ODD], "doc_id long, text string, lang string")
    model = langid.train(d)
    kept = langid.known_languages(d, model)
    assert model is None and kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["9005", "9005", "9006", "None"]


def test_hidden_strings():
    """Insults spelt in single letters are joined within long runs too, and by characters, not bytes."""
    for text, want in (("b c " * 150 + "i d i o t " + "f g " * 150, "idiot"), ("b-c." * 150 + "i-d-i-o-t" + ".f-g" * 150, "idiot"), ("such an í d i ó t here", "ídiót"), ("바 보 야", "바보야")):
        data = np.frombuffer(text.encode(), np.uint8)
        buf, s, e, row = toxicity.strings(data, np.array([0, len(data)]))
        assert any(want.encode() in bytes(buf[a:z]) for a, z in zip(s, e)) and (e - s).max() <= toxicity.LONGEST and not row.any()


def test_sample_each(spark):
    rows = spark.range(6000).selectExpr("id as doc_id", "case when id = 5 then 'r' when id < 1000 then 'b' else 'a' end as c")
    n = {r.c: r["count"] for r in _learn.sample_each(rows, "doc_id", "c", 300).groupBy("c").count().collect()}
    assert n["r"] == 1 and 220 < n["a"] < 380 and 220 < n["b"] < 380
    assert 40 < _learn.sample_each(rows, "doc_id", "doc_id", 10).count() <= 110 and _learn.sample_each(rows.limit(0), "doc_id", "c", 10).count() == 0


def test_sample_is_bounded(spark):
    rows = spark.range(5000).withColumnRenamed("id", "doc_id")
    some = _learn.sample(rows, "doc_id", 500)
    assert 350 < some.count() <= 550 and {r[0] for r in some.collect()} == {r[0] for r in _learn.sample(rows.repartition(7), "doc_id", 500).collect()}
    assert _learn.sample(rows.limit(20), "doc_id", 500).count() == 20
