"""The pipeline against its stages by brute force, and the registered queries."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from stemma.llm import registry
from stemma.llm.langid import identify

from ..oracle import connect, same_rows
from . import brute


def packed(docs):
    """Pieces that must come out, whatever their places."""
    ids = brute.token_ids([t for _, t in docs], 0)
    return sorted((k, p, p * 2048, len(x[p * 2048 : p * 2048 + 2048]), brute.crc(x[p * 2048 : p * 2048 + 2048])) for (k, _), x in zip(docs, ids) for p in range(-(-len(x) // 2048)))


def plain_pipeline(docs, scores, items):
    """The stages by brute force over (id, text), given each document's score."""
    rows = sorted((k, t) for k, t in docs if scores[k] >= 0.5)
    of = brute.similar_texts([t for _, t in rows])
    rows = [rows[i] for i in sorted(set(of))]
    rows = [(k, w) for (k, _), (n, w) in zip(rows, brute.substring(rows)) if w or not n]
    hit = brute.contamination([(k, " ".join(w)) for k, w in rows], items)
    return [(k, " ".join(w)) for (k, w), x in zip(rows, hit) if not x[1]]


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    scores = {r.doc_id: r.score for r in identify(docs, corpus_pipeline.train(docs)).collect()}
    rows = plain_pipeline([(r.doc_id, r.text) for r in docs.collect()], scores, items)
    found = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == packed(rows)
    tokens = sum(map(len, brute.token_ids([t for _, t in rows], 0)))
    assert len({r.sequence_id for r in found}) <= tokens / 2048 * 1.02 + 2


def test_pipeline_on_odd_documents(spark, sf, tmp_path):
    """Foreign, mixed, null, empty, repeated and clashing rows through all stages: fewer rows come out, and those of brute force."""
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60").collect()]
    base = [t for _, t, _ in docs if len((t or "").split()) > 60]
    near = [" ".join([*t.split()[:30], "changed", *t.split()[31:]]) for t in base[:10] if len(t.split()) > 150]
    foreign = ["Привет мир, это текст на другом языке. " * 10, "这是一个中文文本。" * 30]
    extra = [base[0], base[0].upper(), None, "", " \n", "123 456", *foreign, base[1] + " " + base[2], *near]
    docs += [(1000 + i, t, None) for i, t in enumerate(extra)]
    items = [(1, " ".join(base[3].split()[5:20])), (2, None), (3, "")]
    # names that operators use
    t = spark.createDataFrame([(k, t, lang, "s", 1, "k", 2, 0.5) for k, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars int, i string, d int, score double").repartition(3)
    t.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    scores = {r.doc_id: r.score for r in identify(t, corpus_pipeline.train(t)).collect()}
    assert all(scores[1000 + i] < 0.5 for i in range(2, 8))
    rows = plain_pipeline([(k, x) for k, x, _ in docs], scores, items)
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == packed(rows)
    assert len({r.doc_id for r in found}) < len(docs) - 8
    made = corpus_pipeline.training_sequences(spark, str(tmp_path), f"{tmp_path}/out")
    texts = dict(zip((k for k, _ in rows), brute.token_ids([x for _, x in rows], 0)))
    assert made.columns == ["sequence_id", "ids"]
    assert sorted(x for r in made.collect() for x in r.ids) == sorted(x for ids in texts.values() for x in ids)


def test_stages_on_repeated_rows(spark, sf):
    """Rows with the same id and text, or the same id and another text, through each stage by itself."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    twice = docs.unionByName(docs).unionByName(docs.limit(5).withColumn("text", docs["text"].substr(1, 200)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, twice, sf)
        assert out.columns == docs.columns and out.count() <= twice.count()
        if name == "simhash_near_dedup":
            assert out.count() == out.select("text").distinct().count()
    assert corpus_pipeline.best_fit_packing(spark, twice, sf).where("piece = 0").count() == twice.count()


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs.limit(0), sf).collect()


def test_clear_tables(spark, sf):
    """What operators store can be deleted when results are written."""
    from stemma.llm import _tables, clear_tables, simhash

    simhash.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet").limit(10)).collect()
    paths = list(_tables._made[spark.sparkContext.applicationId])
    assert spark.read.parquet(next(p for p in paths if "fingerprints" in p)).count() > 0
    clear_tables(spark)
    for p in paths[-3:]:
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            spark.read.parquet(p)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, sf, name):
    same_rows(registry.queries()[name](spark, sf), connect(sf), registry.oracle_sql()[name])


def test_op4_query(spark, sf):
    """The registered query against all pairs of fingerprints."""
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    fps = [brute.simhash(t) for _, t in docs]
    of = brute.near_copies(fps)
    found = registry.queries()["op4_simhash"](spark, sf).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in found) == [(k, f"{f:016x}", docs[c][0]) for (k, _), f, c in zip(docs, fps, of)]


def test_op9_and_op10_queries(spark, sf):
    """The registered queries against the tokenizers library, text by text."""
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    found = registry.queries()["op9_packing"](spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == packed(docs)
    places = {}
    for r in found:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        ends = [0]
        for o, n in sorted(own):
            assert o == ends[-1]
            ends.append(o + n)
        assert ends[-1] <= 2048
    want, start = [], 0
    for (k, _), x in zip(docs, brute.token_ids([t for _, t in docs], 2)):
        want.append((k, start, len(x), brute.crc(x)))
        start += len(x)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in registry.queries()["op10_token_binary"](spark, sf).collect()) == want


def test_learned_queries_on_held_out_rows(spark):
    """Floors of the registered queries' own output on rows that they did not learn from."""
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    lang = registry.queries()["op6_language_id"](spark, sf).where("held_out").join(docs, "doc_id").where("lang is not null").selectExpr("avg(cast(lang = lang_pred as int)) a", "count(*) n").first()
    assert lang.a > 0.98 and lang.n > 2000
    toxic = registry.queries()["op5_toxicity"](spark, sf).where("held_out").join(labels, "doc_id").selectExpr("avg(cast(predicted = toxic as int)) a", "sum(toxic) p", "sum(toxic * predicted) h").first()
    assert toxic.a > 0.95 and toxic.h >= 0.75 * toxic.p
    grade = registry.queries()["op7_quality"](spark, sf).where("held_out").join(labels, "doc_id").selectExpr("avg(cast(cast(selected as int) = quality as int)) a", "min(expected_grade) lo", "max(expected_grade) hi", "min(p_above) p", "max(p_above) q").first()
    assert grade.a > 0.97 and 0 <= grade.lo <= grade.hi <= 1 and 0 <= grade.p <= grade.q <= 1
