"""Queries over whole texts that have no SQL, against brute force."""

from __future__ import annotations

import pytest

import stemma.queries  # noqa: F401
from stemma.catalog import QUERIES


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def test_turn_cer(spark, tmp_path):
    texts = {1: ["", "é", "e", "한국어 글", "한국말 글", None, "x"], 2: ["word " * 80, "w\u00f6rd " * 81, "a b\tc"]}
    spark.createDataFrame([(c, k, "user", t) for c, ts in texts.items() for k, t in enumerate(ts)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = {}
    for c, ts in texts.items():
        bare = ["".join((t or "").split()) for t in ts]
        for k, (h, t) in enumerate(zip(bare, ["", *bare])):
            want[c, k] = distance(h, t) / len(t) if t else float(bool(h))
    found = {(r.conv_id, r.turn): r.cer for r in QUERIES["turn_cer"](spark, str(tmp_path)).collect()}
    assert found == pytest.approx(want, abs=1e-6)
    assert (2, 1) in found and found[1, 2] == 1 and found[1, 4] == 0.25


def test_token_hit_rate(spark, tmp_path):
    docs = [(1, "The cat sat"), (2, "concatenate\u3000über alles"), (3, None), (4, ""), (5, "nothing"), (6, "x" * 5000 + "über"), (7, "a b"), (None, "cat")]
    items = [(1, "cat sat on the mat " + "and so it goes on " * 5 + "alles"), (2, "über cat cat zzz"), (3, None), (4, " "), (5, "a b"), (5, "a b"), (None, "th")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = [(str(i), str(d), round(n / len(q.split()), 6)) for i, q in items for d, t in docs if q and t and (n := sum(w in t for w in q.split()))]
    found = QUERIES["token_hit_rate"](spark, str(tmp_path))
    assert sorted((str(r.item_id), str(r.doc_id), r.hit) for r in found.collect()) == sorted(want)
    assert any(0 < w[2] < 1 for w in want) and found.columns == ["item_id", "doc_id", "hit"]


def test_token_hit_rate_of_new_words(spark, monkeypatch):
    """Words that no cache holds are searched many at a time: one search for up to 256 texts, none for words that are known; also where the cache is full."""
    from stemma.operators import search

    docs = [(i, f"w{i}x a{i % 7}b cat{i}") for i in range(300)]
    t = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, "w1 cat2 b"), (2, "a3 zz x")], "item_id int, text string")
    calls = spark.sparkContext.accumulator(0)
    real = search.automaton_of

    class Counted:
        def __init__(self, found):
            self.found = found

        def texts(self, words):
            calls.add(1)
            return self.found.texts(words)

    monkeypatch.setattr(search, "automaton_of", lambda name, own: Counted(real(name, own)))
    for most in (100_000, 300):
        monkeypatch.setattr(search, "MOST_WORDS", most)
        want = sorted((i, d, round(n / 3, 6)) for i, q in ((1, "w1 cat2 b"), (2, "a3 zz x")) for d, text in docs if (n := sum(w in text for w in q.split())))
        assert sorted(map(tuple, search.partial_hits(t, items).collect())) == want
    assert 0 < calls.value <= 4
