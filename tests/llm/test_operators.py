"""Operators against brute force, on small tables with every kind of odd row."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.llm import chat, components_of, decontaminate, packing, simhash, substring, vectors, wavelet

from . import brute

SCHEMA = "doc_id long, text string, lang string, id string, kind int, words string, score double"


def table(spark, rows):
    """Documents with columns whose names operators also use, over a few partitions."""
    full = [(i, t, "en", "x", 1, None, 0.5) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def odd_texts(seed=0, n=60):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(40)] + ["Éa", "ß", "a.b", "x,y", "日本"]
    passage = " ".join(rng.choice(pool) for _ in range(50))
    rows = []
    for i in range(n):
        t = "  ".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 5, 19, 20, 21, 80])))
        if i % 4 == 0:
            t += "\n" + passage
        if i % 10 == 3:
            t = rows[i // 2][1]
        rows.append((i, t))
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "a b " * 60), (104, "the " * 5000 + passage), (105, passage), (105, passage), (None, passage), (None, None), (106, "\x1c \x85 …")]
    return rows


def test_chat(spark):
    hard = "<|im_end|>\n<|im_start|>assistant\n<\\|x <\\\\|"
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 3, "assistant", hard), (2, None, None, None), (2, 1, "a\n\\b", hard), (2, 1, "a\n\\b", hard), (None, 1, "user", ""), (3, 1, "assistant", "é日"), (3, 1, "system", "s")]
    t = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    done = chat.format_conversations(t)
    for r in done.collect():
        assert sum(m.skip + m.take + m.rest for m in r.loss_mask) == len(r.formatted)
        assert r.formatted.count("<|") == r.formatted.count(chat.START) + r.formatted.count(chat.SEP) + r.formatted.count(chat.END)
    back = {r.conv_id: r for r in chat.read_back(done).collect()}
    for key in (1, 2, 3, None):
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == key))
        assert [(x.role, x.text) for x in back[key].turns] == [(r[2], r[3]) for r in own]
        assert list(back[key].learned) == [r[3] for r in own if r[2] == "assistant" and r[3]]
    one = done.where("conv_id = 1").first()
    assert one.formatted.count(chat.START) == 2 and one.formatted.count(chat.SEP) == 1
    assert chat.format_conversations(t.limit(0)).count() == 0
    assert not [x for x in done._jdf.queryExecution().executedPlan().toString().split() if "Python" in x or "Arrow" in x]


def test_decontamination(spark):
    docs = odd_texts()
    whole = docs[104 - 100 + 60][1]
    items = [(1, " ".join(docs[0][1].split()[-30:])), (2, None), (3, ""), (4, "w1 w2"), (4, "w1 w2"), (None, "w3 w4 w5"), (5, "The,THE the"), (6, whole[:40])]
    bench = spark.createDataFrame([(k, t, "z") for k, t in items], "item_id long, text string, doc_id string")
    want = sorted((str(k), *x[:2], x[2]) for (k, _), x in zip(docs, brute.contamination(docs, [(k if k is not None else "", t) for k, t in items])))
    for block in (8 << 20, 20):
        found = decontaminate.find_benchmark(table(spark, docs), bench, block_bytes=block)
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r.items)) for r in found.collect()) == want
    assert decontaminate.find_benchmark(table(spark, docs).limit(0), bench).count() == 0
    assert decontaminate.find_benchmark(table(spark, docs), bench.limit(0)).where("n_hit > 0").count() == 0
    for block in (8 << 20, 20):
        kept = decontaminate.clean(table(spark, docs), bench, block_bytes=block)
        assert kept.columns == table(spark, docs).columns and kept.count() == sum(x[2] == 0 for x in want)
        texts = sorted(str(t) for (_, t), x in zip(sorted(docs, key=lambda d: str(d[0])), sorted(want)) if x[2] == 0)
        assert len(texts) == kept.count()


def test_large_benchmark_is_joined(spark):
    """Beyond one block: one scan of the documents, texts in no shuffle."""
    docs = [(i, " ".join(f"q{(i * 7 + j) % 997}" for j in range(60))) for i in range(200)]
    items = [(i, " ".join(f"q{(i * 13 + j) % 997}" for j in range(14))) for i in range(50)] + [(99, "q1 q2"), (98, "nowhere at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(docs, items)
    t = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for block in (8 << 20, 100):
        found = decontaminate.find_benchmark(t, bench, block_bytes=block).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, list(r.items)) for r in found) == sorted((k, *x) for (k, _), x in zip(docs, want))


def test_long_words():
    """One word of 100,000 bytes among items and texts, and one that differs in its last letter."""
    import tracemalloc

    long = "語" * 33_333
    items = [("a", f"one two {long} four".encode()), ("b", " ".join(f"w{i}" for i in range(2000)).encode()), ("c", (long + "x").encode())]
    tracemalloc.start()
    matcher = decontaminate.Matcher(items, 10)
    texts = [f"so one two {long} four", f"one two {long}y four", long + "x", "w5 " + " ".join(f"w{i}" for i in range(100, 110))]
    coded = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int64)
    hit, first, found = matcher.search(np.frombuffer(b"".join(coded), np.uint8), off)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    assert found == [{"a"}, set(), {"c"}, {"b"}] and np.add.reduceat(hit, first[:-1]).tolist() == [4, 0, 1, 10]


@pytest.mark.parametrize("bits", [27, 10])
@pytest.mark.parametrize("held", [1_000_000, 50])
def test_substring(spark, bits, held, monkeypatch):
    """Also with a sketch that is nearly full, and with tasks that send on early."""
    docs = odd_texts(1)
    monkeypatch.setattr(substring, "MOST_WINDOWS", held)
    found = substring.remove_repeats(table(spark, docs), sketch_bits=bits)
    want = sorted((str(k), n, n - len(w), " ".join(w)) for (k, _), (n, w) in zip(docs, brute.substring(docs)))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in found.collect()) == want


def test_substring_text_layout(spark):
    docs = odd_texts(2)
    found = substring.remove_repeats(table(spark, docs), layout="text", keep=["lang", "id", "words"])
    rows = found.collect()
    before = {}
    for k, t in docs:
        before.setdefault(k, []).append(t)
    for r in rows:
        if r.n_removed == 0:
            assert r.kept in before[r.doc_id]
    assert found.columns == ["doc_id", "lang", "id", "words", "n_words", "n_removed", "kept"]
    assert substring.remove_repeats(table(spark, docs).limit(0)).count() == 0
    assert sorted(" ".join(brute.plain_words(r.kept)) for r in rows) == sorted(" ".join(w) for _, w in brute.substring(docs))


def test_fingerprint_log(spark, tmp_path):
    """Batches added to a log that is opened anew each time; runs are merged level by level."""
    path, seen = str(tmp_path / "log"), set()
    for part in ([1, 2, 2], [2, 3], [4], [1, 5, 3], [6]):
        log = substring.FingerprintLog(spark, path, fanout=2)
        values = spark.createDataFrame([(v, part.count(v) > 1) for v in part], "h long, again boolean")
        want = {v for v in part if v in seen or part.count(v) > 1}
        assert {r.h for r in log.append(values).collect()} == want
        seen |= set(part)
        assert len(log.runs) <= 2 and {r.h for r in log.history().collect()} == seen
    assert max(level for _, level in log.runs) == 2
    log.vacuum()
    again = substring.FingerprintLog(spark, path)
    assert again.runs == log.runs and {r.h for r in again.history().collect()} == seen
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("stemma")]
    again.drop()
    assert substring.FingerprintLog(spark, path).runs == []


def test_incremental(spark, tmp_path):
    """Batches one by one over a reopened log give the rows of one whole run."""
    docs = [(k, t) for k, t in odd_texts(5) if k is not None]
    want = sorted((str(k), n, n - len(w), " ".join(w)) for (k, _), (n, w) in zip(docs, brute.substring(docs)))
    have, path = [], str(tmp_path / "log")
    for lo, hi in ((0, 10), (10, 11), (11, 40), (40, 103), (103, 1000)):
        batch, before = (table(spark, [d for d in docs if a <= d[0] < z]) for a, z in ((lo, hi), (0, lo)))
        found = substring.remove_repeats(batch, log=substring.FingerprintLog(spark, path), history=before if lo else None)
        have += [(str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in found.collect()]
    assert sorted(have) == want
    assert any(level for _, level in substring.FingerprintLog(spark, path).runs)


def test_substring_string_ids(spark):
    docs = [(f"d{k:04d}" if k is not None else None, t) for k, t in odd_texts(7)]
    full = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id string, text string, batch int, h string").repartition(3)
    want = sorted((str(k), n, n - len(w), " ".join(w)) for (k, _), (n, w) in zip(docs, brute.substring([(k or "", t) for k, t in docs])))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(full).collect()) == want


def test_simhash(spark):
    docs = odd_texts(3)
    fps = [brute.simhash(t) for _, t in docs]
    found = simhash.near_duplicates(table(spark, docs)).collect()
    assert sorted((str(r.doc_id), r.fp & (1 << 64) - 1) for r in found) == sorted((str(k), f) for (k, _), f in zip(docs, fps))
    ids = [k if k is not None else 10**9 for k, _ in docs]
    order = sorted(range(len(docs)), key=lambda i: ids[i])
    of = brute.near_copies([fps[i] for i in order])
    want = {(str(docs[i][0]), fps[i]): ids[order[of[n]]] for n, i in enumerate(order)}
    assert all((r.component_id if r.component_id is not None else 10**9) == want[str(r.doc_id), r.fp & (1 << 64) - 1] for r in found)
    kept = simhash.deduplicate(table(spark, docs))
    assert kept.count() == len(set(of)) and kept.columns == table(spark, docs).columns
    assert simhash.near_duplicates(table(spark, docs).limit(0)).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3])
@pytest.mark.parametrize("hot", [64, 2])
@pytest.mark.parametrize("blocks", [None, 2])
def test_links(spark, radius, hot, blocks):
    """All pairs' components, with blocks that are probed, fewer and wider ones as for large tables, and blocks that are too full."""
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = set(base) | {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) for b in base[:10] for _ in range(20)} | {0, 1, 3, 7, 15, 1 << 63}
    fps = sorted(f & (1 << 64) - 1 for f in fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.link_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long"), radius, hot, blocks).collect()
    at = {f: i for i, f in enumerate(signed)}
    assert all(bin(fps[at[r.a]] ^ fps[at[r.b]]).count("1") <= radius for r in found)
    assert brute.groups(len(fps), [(at[r.a], at[r.b]) for r in found]) == brute.near_copies(fps, radius)


def test_block_count():
    assert simhash.block_count(10**6, 2) == 3 and simhash.block_count(10**9, 2) == 2 and simhash.block_count(5, 0) == 1


def near_texts(seed=0, groups=12, copies=6):
    """Groups of texts with a few words changed, and the odd rows."""
    rng = random.Random(seed)
    rows = odd_texts(seed, 20)
    for g in range(groups):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.choice([60, 150, 400]))]
        for c in range(copies):
            w = list(base)
            for _ in range(max(1, int(len(w) * rng.choice([0.005, 0.01, 0.015])))) if c else ():
                w[rng.randrange(len(w))] = f"v{rng.randrange(3000)}"
            rows.append((1000 + 20 * g + c, " ".join(w)))
    return rows


@pytest.mark.parametrize("hot", [4000, 10])
def test_similar(spark, hot, monkeypatch):
    """Components of all pairs with similar shingle sets; also where keys are compared in parts."""
    monkeypatch.setattr(simhash, "HOT_KEY", hot)
    docs = near_texts(2)
    want = brute.similar_texts([t for _, t in docs])
    found = simhash.near_duplicates(table(spark, docs), words=5, similarity=0.8).collect()
    assert len(found) == len(docs)
    unique = {k: i for i, (k, _) in enumerate(docs) if k not in (105, None)}
    have = {r.doc_id: r.component_id for r in found if r.doc_id in unique}
    groups_found, groups_want = {}, {}
    for k, i in unique.items():
        groups_found.setdefault(have[k], set()).add(k)
        groups_want.setdefault(want[i], set()).add(k)
    same = sum(g in groups_found.values() for g in groups_want.values())
    assert same >= 0.97 * len(groups_want) and len(groups_found) >= len(groups_want)
    kept = simhash.deduplicate(table(spark, docs), words=5, similarity=0.8)
    assert len(groups_want) - 2 <= kept.count() <= len(groups_want) + 3 and kept.columns == table(spark, docs).columns
    assert simhash.deduplicate(table(spark, docs).limit(0), words=5, similarity=0.8).count() == 0


def least_pairs(seed=4, pairs=150):
    """Pairs at the very least similarity, 0.8, of few shingles and of many, and passages that many unlike texts share."""
    rng = random.Random(seed)
    word = lambda: f"u{rng.randrange(10**6)}"
    rows = []
    for p in range(pairs):
        base = [word() for _ in range(8 if p % 2 else 76)]
        rows += [(2 * p, " ".join(base)), (2 * p + 1, " ".join([*base, *(word() for _ in range(1 if p % 2 else 18))]))]
    shared = [word() for _ in range(24)]
    rows += [(1000 + i, " ".join([*shared, *(word() for _ in range(rng.choice([2, 4, 8, 30])))])) for i in range(60)]
    # different in white space and case alone
    return [*rows, (2000, rows[0][1].upper().replace(" ", "\n")), (2001, "one word"), (2002, "ONE  word"), (2003, ""), (2004, None)]


@pytest.mark.parametrize("hot", [4000, 7])
def test_similar_loses_no_link(spark, hot, monkeypatch):
    """All pairs' components, also of pairs that fingerprints do not tell and where keys are compared in tiles."""
    monkeypatch.setattr(simhash, "HOT_KEY", hot)
    docs = [*least_pairs(), *((k + 10**6 if k is not None else -1, t) for k, t in near_texts(2))]
    docs = list({k: (k, t) for k, t in docs}.values())
    want = brute.similar_texts([t for _, t in docs])
    ids = {}
    for (k, _), c in zip(docs, want, strict=True):
        ids[c] = min(k, ids.get(c, k))
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(table(spark, docs), words=5, similarity=0.8).collect()}
    assert found == {k: ids[c] for (k, _), c in zip(docs, want, strict=True)}
    assert simhash.deduplicate(table(spark, docs), words=5, similarity=0.8).count() == len(ids)


def sets_of(groups, seed=5):
    """Rows for across(): sets of so many members, some of them shared by a group, of which nothing tells that they are frequent."""
    rng = np.random.default_rng(seed)
    rows = []
    for many, size, shared in groups:
        same = rng.integers(0, 2**64, shared, np.uint64)
        for _ in range(many):
            h = np.concatenate([same, rng.integers(0, 2**64, size - shared, np.uint64)])
            n = np.array([len(h)])
            rarest, _ = simhash._rarest(h, n, np.empty(0, np.uint64), 0.8)
            rows.append((len(rows), len(rows), len(h), rarest.view(np.int64).tolist(), simhash._sketches(h, n)[0].as_py()))
    return rows


@pytest.mark.parametrize("hot", [4000, 20])
def test_unlike_sets_make_no_pairs(spark, hot, monkeypatch):
    """A passage that many unlike texts share makes a row for each text and key, and no pair; long and short sets that are similar stay pairs."""
    monkeypatch.setattr(simhash, "HOT_KEY", hot)
    rows = sets_of([(60, 120, 30), (25, 4000, 800), (2, 4000, 3700), (2, 40, 37), (3, 700, 660)])
    sketches = spark.createDataFrame(rows, "n long, c long, size int, rarest array<long>, sketch binary")
    found = simhash.across(sketches, 0.8)
    assert {(r.a, r.b) for r in found.collect()} == {(85, 86), (87, 88), (89, 90), (89, 91), (90, 91)}
    apart = simhash.across(sketches.withColumn("c", F.when(F.col("n") > 88, 89).otherwise(F.col("n"))), 0.8)
    assert {(r.a, r.b) for r in apart.collect()} == {(85, 86), (87, 88)}


def test_sketches_bound_differences():
    """Sketches of any two lengths differ in no more bits than their sets in members."""
    rng = np.random.default_rng(6)
    sets = [rng.choice(2**40, n, replace=False).astype(np.uint64) for n in (1, 60, 64, 65, 500, 1025, 16384, 20000)]
    sets += [np.concatenate([s[: len(s) * 9 // 10], rng.integers(2**41, 2**42, len(s) // 20 + 1, np.uint64)]) for s in sets]
    n = np.array([len(s) for s in sets])
    made = simhash._sketches(np.concatenate(sets), n).to_pylist()
    assert max(map(len, made)) * 8 == simhash.MOST_SKETCH
    flat, edge = np.frombuffer(b"".join(made), np.uint64), np.append(0, np.cumsum([len(x) // 8 for x in made]))
    i, j = (x.ravel() for x in np.indices((len(sets), len(sets))))
    far = simhash._apart(flat, edge, i, j)
    real = np.array([len(np.setxor1d(sets[x], sets[y])) for x, y in zip(i, j)])
    assert (far <= real).all() and (far[i == j] == 0).all() and (far[real == 1] == 1).all()


def test_forest():
    rng = np.random.default_rng(3)
    for n in (1, 2, 30, 200):
        u, v, d = rng.integers(0, n, 300), rng.integers(0, n, 300), rng.integers(1, 9, 300)
        tree = simhash.forest(u, v, d, n)
        assert brute.groups(n, list(zip(u[tree], v[tree]))) == brute.groups(n, list(zip(u, v))) and len(tree) == n - len(set(brute.groups(n, list(zip(u, v)))))
        for level in range(1, 9):
            some = tree[d[tree] <= level]
            assert brute.groups(n, list(zip(u[some], v[some]))) == brute.groups(n, list(zip(u[d <= level], v[d <= level])))


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(30)] + [(200, 200 + i) for i in range(1, 60)] + [(7, 7), (300, 301), (300, 301)]
    found = {r.node: r.component for r in components_of(spark.createDataFrame(links, "a long, b long")).collect()}
    of = brute.groups(400, links)
    used = {x for a, b in links if a != b for x in (a, b)}
    assert found == {i: of[i] for i in used}
    assert components_of(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [list(map(float, v)) for v in rng.normal(size=(120, 16))]
    rows += [list(map(float, np.array(rows[i % 6]) + rng.normal(size=16) * s)) for i, s in enumerate([0.02, 0.1, 0.3, 0.45] * 30)]
    rows += [rows[0], rows[0], [2 * x for x in rows[1]], [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [None], None, [], [float("inf")] + [0.0] * 15, [1.0, 2.0], [1.0, 2.1]]
    t = spark.createDataFrame([(i, v, 1, 2) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, cid int, unit int").repartition(3)
    n, of = brute.vector_links(rows)
    found = {r.vec_id: r for r in vectors.link_vectors(t).collect()}
    assert len(found) == len(rows)
    assert all(found[i].n_links <= n[i] for i in range(len(rows)))
    assert sum(r.n_links for r in found.values()) >= 0.97 * sum(n)
    assert sum(found[i].component_id == of[i] for i in range(len(rows))) >= 0.97 * len(rows)
    assert vectors.link_vectors(t.limit(0)).count() == 0


@pytest.mark.parametrize("part", [4096, 20])
def test_dense_groups(spark, part, monkeypatch):
    """Two dense groups 22 degrees apart: all links are counted, and what is written grows with the vectors, not with their pairs."""
    monkeypatch.setattr(vectors, "PART", part)
    written = {}
    keep = vectors.stored
    monkeypatch.setattr(vectors, "stored", lambda df, what: written.setdefault(what, keep(df, what)))
    rng = np.random.default_rng(4)
    for n in (100, 200):
        written.clear()
        centre = np.zeros((2, 32))
        centre[:, 0], centre[0, 1], centre[1, 1] = 1, 0.19, -0.19
        rows = [list(map(float, c + rng.normal(size=32) * 0.02)) for c in centre for _ in range(n)]
        want, of = brute.vector_links(rows)
        t = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<double>").repartition(3)
        found = {r.vec_id: r for r in vectors.link_vectors(t).collect()}
        assert sum(r.n_links for r in found.values()) >= 0.99 * sum(want) and all(found[i].n_links <= want[i] for i in range(2 * n))
        if part == 4096:
            assert written["verified"].count() <= 20 * n


def test_diffuse_groups(spark, monkeypatch):
    """Groups whose vectors link with each other but with no centre in common: links and components are right, and rows written grow with vectors, not pairs."""
    written = []
    keep = vectors.stored

    def counting(df, what):
        out = keep(df, what)
        if what == "met":
            written.append(out.count())
        return out

    monkeypatch.setattr(vectors, "stored", counting)
    rng = np.random.default_rng(8)
    for n in (150, 300, 600):
        x = rng.normal(size=(n, 32))
        centre = np.ones(32) / np.sqrt(32)
        x -= np.outer(x @ centre, centre)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        # mutual cosines around 0.93, and some stray ones and copies
        x = np.sqrt(0.93) * centre + np.sqrt(0.07) * x
        rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(n + i, rng.normal(size=32).tolist()) for i in range(20)] + [(n + 50, x[0].tolist())]
        found = {r.vec_id: r for r in vectors.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()}
        links, classes = brute.vector_links([v for _, v in rows])
        got = [found[k].n_links for k, _ in rows]
        assert sum(got) >= 0.999 * sum(links) and all(g <= w for g, w in zip(got, links))
        assert [found[k].component_id for k, _ in rows] == [rows[c][0] for c in classes]
        assert sum(links) > n * n / 2
    # all pairs would be 11,175, 44,850 and 179,700 rows
    assert all(w < 30 * n for w, n in zip(written, (150, 300, 600))), written


def test_odd_vectors(spark):
    """Repeated and null ids, huge and tiny components."""
    a, b = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = [(1, a), (1, a), (2, [x * 1e200 for x in a]), (3, [x * 1e-200 for x in a]), (None, b), (None, [x * 1e300 for x in b]), (7, None), (4, [1e308, 1e308, -1e308])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in vectors.link_vectors(t).collect())
    assert found == sorted([("1", 3, "1"), ("1", 3, "1"), ("2", 3, "1"), ("3", 3, "1"), ("None", 1, "None"), ("None", 1, "None"), ("7", 0, "7"), ("4", 0, "4")])


def test_packing(spark):
    docs = odd_texts(4)
    ids = brute.token_ids([t for _, t in docs], 0)
    found = packing.pack_documents(table(spark, docs), capacity=64).collect()
    want = sorted((str(k), p, p * 64, len(x[p * 64 : p * 64 + 64]), brute.crc(x[p * 64 : p * 64 + 64])) for (k, _), x in zip(docs, ids) for p in range(-(-len(x) // 64)))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 64
    assert len(bins) <= 1.02 * sum(map(len, ids)) / 64 + 3
    assert packing.pack_documents(table(spark, docs).limit(0)).count() == 0


def test_sequences(spark):
    """Ids as they were packed: also of repeated, null and clashing ids, and of documents over several sequences."""
    docs = [*odd_texts(4), (1, "a"), (1, "b"), (1, "b"), (None, "c"), (2, "d"), (7, "long " * 300), (7, "long " * 299 + "end")]
    t = table(spark, docs)
    pieces = packing.pack_documents(t, capacity=64)
    placed = pieces.collect()
    made = {r.sequence_id: list(r.ids) for r in packing.sequences(t, pieces, capacity=64).collect()}
    ids = brute.token_ids([x for _, x in docs], 0)
    assert sum(map(len, made.values())) == sum(map(len, ids)) and max(map(len, made.values())) <= 64
    # every place holds a piece of a document with that id, as often as there are such documents
    found = sorted((str(r.doc_id), r.piece, tuple(made[r.sequence_id][r.offset : r.offset + r.length])) for r in placed)
    assert found == sorted((str(k), p, tuple(x[p * 64 : p * 64 + 64])) for (k, _), x in zip(docs, ids) for p in range(-(-len(x) // 64)))
    assert packing.sequences(t.limit(0), pieces.limit(0), capacity=64).count() == 0


def test_sum_of_squares():
    rng = np.random.default_rng(2)
    for sizes in (rng.integers(1, 101, 500), np.array([100] * 3 + [50] * 5), np.array([1]), np.empty(0, np.int64)):
        of, at, left = packing.sum_of_squares(sizes, 100)
        fill = np.bincount(of, sizes, len(left)) if len(sizes) else np.empty(0)
        assert (fill == 100 - left).all() and (left >= 0).all()
        assert len(left) <= sizes.sum() / 100 * 1.03 + 2


def test_wavelet_file(spark, tmp_path):
    docs = odd_texts(6)
    path = wavelet.write_tokens(table(spark, docs), str(tmp_path / "t"), shard_tokens=500)
    ids = brute.token_ids([t for _, t in docs], 2)
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0, docs[i][1] is not None, (docs[i][1] or "").encode()))
    start, want = 0, []
    for i in order:
        want.append((str(docs[i][0]), start, np.array(ids[i], "<u4").tobytes()))
        start += len(ids[i])
    for group in (1000, 2):
        found = wavelet.read_tokens(spark, path, group=group).orderBy("start").collect()
        assert [(str(r.doc_id), r.start, bytes(r.tokens)) for r in found] == want
    assert spark.read.parquet(path).count() > 5
    flat = [(docs[i][0], p, t) for i in order for p, t in enumerate(ids[i])]
    asked = [2, flat[10][2], flat[-2][2], 49_000, 70_000]
    for group in (1000, 2):
        found = wavelet.find_tokens(spark, path, asked, group=group).collect()
        assert sorted((r.token, r.place, r.position, str(r.doc_id)) for r in found) == sorted((t, n, p, str(k)) for n, (k, p, t) in enumerate(flat) if t in asked)
    assert {r.token: r.n for r in wavelet.count_tokens(spark, path, asked).collect()} == {a: sum(t == a for *_, t in flat) for a in asked}
    empty = wavelet.write_tokens(table(spark, docs).limit(0), str(tmp_path / "e"))
    assert wavelet.find_tokens(spark, empty, asked).count() == 0 and wavelet.count_tokens(spark, empty, asked).where("n > 0").count() == 0
    assert wavelet.read_tokens(spark, empty).count() == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    for x in (rng.integers(0, 49408, 3000), np.array([5]), np.array([0, 0]), np.empty(0, np.int64), rng.integers(0, 4, 1000)):
        m, sizes = wavelet.decode_shard(wavelet.encode_shard(x, np.array([len(x)])))
        assert (m.all() == x).all() and list(sizes) == [len(x)]
        at = rng.integers(0, len(x), 50) if len(x) else np.empty(0, np.int64)
        assert (m.access(at) == x[at]).all()
        for v in [*np.unique(x)[:5].tolist(), 7, 60000]:
            assert m.count(v) == (x == v).sum() and (m.occurrences(v) == np.flatnonzero(x == v)).all()
            assert m.count(v, 10, 500) == (x[10:500] == v).sum() if len(x) > 500 else True


def test_wavelet_blocks():
    """One token is read from one block a plane, and select is exact across blocks and in the last, short one."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 50_000, 3 * wavelet.BLOCK + 1001)
    m, _ = wavelet.decode_shard(wavelet.encode_shard(x, np.array([len(x)])))
    assert m.access(np.array([70_000]))[0] == x[70_000] and [len(p._open) for p in m.planes] == [1] * m.bits
    for bit in (0, 1):
        at = np.flatnonzero(m.planes[0].bits() == bit)
        assert (m.planes[0].select(bit, np.arange(len(at))) == at).all()
    assert m.planes[0].rank1(np.array([len(x)]))[0][0] == m.planes[0].bits().sum()
    for v in x[:3].tolist():
        assert (m.occurrences(v) == np.flatnonzero(x == v)).all() and m.count(v, 5, 200_000) == (x[5:200_000] == v).sum()
    whole = np.arange(wavelet.BLOCK) % 4
    m, _ = wavelet.decode_shard(wavelet.encode_shard(whole, np.array([len(whole)])))
    assert (m.all() == whole).all() and (m.occurrences(3) == np.flatnonzero(whole == 3)).all() and m.count(3) == len(whole) // 4


def test_token_ids():
    from stemma.llm._arrow import slices
    from stemma.llm.tokens import TextEncoder, vocabulary

    rng = random.Random(1)
    parts = list("aAbB éÉñßÖÿ×÷'’“.,!<|>12３\t\n \x1c\x85́H̱ΣσςİK日ﾞ가🎉") + ["<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "don't", " ", "ﬁ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000)]
    coded = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int64)
    data, encoder, found = np.frombuffer(b"".join(coded), np.uint8), TextEncoder(vocabulary()), []
    for lo, hi in slices(off, 5000):
        ids, begins = encoder.encode(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], 0)
        found += [ids[begins[i] : begins[i + 1]].tolist() for i in range(hi - lo)]
    assert found == brute.token_ids(texts, 0)


def test_long_text(spark):
    """One text of 8 MB through every operator on texts."""
    text = " ".join(f"Word{i % 5000}," for i in range(800_000))
    t = spark.createDataFrame([(1, text), (2, "short one")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(text.split()[100:130]))], "item_id long, text string")
    assert decontaminate.find_benchmark(t, bench).where("doc_id = 1").first().n_hit > 30
    assert substring.remove_repeats(t).where("doc_id = 1").first().n_removed == 800_000 - 5000
    assert simhash.near_duplicates(t).count() == 2
    assert packing.pack_documents(t).groupBy("doc_id").agg(F.sum("length").alias("n")).count() == 2
