"""Conversation repair, URL filters and spelling variants against brute force, with every kind of odd row."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from stemma.llm import queries, repair, spelling, urls

from . import brute
from ..oracle import connect, same_rows

TURNS = "conv_id long, turn long, role string, text string, pos long, part string, audit int"


def odd_turns(seed=0, n=40):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(rng.randint(1, 4)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "ünder"])
            rows.append((c, rng.choice([turn, turn, turn + 2, None]), role, rng.choice(["a.", "b?", "cut", " \t\n", "", "a.", "é!\n", "x.\x85"])))
    rows += [(None, 1, "user", "hi."), (None, 2, "user", "hi."), (100, None, None, None), (101, None, None, "only text."), (102, 5, "assistant", "x."), (103, 1, "user", "u" * 300_000 + "."), (103, 9, "assistant", "a.")]
    return rows


@pytest.mark.parametrize("part", [4096, 2, 1])
def test_repair(spark, part, monkeypatch):
    """Also with conversations cut into parts of two rows and of one."""
    monkeypatch.setattr(repair, "PART", part)
    rows = odd_turns()
    t = spark.createDataFrame([(*r, 7, "x", 1) for r in rows], TURNS).repartition(3)
    report, done = repair.repair_conversations(t)
    lines = defaultdict(list)
    for r in sorted(done.collect(), key=lambda r: (r.pos, r.place)):
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    found = {r.conv_id: r for r in report.collect()}
    assert set(found) == {r[0] for r in rows}
    for key, r in found.items():
        own = sorted(((x[1] is not None, x[1] or 0, " " if x[2] is None else x[2], " " if x[3] is None else x[3]) for x in rows if x[0] == key), key=lambda x: (*x[:3], brute.sha(x[3])))
        blank, duplicate, truncated, illegal, cost, audit, want = brute.repaired([x[2:] for x in own])
        assert (r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, lines[key]) == (blank, duplicate, truncated, illegal, cost, audit, want)
        turns = [x[1] for x in own if x[0]]
        assert r.gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
    empty = repair.repair_conversations(t.limit(0))
    assert [x.count() for x in empty] == [0, 0]


def test_repair_of_one_large_conversation(spark, monkeypatch):
    """Its parts are many rows of many tasks; the path is that of the whole."""
    monkeypatch.setattr(repair, "PART", 64)
    rng = random.Random(5)
    rows = [(1, i, rng.choice(["user", "assistant", "tool"]), f"{i} {rng.choice(['a.', 'cut', ''])}") for i in range(3000)] + [(1, 3000, "user", "same.")] * 2000
    report, done = repair.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4))
    r = report.first()
    symbols = "".join("-" if i > 3000 else (s.upper() if cut else s) for i, (s, cut) in enumerate((("o" if x[2] == "tool" else x[2][0]), x[3][-1] not in ".!?") for x in rows))
    cost, labels, roles, last, _ = repair.shortest([repair.transfers(symbols)])
    assert (r.cost, r.audit, r.duplicate) == (cost, "".join(labels) + last, 1999)
    said = [x.role[0] for x in sorted(done.collect(), key=lambda x: (x.pos, x.place))]
    assert re.fullmatch("(ua)*", "".join(said))
    # texts are never in an aggregate of the plan
    assert not re.search(r"collect_list\([^)]*text", report._jdf.queryExecution().toString())


def test_labels_are_least(spark):
    """Parts of any length and one part of all rows give the same path, for every string of up to four symbols."""
    rng = random.Random(1)
    for _ in range(400):
        s = "".join(rng.choice("suaoSUAO-") for _ in range(rng.randint(1, 9)))
        cuts = sorted({0, len(s), *(rng.randrange(len(s)) for _ in range(2))})
        one, many = (repair.shortest([repair.transfers(s[a:b]) for a, b in zip(c, c[1:])]) for c in ([0, len(s)], cuts))
        assert (one[0], "".join(one[1]) + one[3], "".join(one[2])) == (many[0], "".join(many[1]) + many[3], "".join(many[2]))


def plain_verdicts(pages, rules, edges):
    def parts(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]

    def rule(url):
        h, p = parts(url)
        fits = [r for r in rules if ("." + h).endswith("." + r[0]) and p.startswith(r[1])]
        return max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)

    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out = []
    for key, url in pages:
        own, verdict = rule(url), None
        if own:
            verdict = own[2]
        elif url:
            seen, todo = {url}, [url]
            while todo:
                for x in near[todo.pop()] - seen:
                    seen.add(x)
                    todo.append(x)
            there = {r[2] for u in seen if (r := rule(u))}
            verdict = "allow" if "allow" in there or not there else "block"
        out.append((key, *parts(url), own[0] + own[1] if own else None, verdict or "allow"))
    return out


@pytest.mark.parametrize("small", [urls.SMALL_RULES, 0])
def test_urls(spark, small, monkeypatch):
    """Redirects and canonical links; rules broadcast and joined."""
    monkeypatch.setattr(urls.longest_rules, "__defaults__", (small,))
    rules = [("bad.example.org", "/", "block"), ("example.org", "/ok/", "allow"), ("com", "/", "block"), ("good.com", "/", "allow"), ("x.net", "", "block"), ("nothing", "/", "block")]
    link = '<html><head><LINK href="{0}" rel=canonical></head>'.format
    pages = [
        (1, "http://a.net/1", link("http://bad.example.org/p")), (2, "https://bad.example.org/p", None), (2, "https://bad.example.org/p", None), (3, "http://www.a.net/1/", ""),
        (4, "http://b.net/2", '<meta http-equiv="refresh" content="0; URL=http://q.com/z">'), (5, "http://q.com/z#top", ""), (6, "http://c.net/3", ""), (7, "http://good.com/a", ""), (8, "http://Sub.Good.COM?x", ""),
        (9, None, "x"), (None, "no scheme", ""), (10, "http://", None), (11, "x.net://x.net", ""), (12, "http://" + "a." * 3000 + "x.net/" + "y" * 100_000, ""), (13, "http://bad.example.org/ok/1", ""), (14, "ftp://d.net/q?utm_source=1&b=2#f", ""), (15, "https://d.net/q?b=2", ""),
        (16, "http://xexample.org/ok/", ""), (17, "http://c.net/3?ref=1", ""), (18, "http://m.a.net/1.html?b=2", ""),
    ]
    t = spark.createDataFrame([(*p, "host", 1) for p in pages], "page_id long, url string, html string, rule string, key int").repartition(3)
    moved = [("http://c.net/3", "http://good.com/a"), ("http://c.net/3", "https://bad.example.org/other"), (None, "http://a.net/1")]
    links = spark.createDataFrame(moved, "source string, target string")
    rule_table = spark.createDataFrame(rules, "host string, path string, verdict string")
    found = urls.judge_urls(t, rule_table, links=[links])
    assert found.columns == ["page_id", "url", "key", "host", "path", "rule", "verdict"]
    edges = [(r.source, r.target) for r in urls.page_links(t).unionByName(links).collect() if r.source]
    edges += [(b, "https" + b[b.index("://") :]) for _, b in edges]
    assert ("http://b.net/2", "http://q.com/z") in edges and ("http://a.net/1", "http://bad.example.org/p") in edges
    assert ("ftp://d.net/q?utm_source=1&b=2#f", "https://d.net/q?b=2") in edges and ("http://www.a.net/1/", "https://a.net/1") in edges
    want = plain_verdicts([p[:2] for p in pages], rules, edges)
    show = lambda rows: sorted(str((*r[:1], r[1][:40], r[2][:40], *r[3:])) for r in rows)
    assert show([(r.page_id, r.host, r.path, r.rule, r.verdict) for r in found.collect()]) == show(want)
    by = {w[0]: w for w in want}
    # passed on through a canonical link, through a refresh; an allowed alias goes before a blocked one
    assert [by[k][4] for k in (1, 3, 4, 6, 17, 18)] == ["block", "block", "block", "allow", "allow", "allow"]
    assert urls.judge_urls(t.limit(0), rule_table).count() == 0
    assert {r.verdict for r in urls.judge_urls(t, rule_table.limit(0)).collect()} == {"allow"}


def word_counts(rows, change):
    out = Counter()
    for key, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if change and h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                out[w] += 1
    return out


def odd_words(seed=0):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abÉé") for _ in range(rng.choice([6, 7, 8, 8, 9]))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "Straßen", "strassen", "strasse"]
    words += [w[:i] + rng.choice(["", "c", w[i] + "c"]) + w[i + 1 :] for w in words for i in [rng.randrange(len(w))]]
    words += [x + "b" * k for k in (63, 64, 65, 66, 90) for x in ("", "a", "c")]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 30, 300])))) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, "xyzxyzx " * 3000), (102, "xyzxyzx1xyzxyzxy-Xyzxyzxy\tXYZXYZXY"), (None, "nullnull nullnulx nullnulx"), (103, "7 . — 日本語日本語日本語")]


@pytest.mark.parametrize("held", [200_000, 5])
def test_spelling(spark, held, monkeypatch):
    """Also with tasks that send on counts early and read slices of 50 characters."""
    monkeypatch.setattr(spelling, "HELD", held)
    monkeypatch.setattr(spelling, "SLICE", 50 if held == 5 else 1 << 20)
    rows = odd_words()
    t = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, text string, n int, word string").repartition(3)
    counted = spelling.count_words(t, change=spelling.damaged)
    counts = word_counts(rows, True)
    assert {r.word: r.n for r in counted.collect()} == counts
    for share in (2, 10):
        kept = {w: n for w, n in counts.items() if n >= 2}
        found = {r.word: (r.form, r.root, r.n_near, r.form_n) for r in spelling.group_variants(counted.where("n >= 2"), share).collect()}
        assert found == brute.variants(kept, share)
    assert spelling.group_variants(counted.limit(0)).count() == 0


def test_spelling_of_long_runs(spark):
    """Two runs of 50,000 letters, one letter apart, do not travel once a letter; a chain of forms is followed to its end."""
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh") for _ in range(50_000))
    t = spark.createDataFrame([(1, f"{long} {long} {long[:400]}x{long[401:]} {long[:400]}x{long[401:]}"), (2, f"{long[1:]} {long[1:]}")], "doc_id long, text string")
    found = {r.word: r for r in spelling.group_variants(spelling.count_words(t), 2).collect()}
    assert {(len(w), r.n_near) for w, r in found.items()} == {(50_000, 2), (50_000, 1), (49_999, 1)}
    chain = spark.createDataFrame([("abcdefg" + "h" * i, 10**i) for i in range(8)], "word string, n long")
    assert {r.root for r in spelling.group_variants(chain).collect()} == {"abcdefghhhhhhh"}


def test_equal_keys_are_told_apart():
    """Rows of one key whose strings differ meet nobody."""
    names = ["key", "other", "place", "first", "rank", "word"]
    rows = [[5, 5, 2, True, 1, "abcd"], [5, 5, 2, True, 2, "abxd"], [5, 5, 2, True, 3, "zzcz"], [5, 5, -1, True, 4, "abd"], [6, 6, 0, True, 7, "q"]]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string()]
    got = spelling._groups(pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)).to_pylist()
    assert sorted((r["rank"], r["n"], r["best"]) for r in got) == [(1, 1, 2), (1, 1, 4), (2, 1, 1), (2, 1, 4), (4, 1, 1), (4, 1, 2)]


def test_long_words_are_compared_as_strings(spark):
    """Two words of 1,024 letters, unlike in every place (Thue and Morse's), whose polynomial hashes are the same modulo 2**64 for every odd base: what is near one is not near the other."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    _, place, _, key, other = spelling.deletion_keys(pa.array([one, two]))
    assert len(set(zip(key[place < 0].tolist(), other[place < 0].tolist()))) == 1
    words = [(one, 3), (two, 40), (one + "c", 2), ("c" + two[:700] + "x" + two[701:], 2), ("c" + two, 5), ("d" * 65, 7), ("d" * 66, 8), ("d" * 64, 9)]
    found = {r.word: (r.form, r.root, r.n_near, r.form_n) for r in spelling.group_variants(spark.createDataFrame(words, "word string, n long"), 2).collect()}
    assert found == brute.variants(dict(words), 2)


def test_deletion_keys():
    """The keys by cumulative sums are those of each deletion's own string."""
    words = ["abcabca", "aabbccd", "é" * 9, "z" * 100]
    row, place, first, key, other = spelling.deletion_keys(pa.array(words))
    left = [words[r] if p < 0 else words[r][:p] + words[r][p + 1 :] for r, p in zip(row, place)]
    _, p2, _, k2, o2 = spelling.deletion_keys(pa.array(left))
    assert key.tolist() == k2[p2 < 0].tolist() and other.tolist() == o2[p2 < 0].tolist()
    assert all(f == (p < 1 or words[r][p] != words[r][p - 1]) for r, p, f in zip(row, place, first))


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_url_filters", "op13_spelling_variants"])
def test_queries(spark, sf, name):
    same_rows(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLE_SQL[name])
