"""Plain versions of the operators, over lists of (id, text)."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import xxhash


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def contamination(docs, items, width=10):
    """(n_words, n_hit, item ids) of each document, by comparing every window with every place."""
    windows = {}
    for key, text in items:
        w = bench_words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(str(key))
    out = []
    for _, text in docs:
        w = bench_words(text)
        hit, found = [False] * len(w), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    found |= own
                    hit[i : i + n] = [True] * n
        out.append((len(w), sum(hit), sorted(found)))
    return out


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def substring(docs, width=20):
    """(n_words, kept words) of each document."""
    first, out = {}, []
    words = [plain_words(t) for _, t in docs]
    for (key, _), w in zip(docs, words):
        for s in range(len(w) - width + 1):
            k, at = tuple(w[s : s + width]), (key is not None, key, s)
            first[k] = min(first.get(k, at), at)
    for (key, _), w in zip(docs, words):
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < (key is not None, key, s):
                gone[s : s + width] = [True] * width
        out.append((len(w), [x for x, g in zip(w, gone) if not g]))
    return out


def simhash(text, words=3, seed=42):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    k = min(words, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), seed) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n, links):
    """Class of each of n numbers: the smallest reachable."""
    up = list(range(n))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def near_copies(fps, radius=2):
    v = np.array(fps, np.uint64)
    return groups(len(v), [(i, int(j)) for i in range(len(v)) for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= radius)])


def similar_texts(texts, words=5, least=0.8):
    """Class of each text under links of shingle sets with that Jaccard similarity."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        k = min(words, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else {()})
    return groups(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])])


def vector_links(vectors, cosine=0.9):
    """(links of each, class of each); None for vectors that cannot be compared."""
    good = [i for i, v in enumerate(vectors) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    pairs = []
    for a in good:
        for b in good:
            if a < b and len(vectors[a]) == len(vectors[b]):
                x, y = (np.array(vectors[i], float) for i in (a, b))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    pairs.append((a, b))
    n = [0] * len(vectors)
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    return n, groups(len(vectors), pairs)


def token_ids(texts, end):
    from tokenizers import Tokenizer

    from stemma.llm.tokens import vocabulary

    encode = Tokenizer.from_file(vocabulary()).encode
    return [[*encode(t or "", add_special_tokens=False).ids, end] for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def repaired(rows):
    """(blank, duplicate, truncated, illegal, cost, audit, lines) of one conversation's (role, text) by trying every script with up to two insertions at a place."""
    faults, seen = [], set()
    for role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None

    def go(i, cost, labels, lines):
        nonlocal best
        put = [[]]
        for _ in range(2):
            put += [x + [r] for x in put for r in ("user", "assistant") if len(x) == max(map(len, put))]
        for x in put:
            c, a, o = cost + 3 * len(x), labels + "I" * len(x), lines + [(r, "") for r in x]
            if i == len(rows):
                if re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in o)) and (best is None or (c, a) < best[:2]):
                    best = c, a, [f"{r}:{t}" for r, t in o]
                continue
            role, text = rows[i]
            go(i + 1, c + 4, a + "D", o)
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                go(i + 1, c + more, a + "K", o + [(role, text)])
                for r in ("user", "assistant"):
                    go(i + 1, c + more + 3, a + "R", o + [(r, text)])

    go(0, 0, "", [])
    illegal = sum((a[:1] + b[:1]) not in ("su", "ua", "au") for (a, _), (b, _) in zip(rows, rows[1:]))
    return (*(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, *best)


def variants(counts, share=10):
    """word: (form, root, n_near, form's n) by comparing every two words."""

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = {}, {}
    for w, n in counts.items():
        own = [v for v in counts if v != w and near(v, w)]
        best = min(own, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= share * n else None
        out[w] = len(own)
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = form[w], root, out[w], counts.get(form[w])
    return out
