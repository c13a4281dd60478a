"""Algorithms that are sequential by nature: Arrow batches for single texts, grouped pandas for pages and worksheets.

Groups are pages or worksheets, which hold few rows whatever the size of the corpus.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Candidates that are sent to all tasks at once.
MOST_CANDIDATES = 5_000


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows (Hyyro)."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def best_two(titles: pd.Series, codes: list[str], names: list[str]) -> list[tuple]:
    """(title, code, score) of each title's two best names, ties by code. Names are tried by what their lengths allow, so most are never compared."""
    order = sorted(range(len(names)), key=lambda i: codes[i])
    size = np.array([len(names[i]) for i in order], float)
    out = []
    for t in titles:
        bound = np.minimum(size, len(t)) / np.maximum(np.maximum(size, len(t)), 1)
        top: list[tuple] = []
        for j in np.argsort(-bound, kind="stable").tolist():
            if len(top) == 2 and bound[j] < -top[1][0]:
                break
            name = names[order[j]]
            top = sorted([*top, (-lcs(t, name) / max(len(t), len(name)) if t and name else 0.0, codes[order[j]])])[:2]
        out += [(t, c, abs(s)) for s, c in top]
    return out


def match_titles(rows: DataFrame, candidates: DataFrame, key: str, title: str, *, sure: float = 0.88, least: float = 0.72, margin: float = 0.1) -> DataFrame:
    """Rows with their best candidate (code, candidate_title): accepted if sure, or good enough and clearly better than the second.

    Distinct titles are compared once, in tasks that give two candidates for each; candidates of over MOST_CANDIDATES rows go to them in blocks. Null titles match nothing.
    """
    titles = rows.select(F.col(title).cast("string").alias("t")).where("t is not null").distinct()
    names = candidates.select(F.col("code").cast("string").alias("code"), F.coalesce(F.col("candidate_title").cast("string"), F.lit("")).alias("name")).where("code is not null")
    blocks = max(1, -(-names.count() // MOST_CANDIDATES))
    found = None
    for b in range(blocks):
        block = names.where(F.pmod(F.xxhash64("code"), F.lit(blocks)) == b).toArrow()
        sent = rows.sparkSession.sparkContext.broadcast((block.column("code").to_pylist(), block.column("name").to_pylist()))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame(best_two(pdf["t"], *sent.value), columns=["t", "code", "score"])

        part = titles.mapInPandas(run, "t string, code string, score double")
        found = part if found is None else found.unionByName(part)
    # at most two rows of each block
    two = found.groupBy("t").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "code"))).alias("c"))
    score = F.abs(F.col("c")[0]["s"])
    second = F.coalesce(F.abs(F.try_element_at("c", F.lit(2))["s"]), F.lit(0.0))
    fine = (score >= sure) | ((score >= least) & (score - second >= margin))
    judged = two.select(F.col("t").alias("__t"), F.col("c")[0]["code"].alias("code"), score.alias("score"), fine.alias("accepted"))
    return rows.select(key, F.col(title).cast("string").alias("__t")).join(judged, "__t", "left").select(key, "code", F.round("score", 6).alias("score"), F.coalesce("accepted", F.lit(False)).alias("accepted"))


_MATH = re.compile(r"\$\$.*?\$\$|\$(?:\\\$|[^$])+\$|\\begin\{([A-Za-z*]+)\}.*?\\end\{\1\}", re.S)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def math_spans(text: pd.Series) -> pd.Series:
    """Where mathematics stands: dollar pairs and environments, as half-open spans of code points."""
    return pd.Series([[{"start": m.start(), "end": m.end()} for m in _MATH.finditer(t)] if isinstance(t, str) else [] for t in text])


@F.pandas_udf(T.StringType())
def strip_math(text: pd.Series) -> pd.Series:
    return pd.Series([_MATH.sub(" ", t) if isinstance(t, str) else None for t in text])


@F.pandas_udf(T.IntegerType())
def next_number_at(text: pd.Series, number: pd.Series) -> pd.Series:
    """Where the padded number after this item's stands outside mathematics and not within other digits; -1 if nowhere."""

    def find(t, n):
        if not isinstance(t, str) or n is None or n != n:
            return -1
        spans = [m.span() for m in _MATH.finditer(t)]
        for m in re.finditer(rf"(?<![0-9]){int(n) + 1:04d}(?![0-9])", t):
            if not any(a <= m.start() < z for a, z in spans):
                return m.start()
        return -1

    return pd.Series([find(t, n) for t, n in zip(text, number, strict=True)], dtype="int32")


@F.pandas_udf(T.DoubleType())
def word_error_rate(found: pd.Series, truth: pd.Series) -> pd.Series:
    """Edit distance over words, by the number of true words; over none 1, or 0 if nothing was found."""

    def rate(h, t):
        h, t = (h or "").split(), (t or "").split()
        if not t:
            return float(bool(h))
        row = np.arange(len(t) + 1)
        for i, x in enumerate(h, 1):
            step = np.minimum(row[1:] + 1, row[:-1] + np.array([x != y for y in t]))
            now = [i]
            for v in step.tolist():
                now.append(min(v, now[-1] + 1))
            row = np.array(now)
        return row[-1] / len(t)

    return pd.Series([rate(h, t) for h, t in zip(found, truth, strict=True)])


@F.pandas_udf(T.LongType())
def fnv1a(text: pd.Series) -> pd.Series:
    """FNV-1a of 32 bits over UTF-16 code units."""

    def digest(t):
        h = 0x811C9DC5
        for u in np.frombuffer(t.encode("utf-16-le"), "<u2").tolist():
            h = (h ^ u) * 0x01000193 & 0xFFFFFFFF
        return h

    return pd.Series([digest(t) if isinstance(t, str) else None for t in text], dtype="Int64")


@F.pandas_udf(T.StringType())
def tree_text(tree: pd.Series) -> pd.Series:
    """Plain text of a JSON document tree ({type, text, content}): texts in order, a line end after each block."""

    def walk(node) -> Iterator[str]:
        stack = [node]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                yield n
            elif isinstance(n, dict):
                if isinstance(n.get("text"), str):
                    yield n["text"]
                if n.get("type") in ("paragraph", "heading", "listItem"):
                    stack.append("\n")
                stack.extend(reversed(n.get("content") or []))
            elif isinstance(n, list):
                stack.extend(reversed(n))

    def text(t):
        try:
            return "".join(walk(json.loads(t))).strip()
        except (TypeError, ValueError):
            return None

    return pd.Series([text(t) for t in tree])


def each_group(rows: DataFrame, key: str, order: list[str], work: Callable[[object, dict[str, list]], list[tuple]], schema: str) -> DataFrame:
    """work(key, columns) for each group in order, many groups to a batch: rows are dealt and sorted by key, so no frame is made per group."""
    names = [f.split()[0] for f in schema.split(", ")]

    def many(pdf: pd.DataFrame) -> pd.DataFrame:
        columns = {c: pdf[c].tolist() for c in pdf.columns}
        k = columns[key]
        edge = [0, *(i for i in range(1, len(k)) if k[i] != k[i - 1]), len(k)]
        out = [r for a, z in zip(edge[:-1], edge[1:], strict=True) if z > a for r in work(k[a], {c: v[a:z] for c, v in columns.items()})]
        return pd.DataFrame(out, columns=names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            k = pdf[key].to_numpy()
            cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
            held = pdf.iloc[cuts[-1] :] if len(cuts) else pdf
            if len(cuts):
                yield many(pdf.iloc[: cuts[-1]])
        if held is not None and len(held):
            yield many(held)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def _inter(a, b) -> float:
    return max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))


def _column(a, b) -> bool:
    across = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    return across / max(1e-9, min(a[2], b[2])) >= 0.6


def correct_boxes(boxes: DataFrame, page: str = "page", item: str = "item", *, gap: float = 0.004, most: float = 0.25, least_area: float = 0.45) -> DataFrame:
    """Boxes of a page that run into each other: nested ones of a column are cut into even slices, then each is moved below the one above.

    Returns page, item, y, h (corrected), overlap before and after (with any other of the page, of own area) and applied: only
    where the overlap comes below `most` and enough of the area is left; others keep their box.
    """
    kinds = {f.name: f.dataType.simpleString() for f in boxes.schema if f.name in (page, item)}

    def page_of(key, c: dict[str, list]) -> list[tuple]:
        old = [list(r) for r in zip(c["x"], c["y"], c["w"], c["h"], strict=True)]
        now = [list(b) for b in old]
        n = len(now)
        group = list(range(n))
        for i in range(n):
            for j in range(i):
                both = _inter(old[i], old[j])
                small = min(old[i][2] * old[i][3], old[j][2] * old[j][3])
                either = old[i][2] * old[i][3] + old[j][2] * old[j][3] - both
                if group[i] == i and _column(old[i], old[j]) and (both / max(1e-9, either) >= 0.45 or both / max(1e-9, small) >= 0.7):
                    group[i] = group[j]
        for g in set(group):
            own = [i for i in range(n) if group[i] == g]
            if len(own) > 1:
                top = min(old[i][1] for i in own)
                tall = (max(old[i][1] + old[i][3] for i in own) - top) / len(own)
                for k, i in enumerate(own):
                    now[i][1], now[i][3] = top + k * tall, max(1e-6, tall - gap)
        for i in range(n):
            for j in range(i):
                if _column(now[i], now[j]) and now[j][1] <= now[i][1] < now[j][1] + now[j][3]:
                    bottom = now[i][1] + now[i][3]
                    now[i][1] = min(bottom - 1e-6, now[j][1] + now[j][3] + gap)
                    now[i][3] = bottom - now[i][1]
        worst = lambda bs, i: max((_inter(bs[i], bs[j]) / max(1e-9, bs[i][2] * bs[i][3]) for j in range(n) if j != i), default=0.0)
        before, after = [worst(old, i) for i in range(n)], [worst(now, i) for i in range(n)]
        ok = [b > 0 and a < most and now[i][3] >= least_area * old[i][3] for i, (b, a) in enumerate(zip(before, after, strict=True))]
        return [(key, c[item][i], round(now[i][1] if ok[i] else old[i][1], 6), round(now[i][3] if ok[i] else old[i][3], 6), round(before[i], 6), round(after[i], 6), ok[i]) for i in range(n)]

    schema = f"{page} {kinds[page]}, {item} {kinds[item]}, y double, h double, before double, after double, applied boolean"
    return each_group(boxes.select(page, item, "x", "y", "w", "h"), page, ["y", "x", item], page_of, schema)


def paginate(items: DataFrame, sheet: str, order: str, height: str, *, page_height: float = 297.0, columns: int = 2, force: str | None = None) -> DataFrame:
    """Items of a worksheet in order, each to the shorter column, a new page when it fits in none or a break is forced. Adds page and column from 1, and top."""
    names = items.columns

    def lay(key, c: dict[str, list]) -> list[tuple]:
        page, used, rows = 1, [0.0] * columns, []
        for i, tall in enumerate(c[height]):
            if (force and c[force][i] and any(used)) or (any(used) and min(used) + tall > page_height):
                page, used = page + 1, [0.0] * columns
            k = used.index(min(used))
            rows.append((*(c[n][i] for n in names), page, k + 1, round(used[k], 6)))
            used[k] += float(tall)
        return rows

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema)
    return each_group(items, sheet, [order], lay, f"{kinds}, page_no int, column_no int, top double")


def greedy_match(truth: DataFrame, found: DataFrame, page: str = "page") -> DataFrame:
    """Truths (page, t, number, x, y, w, h) in order of t, each with the best prediction (page, p, ...) left: 2 for the number, plus IoU; accepted on the same number or an IoU of 0.3.

    Predictions no truth took come out with a null t. Pages with only one side have only misses or extras.
    """
    cols = ["number", "x", "y", "w", "h"]
    both = truth.select(page, F.lit(0).alias("side"), F.col("t").alias("k"), *cols).unionByName(found.select(page, F.lit(1).alias("side"), F.col("p").alias("k"), *cols))
    kind = truth.schema[page].dataType.simpleString()

    def match(key, c: dict[str, list]) -> list[tuple]:
        every = list(zip(c["side"], c["k"], c["number"], c["x"], c["y"], c["w"], c["h"], strict=True))
        free, rows = [r for r in every if r[0] == 1], []
        for a in (r for r in every if r[0] == 0):
            best, top = None, 0.0
            for b in free:
                i = _inter(a[3:], b[3:])
                iou = i / max(1e-12, a[5] * a[6] + b[5] * b[6] - i)
                same = a[2] == b[2]
                if (same or iou >= 0.3) and 2 * same + iou > top:
                    best, top = (b, iou), 2 * same + iou
            if best:
                free = [b for b in free if b[1] != best[0][1]]
            rows.append((key, a[1], best[0][1] if best else None, round(best[1], 6) if best else None))
        return rows + [(key, None, b[1], None) for b in free]

    found = each_group(both, page, ["k", "side"], match, f"{page} {kind}, t double, p double, iou double")
    return found.select(page, F.nanvl("t", F.lit(None).cast("double")).cast("long").alias("t"), F.nanvl("p", F.lit(None).cast("double")).cast("long").alias("p"), F.nanvl("iou", F.lit(None).cast("double")).alias("iou"))


def _sparse(text: str | None) -> bool:
    """At most ten visible characters, and no choice marks."""
    bare = re.sub(r"\s+", "", text) if isinstance(text, str) else ""
    return len(bare) <= 10 and not re.search("[①②③④⑤]", bare)


def cluster_labels(blocks: DataFrame, page: str = "page", item: str = "item", *, dx: float = 0.22, dy: float = 0.18, least: int = 3, text: str | None = None) -> DataFrame:
    """Short labels that stand close, as figures: seeds in reading order gather what is near their running box. (page, figure, n, x, y, w, h)

    text: the blocks' content; each large block of the page's body with next to none is then a figure of its own (n = 1), after the clusters.
    """
    kind = blocks.schema[page].dataType.simpleString()

    def gather(key, c: dict[str, list]) -> list[tuple]:
        left = [list(r) for r in zip(c["x"], c["y"], c["w"], c["h"], strict=True)]
        out = []
        while left:
            box, rest = list(left[0]), []
            n = 1
            for b in left[1:]:
                cx, cy = b[0] + b[2] / 2, b[1] + b[3] / 2
                mx, my = box[0] + box[2] / 2, box[1] + box[3] / 2
                if abs(cx - mx) < dx and abs(cy - my) < dy:
                    x, y = min(box[0], b[0]), min(box[1], b[1])
                    box = [x, y, max(box[0] + box[2], b[0] + b[2]) - x, max(box[1] + box[3], b[1] + b[3]) - y]
                    n += 1
                else:
                    rest.append(b)
            if n >= least:
                out.append((key, len(out) + 1, n, *(round(v, 6) for v in box)))
            left = rest
        if text:
            for x, y, w, h, t in zip(c["x"], c["y"], c["w"], c["h"], c["__text"], strict=True):
                if 0.07 < y < 0.93 and 0 <= x <= 1 and h >= 0.09 and w >= 0.12 and _sparse(t):
                    out.append((key, len(out) + 1, 1, *(round(v, 6) for v in (x, y, w, h))))
        return out

    return each_group(blocks.select(page, item, "x", "y", "w", "h", *([F.col(text).alias("__text")] if text else [])), page, ["y", "x", item], gather, f"{page} {kind}, figure int, n int, x double, y double, w double, h double")


def item_height(text: Column, choices: Column, *, chars_per_line: int = 32, line_mm: float = 6.0) -> Column:
    """Height of a printed item from its characters and choices."""
    return (F.greatest(F.lit(1), F.ceil(F.length(text) / chars_per_line)) + choices) * line_mm


def page_count(heights: list[float], page_height: float = 297.0) -> int:
    return max(1, math.ceil(sum(heights) / page_height))
