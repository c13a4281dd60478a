"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrow import ALNUM, LOWER, column, covered, gram_hashes, loads, padded, row_of, slices, text_buffer, word_hashes, words
from ._tables import bounded_batches, stored

#: Words that one search cursor walks over.
STRIDE = 256
#: Bytes of items that are sent to the tasks whole; larger benchmarks are met by a join.
BLOCK_BYTES = 8 << 20
#: Bits of a shift table's slots, and of the sketch of window hashes, at most: 4 MB for each length of windows, and 16 MB.
SHIFT_BITS, SKETCH_BITS = 22, 27


class ShiftTable:
    """Where windows of m words that a pattern may equal can stand.

    A block is b consecutive words. SHIFT, hashed by block, tells how far the window may move when the block stands at
    its end: m - b + 1 where no pattern has the block, else the least distance to a pattern's end. Many cursors walk at
    once, each over STRIDE words, so every step is a numpy operation.
    """

    def __init__(self, m: int, bits: int):
        self.m, self.b, self.bits = m, min(m, 3), np.uint64(64 - bits)
        self.shift = np.full(1 << bits, m - self.b + 1, np.uint8 if m < 256 else np.int64)

    def slots(self, h: np.ndarray, start: np.ndarray):
        """The slots of the patterns' blocks, by their distance to the end; patterns start at some of the words hashed in h."""
        blocks = gram_hashes(h, self.b) >> self.bits
        for j in range(self.m - self.b + 1):
            yield self.m - self.b - j, blocks[start + j]

    def add(self, h: np.ndarray, start: np.ndarray) -> None:
        for far, slot in self.slots(h, start):
            np.minimum.at(self.shift, slot, far)

    def walk(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Starts of all windows within single texts at whose end the shift is 0."""
        m, b = self.m, self.b
        if len(h) < m:
            return np.empty(0, np.int64)
        block = gram_hashes(h, b)
        # a cursor for each STRIDE words of each text; `at` is the window's end
        room = np.diff(first) - m + 1
        many = np.where(room > 0, -(-room // STRIDE), 0)
        text = np.repeat(np.arange(len(many)), many)
        k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        at = first[text] + k * STRIDE + m - 1
        stop = np.minimum(at + STRIDE, first[text + 1])
        hits = [np.empty(0, np.int64)]
        while len(at):
            step = self.shift[block[at - b + 1] >> self.bits]
            zero = step == 0
            if zero.any():
                hits.append(at[zero] - m + 1)
            at = at + np.maximum(step, 1)
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        return np.concatenate(hits)


class Words:
    """The words of many texts, lower-cased, in one buffer."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.buf = padded(LOWER[data])
        self.s, self.e, self.first = words(self.buf[: len(data)], off, ALNUM)
        self.h = word_hashes(self.buf, self.s, self.e)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and text of each text's windows: every `width` words, or all words of a shorter text."""
        n = np.diff(self.first)
        many = np.where(n > 0, np.maximum(1, n - width + 1), 0)
        text = np.repeat(np.arange(len(n)), many)
        start = self.first[text] + np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        return start, np.minimum(n, width)[text], text

    def keys(self, start: np.ndarray, m: np.ndarray) -> list[bytes]:
        """The words of windows, joined by a space."""
        raw, s, e = self.buf.tobytes(), self.s.tolist(), self.e.tolist()
        return [b" ".join([raw[s[i] : e[i]] for i in range(a, a + k)]) for a, k in zip(start.tolist(), m.tolist(), strict=True)]


def same_words(x: Words, a: np.ndarray, y: Words, b: np.ndarray) -> np.ndarray:
    """Whether words a of x equal words b of y, byte by byte (eight at once)."""
    size = x.e[a] - x.s[a]
    same = size == y.e[b] - y.s[b]
    at, c = np.flatnonzero(same), 0
    while len(at):
        n = np.minimum(size[at] - c, 8)
        ok = loads(x.buf, x.s[a[at]] + c, n) == loads(y.buf, y.s[b[at]] + c, n)
        same[at[~ok]] = False
        c += 8
        at = at[ok & (size[at] > c)]
    return same


class WuManber:
    """Search for windows of one length, many at once, of the words of items (kept once, as one buffer).

    Where the shift is 0 the window's hash picks a bucket (the patterns with that hash), and the words of its
    patterns are compared byte by byte.
    """

    def __init__(self, of: Words, start: np.ndarray, m: int):
        self.of, self.m = of, m
        self.table = ShiftTable(m, min(SHIFT_BITS, max(10, int(16 * len(start) * m).bit_length())))
        self.table.add(of.h, start)
        key = gram_hashes(of.h, m)[start]
        #: places of `start` in the order of their hashes
        self.order = np.argsort(key, kind="stable")
        self.keys, self.start = key[self.order], start[self.order]
        # windows that equal the first of their bucket are found with it
        head = np.searchsorted(self.keys, self.keys, "left")
        like = np.ones(len(start), bool)
        for j in range(m):
            like &= same_words(of, self.start + j, of, self.start[head] + j)
        self.one = np.where(like, head, np.arange(len(start)))
        self.tried = np.flatnonzero(self.one == np.arange(len(start)))
        self.tried_keys = self.keys[self.tried]

    def find(self, text: Words) -> tuple[np.ndarray, np.ndarray]:
        """Starts (as word numbers) of all occurrences within single texts, and which distinct pattern each is (as in `one`)."""
        start = self.table.walk(text.h, text.first)
        if not len(start):
            return start, start
        whole = gram_hashes(text.h, self.m)[start]
        lo, hi = np.searchsorted(self.tried_keys, whole, "left"), np.searchsorted(self.tried_keys, whole, "right")
        n = hi - lo
        start = np.repeat(start, n)
        which = self.tried[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        ok = np.ones(len(start), bool)
        for j in range(self.m):
            some = np.flatnonzero(ok)
            ok[some] = same_words(text, start[some] + j, self.of, self.start[which[some]] + j)
        return start[ok], which[ok]


class Matcher:
    """All windows of a block of items, by their length."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        off = np.concatenate([[0], np.cumsum([len(t) for _, t in items])]).astype(np.int64)
        of = Words(np.frombuffer(b"".join(t for _, t in items), np.uint8), off)
        start, size, item = of.windows(width)
        self.groups = []
        for m in np.unique(size).tolist():
            own = np.flatnonzero(size == m)
            one = WuManber(of, start[own], m)
            # distinct pattern -> the items that have it
            order = np.argsort(one.one, kind="stable")
            names = item[own][one.order][order]
            self.groups.append((one, one.one[order], names))
        self.names = [k for k, _ in items]

    def search(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
        """Which words are hit, each text's first word, and the items found in each text."""
        text = Words(data, off)
        starts, ends, items = [], [], [set() for _ in range(len(off) - 1)]
        for one, pattern, names in self.groups:
            at, k = one.find(text)
            starts.append(at)
            ends.append(at + one.m)
            for r, p in set(zip((np.searchsorted(text.first, at, "right") - 1).tolist(), k.tolist(), strict=True)):
                items[r].update(self.names[i] for i in names[np.searchsorted(pattern, p, "left") : np.searchsorted(pattern, p, "right")].tolist())
        at = np.concatenate(starts) if starts else np.empty(0, np.int64)
        hit = covered(text.first, at, (np.concatenate(ends) if ends else at) - at) if len(at) else np.zeros(len(text.s), bool)
        return hit, text.first, items


#: The matcher that this worker process built last, by its broadcast.
_last: dict[str, Matcher] = {}


def _matcher(key: str, items: list[tuple[str, bytes]], width: int) -> Matcher:
    if key not in _last:
        _last.clear()
        _last[key] = Matcher(items, width)
    return _last[key]


def find_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", width: int = 10, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """Words of documents that lie in any occurrence of a window of the benchmark's items.

    Words are maximal runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII. A window is `width`
    consecutive words of an item, or all words of a shorter item. Returns id_col, the columns in `keep`, n_words,
    n_hit, items (sorted ids of the items with a window in the text, as strings) for each row of docs. Null or empty texts have no
    words; items without words have no windows; a null item id counts as the id ''; repeated items add nothing;
    repeated rows and null ids of docs each get their row; an empty table on either side gives no hits.

    A benchmark of at most block_bytes is sent to the tasks whole: one scan of the documents, no shuffle. A larger one stays distributed:
    its shift tables and a sketch of its windows' hashes (of fixed greatest size) go to the tasks, whose one scan gives the places
    where a window may stand, with its words; these meet the benchmark's windows in a join. Texts are never shuffled.
    """
    bounded_batches(docs.sparkSession)
    keep = keep or []
    base = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)])
    items = _items(benchmark, item_id_col, item_text_col)
    front = [base.schema["__id"], *(base.schema[f"__k{i}"] for i in range(len(keep)))]
    if _bytes_of(items) > block_bytes:
        return _found_by_join(base, items, width, front).select(F.col("__id").alias(id_col), *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "n_words", "n_hit", "items")
    # at most block_bytes of text
    block = [(r.i, r.t.encode()) for r in items.collect()]
    sent, key = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex
    out = T.StructType([*front, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))])

    def run(batches):
        matcher = _matcher(key, sent.value, width)
        for batch in batches:
            data, off = text_buffer(column(batch, "__text"))
            n_words, n_hit, items = [], [], []
            for lo, hi in slices(off):
                hit, first, found = matcher.search(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                total = np.concatenate([[0], np.cumsum(hit)])
                n_words.append(np.diff(first))
                n_hit.append(np.diff(total[first]))
                items += [sorted(x) for x in found]
            cols = [column(batch, f.name) for f in front]
            cols += [pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()) for x in (n_words, n_hit)]
            yield pa.record_batch([*cols, pa.array(items, pa.list_(pa.string()))], names=out.names)

    return base.mapInArrow(run, out).select(F.col("__id").alias(id_col), *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "n_words", "n_hit", "items")


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")


def _bytes_of(items: DataFrame) -> int:
    return items.agg(F.sum(F.octet_length("t") + F.octet_length("i"))).first()[0] or 0


def _patterns(items: DataFrame, width: int) -> DataFrame:
    """(m, key, item): the windows of all items, each once; key: its words."""

    def run(batches):
        for batch in batches:
            data, off = text_buffer(column(batch, "t"))
            for lo, hi in slices(off):
                of = Words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                start, m, item = of.windows(width)
                for a in range(0, len(start), 20_000):
                    some = slice(a, a + 20_000)
                    yield pa.record_batch([pa.array(m[some].astype(np.int32)), pa.array(of.keys(start[some], m[some]), pa.binary()), column(batch, "i").take(pa.array(item[some] + lo))], names=["m", "key", "item"])

    return items.mapInArrow(run, "m int, key binary, item string").distinct()


def _tables(patterns: DataFrame, n: int) -> tuple[list[ShiftTable], np.ndarray, int]:
    """Shift tables of all lengths and a sketch of window hashes; what reaches the driver is bounded by their size."""
    shift_bits, bits = min(SHIFT_BITS, max(10, int(160 * n).bit_length())), min(SKETCH_BITS, max(10, int(16 * n).bit_length()))

    def run(batches):
        tables: dict[int, ShiftTable] = {}
        sketch = np.zeros(1 << bits - 5, np.uint32)
        for batch in batches:
            data, off = text_buffer(column(batch, "key"))
            of, size = Words(data, off), column(batch, "m").to_numpy()
            for m in np.unique(size).tolist():
                start = of.first[:-1][size == m]
                tables.setdefault(m, ShiftTable(m, shift_bits)).add(of.h, start)
                at = (gram_hashes(of.h, m)[start] >> np.uint64(64 - bits)).astype(np.int64)
                np.bitwise_or.at(sketch, at >> 5, np.uint32(1) << (at & 31).astype(np.uint32))
        yield from rows(0, np.flatnonzero(sketch), sketch)
        for m, t in tables.items():
            yield from rows(m, np.flatnonzero(t.shift < m - t.b + 1), t.shift)

    def rows(m, at, values):
        for lo in range(0, len(at), 100_000):
            some = at[lo : lo + 100_000]
            yield pa.record_batch([pa.array(np.full(len(some), m, np.int32)), pa.array(some.astype(np.int32)), pa.array(values[some].astype(np.int64))], names=["m", "slot", "v"])

    def pack(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([x.to_numpy().astype(t).tobytes()], pa.binary()) for x, t in zip(batch.columns, ("<i4", "<i4", "<i8"), strict=True)], names=["m", "slot", "v"])

    joined = patterns.mapInArrow(run, "m int, slot int, v long").groupBy("m", "slot").agg(F.when(F.col("m") == 0, F.bit_or("v")).otherwise(F.min("v")).alias("v"))
    tables, sketch = {}, np.zeros(1 << bits - 5, np.uint32)
    for r in joined.select("m", "slot", "v").mapInArrow(pack, "m binary, slot binary, v binary").toLocalIterator():
        m, slot, v = np.frombuffer(r.m, "<i4"), np.frombuffer(r.slot, "<i4"), np.frombuffer(r.v, "<i8")
        for k in np.unique(m).tolist():
            own = m == k
            if k == 0:
                sketch[slot[own]] = v[own]
            else:
                tables.setdefault(k, ShiftTable(k, shift_bits)).shift[slot[own]] = v[own]
    return list(tables.values()), sketch, bits


def _hits(base: DataFrame, items: DataFrame, width: int, front: list[T.StructField]) -> tuple[DataFrame, DataFrame]:
    """The scan's rows (front, digest, n_words) and, of each (id, digest) with any, its occurrences: spans and items."""
    patterns = stored(_patterns(items, width), "patterns")
    n = patterns.count()
    tables, sketch, bits = _tables(patterns, n)
    sent = base.sparkSession.sparkContext.broadcast((tables, sketch))
    base = base.withColumn("__digest", F.xxhash64("__text"))
    kept = [*front, base.schema["__digest"]]
    place = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("m", T.IntegerType()), T.StructField("key", T.BinaryType())])
    out = T.StructType([*kept, T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(place))])
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("m", pa.int32()), ("key", pa.binary())]))

    def run(batches):
        tables, sketch = sent.value
        for batch in batches:
            data, off = text_buffer(column(batch, "__text"))
            n_words, places = [], []
            for lo, hi in slices(off):
                text = Words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                n_words.append(np.diff(text.first))
                own = [[] for _ in range(hi - lo)]
                row = row_of(text.first)
                for t in tables:
                    start = t.walk(text.h, text.first)
                    if len(start):
                        at = (gram_hashes(text.h, t.m)[start] >> np.uint64(64 - bits)).astype(np.int64)
                        start = start[(sketch[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1)).astype(bool)]
                    if len(start):
                        for r, a, key in zip(row[start].tolist(), (start - text.first[row[start]]).tolist(), text.keys(start, np.full(len(start), t.m)), strict=True):
                            own[r].append({"start": a, "m": t.m, "key": key})
                places += own
            cols = [column(batch, f.name) for f in kept]
            yield pa.record_batch([*cols, pa.array(np.concatenate(n_words) if n_words else np.empty(0, np.int64), pa.int64()), pa.array(places, arrow)], names=out.names)

    scanned = stored(base.mapInArrow(run, out), "places")
    place = scanned.select("__id", "__digest", F.explode("places").alias("p")).select("__id", "__digest", "p.start", "p.m", "p.key").distinct()
    met = place.join(patterns, ["m", "key"])
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("start", "m")), lambda x: F.sequence(x["start"], x["start"] + x["m"] - 1))))
    found = met.groupBy("__id", "__digest").agg(F.size(covered).cast("long").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    return scanned.drop("places"), found


def _same_row(x: DataFrame, y: DataFrame) -> Column:
    return x["__id"].eqNullSafe(y["__id"]) & (x["__digest"] == y["__digest"])


def _found_by_join(base: DataFrame, items: DataFrame, width: int, front: list[T.StructField]) -> DataFrame:
    scanned, found = _hits(base, items, width, front)
    joined = scanned.join(found, _same_row(scanned, found), "left")
    return joined.select(*[scanned[f.name] for f in front], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns."""
    items = _items(benchmark, item_id_col, item_text_col)
    if _bytes_of(items) > block_bytes:
        bounded_batches(docs.sparkSession)
        base = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
        _, found = _hits(base, items, width, [base.schema["__id"]])
        return docs.join(found, docs[id_col].eqNullSafe(found["__id"]) & (F.xxhash64(docs[text_col].cast("string")) == found["__digest"]), "left_anti")
    found = find_benchmark(docs, benchmark, id_col, text_col, item_id_col, item_text_col, width, block_bytes, keep=docs.columns).where("n_hit = 0")
    last = found.toDF(*[f"c{i}" for i in range(len(found.columns))])
    return last.select(*[F.col(f"c{i + 1}").alias(c) for i, c in enumerate(docs.columns)])
