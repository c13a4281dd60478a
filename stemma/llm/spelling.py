"""Spelling variants: words one edit apart, met by integer deletion keys from prefix and suffix hashes."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import column, mix
from ._tables import bounded_batches, stored

#: Runs of letters; only A-Z have small letters here.
LETTERS = "A-Za-zÀ-ÿ"
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Distinct words that a task holds before it sends their counts on, and characters of text read at once.
HELD, SLICE = 200_000, 1 << 20
#: What deletions leave brings its word along up to so many code points; longer words, which would travel once a letter, are sent for where keys meet.
SHORT = 64

_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _runs(text: str, least: int) -> Iterator[list[str]]:
    """Maximal runs of at least `least` letters, a slice of the text at a time; slices end between letters."""
    find, letter = re.compile(f"[{LETTERS}]{{{least},}}").findall, re.compile(f"[{LETTERS}]*")
    at = 0
    while at < len(text):
        end = letter.match(text, min(at + SLICE, len(text))).end()
        yield find(text, at, end)
        at = end


def damaged(start: int, word: str) -> str:
    """The run without the code point that its checksum names, if 31 divides it. start: crc32 of what stands before the run."""
    h = zlib.crc32(word.encode(), start)
    if h % 31:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, change: Callable[[int, str], str] | None = None) -> DataFrame:
    """(word, n): runs of letters of at least `least` code points in all texts, A-Z in small letters, and how often each occurs.

    change(crc32 of "<id>:", word) may alter each word of a document before it is counted. Null texts have no words, a null id is an empty string.
    Tasks add up what they read, so a frequent word sends one row per task and HELD words.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return made

        for b in batches:
            for key, text in zip(column(b, "id").to_pylist(), column(b, "text").to_pylist()):
                start = zlib.crc32(f"{key or ''}:".encode())
                own: Counter[str] = Counter()
                for words in _runs(text or "", least):
                    own.update(words)
                    if len(own) > HELD:
                        flush(own, start, total)
                        yield out()
                flush(own, start, total)
                if len(total) > HELD:
                    yield out()
        yield out()

    def flush(own: Counter[str], start: int, total: Counter[str]) -> None:
        for word, n in own.items():
            word = word.translate(_LOWER)
            if change:
                word = change(start, word)
            if len(word) >= least:
                total[word] += n
        own.clear()

    each = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return each.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def deletion_keys(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit keys of each word with each of its code points left out, and of the whole word.

    Returns row, place (-1: the whole word), first (no equal code point just before, so that equal deletions of a word count once), key, check. With
    h = sum(c[k] * B**k), the hash without place i is the prefix before i and the suffix after it divided by B, so all
    keys of a batch take one cumulative sum of the code points' terms, modulo 2**64, where an odd B can be divided by.
    """
    coded = [np.frombuffer(w.encode("utf-32-le"), "<u4") for w in words.to_pylist()]
    size = np.array([len(c) for c in coded], np.int64)
    flat = np.concatenate([*coded, np.empty(0, "<u4")]).astype(np.uint64) + np.uint64(1)
    row = np.repeat(np.arange(len(size)), size)
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    place = np.arange(len(flat)) - begin[row]
    first = np.ones(len(flat), bool)
    first[1:] = (flat[1:] != flat[:-1]) | (place[1:] == 0)
    keys = []
    for base in (_B1, _B2):
        power = np.ones(int(size.max(initial=0)) + 1, np.uint64)
        power[1:] = base
        power = np.multiply.accumulate(power)
        term = flat * power[place]
        ahead = np.concatenate([[np.uint64(0)], np.cumsum(term)])
        prefix = ahead[:-1] - ahead[begin[row]]
        total = ahead[begin + size] - ahead[begin]
        suffix = total[row] - prefix - term
        keys.append(mix(np.concatenate([prefix + suffix * np.uint64(pow(int(base), -1, 1 << 64)), total])))
    n = len(size)
    return np.concatenate([row, np.arange(n)]), np.concatenate([place, np.full(n, -1)]), np.concatenate([first, np.ones(n, bool)]), keys[0].view(np.int64), keys[1].view(np.int64)


_KEYS = "key long, other long, place int, first boolean, rank long, word string"


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _KEYS for the words of each batch, some thousand words at a time."""
    for b in batches:
        sizes = np.cumsum([len(w) for w in column(b, "word").to_pylist()])
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + 200_000)))
            part = b.slice(at, to - at)
            words = column(part, "word")
            row, place, first, key, other = deletion_keys(words)
            # by the length of what is left, which is the same for all rows that can meet
            left = np.array([len(w) for w in words.to_pylist()])[row] - (place >= 0)
            carried = words.take(pa.array(row, mask=left > SHORT))
            yield pa.record_batch([pa.array(key), pa.array(other), pa.array(place.astype(np.int32)), pa.array(first), column(part, "rank").take(pa.array(row)), carried], ["key", "other", "place", "first", "rank", "word"])
            at = to


def _meets(rows: pa.RecordBatch) -> pa.RecordBatch:
    """The rows that can have a near word in what they share keys with: another word with that deletion at the same place, or another word that is or leaves the same. rows: whole runs of a key."""
    key, other, place, first, rank = (column(rows, c).to_numpy(zero_copy_only=False) for c in ("key", "other", "place", "first", "rank"))
    order = np.lexsort((rank, place, other, key))
    k, o, p, f, r = key[order], other[order], place[order], first[order], rank[order]
    run = np.cumsum(np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])])[: len(k)]) - 1
    spot = np.cumsum(np.concatenate([[True], (np.diff(run) != 0) | (p[1:] != p[:-1])])[: len(k)]) - 1
    many = (np.bincount(spot)[spot] > 1) & (p >= 0) if len(k) else np.zeros(0, bool)
    whole = np.bincount(run[p < 0], minlength=len(k))[run] > 0
    shorter = np.bincount(run[(p >= 0) & f], minlength=len(k))[run] > 0
    some = many | (whole & (p >= 0) & f) | (shorter & (p < 0))
    return rows.take(pa.array(np.sort(order[some])))


def _groups(rows: pa.RecordBatch) -> pa.RecordBatch:
    """(rank, n, best) of the near words that rows meet under equal keys. rows: whole runs of a key, each with its word."""
    key, other, place, first, rank = (column(rows, c).to_numpy(zero_copy_only=False) for c in ("key", "other", "place", "first", "rank"))
    run = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (other[1:] != other[:-1]))]) if len(key) else np.empty(0, np.int64)
    # equal keys: the strings themselves decide, whatever their length
    shared = np.flatnonzero(np.bincount(run)[run] > 1) if len(key) else np.empty(0, np.int64)
    key, place, first, rank, run = run[shared], place[shared], first[shared], rank[shared], run[shared]
    code: dict = {}
    same = np.empty(len(shared), np.int64)
    for i, (word, at, of) in enumerate(zip(column(rows, "word").take(pa.array(shared)).to_pylist(), place.tolist(), run.tolist())):
        left = word if at < 0 else word[:at] + word[at + 1 :]
        same[i] = code.setdefault((of, left), len(code))
    out_rank, out_n, out_best = [], [], []

    def add(ranks, ns, bests):
        out_rank.append(ranks)
        out_n.append(ns)
        out_best.append(bests)

    # replacements: the same string is left after a deletion at the same place
    order = np.lexsort((rank, place, same))
    order = order[place[order] >= 0]
    if len(order):
        s, p, r = same[order], place[order], rank[order]
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (p[1:] != p[:-1])])
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(order)))
        group = np.cumsum(new) - 1
        met = size[group] > 1
        second = r[np.minimum(head + 1, len(r) - 1)]
        best = np.where(new, second[group], r[head][group])
        add(r[met], (size[group] - 1)[met], best[met])
    # insertions and deletions: what a deletion leaves is a word itself
    own = np.full(len(code), -1, np.int64)
    own[same[place < 0]] = rank[place < 0]
    longer = np.flatnonzero((place >= 0) & first & (own[same] >= 0))
    if len(longer):
        shorter = own[same[longer]]
        add(rank[longer], np.ones(len(longer), np.int64), shorter)
        add(shorter, np.ones(len(longer), np.int64), rank[longer])
    return pa.record_batch([pa.array(np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64)) for x in (out_rank, out_n, out_best)], ["rank", "n", "best"])


def _by_key(batches: Iterator[pa.RecordBatch], use: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """use() of whole runs of keys. Partitions are sorted by keys: runs that go on in the next batch wait for it."""
    rest = None
    for b in batches:
        if b.num_rows == 0:
            continue
        b = b if rest is None else pa.concat_batches([rest, b])
        key = column(b, "key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        rest = b.slice(cut)
        yield use(b.slice(0, cut))
    if rest is not None:
        yield use(rest)


def near_words(words: DataFrame) -> DataFrame:
    """words (rank, word; both distinct) with n_near, the words exactly one insertion, deletion or replacement away, and best, the least rank among them.

    A word meets its near words under the keys of what is left when one code point is left out: a replacement leaves the same string at
    the same place, an insertion leaves the other word. Keys are dealt by their value and sorted; each group adds up its size and its two least
    ranks, so no pair is written. Equal keys are compared as strings, of whatever length: up to SHORT code points the word comes along with each
    key; a longer one is first met by its keys alone, and joined to those of its keys under which there is another word, at most one or two for
    each near word. A group has at most one word for each letter and place, so none is large. Words without a near word have no row.
    """
    spark = words.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda rows: rows.repartition(n, "key").sortWithinPartitions("key", "other")
    keyed = words.where(F.length("word") <= SHORT + 1).select("rank", "word").mapInArrow(_keyed, _KEYS)
    long = words.where(F.length("word") > SHORT).select("rank", "word")
    alone = long.mapInArrow(_keyed, _KEYS).where("word IS NULL")
    meeting = dealt(alone).mapInArrow(lambda batches: _by_key(batches, _meets), _KEYS).drop("word").join(long, "rank").select("key", "other", "place", "first", "rank", "word")
    met = dealt(keyed.where("word IS NOT NULL").unionByName(meeting)).mapInArrow(lambda batches: _by_key(batches, _groups), "rank long, n long, best long")
    return met.groupBy("rank").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def group_variants(words: DataFrame, share: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of counted words (word, n; distinct).

    A word's form is its near word of largest n, of several the first in code-point order, if that n is at least share times the word's; else null.
    root follows forms to the last; a word without form is its own. Chains are as short as a logarithm of the largest n, so roots
    take that many joins at most, each of words with the word they point to. Null words are left out; an empty table gives no rows.
    """
    if share < 2:
        raise ValueError("forms of words as frequent as they are could point to each other: share must be 2 or more")
    spark = words.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("n").desc(), F.col("word").asc()]
    # ranks grow in this order, so the best of several words is the least rank
    ranked = stored(words.where("word IS NOT NULL").select("word", "n").repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("rank", F.monotonically_increasing_id()), "words")
    near = stored(near_words(ranked), "near")
    with_best = ranked.join(near, "rank", "left")
    other = ranked.select(F.col("rank").alias("best"), F.col("n").alias("form_n"), F.col("word").alias("form"))
    found = stored(with_best.join(other.where(f"form_n >= {int(share)}"), "best", "left").select("rank", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *(F.when(F.col("form_n") >= share * F.col("n"), F.col(c)).alias(c) for c in ("best", "form", "form_n"))), "forms")
    up = found.where("best IS NOT NULL").select("rank", F.col("best").alias("top"))
    while True:
        # each step doubles the length of chain that is followed
        above = up.select(F.col("rank").alias("top"), F.col("top").alias("further"))
        longer = stored(up.join(above, "top", "left").select("rank", F.coalesce("further", "top").alias("top"), F.col("further").isNotNull().alias("moved")), "roots")
        up = longer.select("rank", "top")
        if longer.where("moved").isEmpty():
            break
    roots = up.join(ranked.select(F.col("rank").alias("top"), F.col("word").alias("root")), "top").select("rank", "root")
    return found.join(roots, "rank", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
