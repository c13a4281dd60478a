"""Dictionaries of rules and aliases: all patterns of a table found in one pass over each text, the first rule by priority, aliases grown by union, and profiles of types."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept

#: Bytes of patterns that one automaton holds; more rules are matched in several passes.
AUTOMATON_BYTES = 8 << 20
#: Bytes of texts that are looked at in one go, and bits of the table that tells which first bytes no pattern has.
STEP_BYTES, TABLE_BITS = 1 << 18, 20
#: Spreads first bytes over that table, and what stands between texts: no UTF-8 holds it.
SPREAD, BETWEEN = np.uint64(0x9E3779B97F4A7C15), b"\xff"


class Automaton:
    """Patterns by their first 8, 4, 2 or 1 bytes: all places of many texts are looked at in a few passes of arrays, whatever the number of patterns.

    A place whose bytes some pattern begins with is compared with these patterns byte by byte, so what is found is exact.
    """

    def __init__(self, patterns: list[str]) -> None:
        coded = [p.encode() for p in patterns]
        self.size = np.array([len(c) for c in coded], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1].astype(np.int64)
        self.bytes = np.frombuffer(b"".join(coded), np.uint8)
        self.kinds = []
        for width in (8, 4, 2, 1):
            mine = np.flatnonzero((self.size >= width) & ((self.size < 2 * width) | (width == 8)))
            if not len(mine):
                continue
            head = np.zeros(len(mine), np.uint64)
            for k in range(width):
                head |= self.bytes[self.start[mine] + k].astype(np.uint64) << np.uint64(8 * k)
            order = np.argsort(head, kind="stable")
            heads, first, count = np.unique(head[order], return_index=True, return_counts=True)
            table = np.zeros(1 << TABLE_BITS, bool)
            table[heads * SPREAD >> np.uint64(64 - TABLE_BITS)] = True
            self.kinds.append((width, mine[order], heads, first, count, table))

    def places(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where (place of the first byte) which patterns (by number) stand in bytes."""
        at, number = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for lo in range(0, len(data), STEP_BYTES):
            head, width = np.concatenate([data[lo : lo + STEP_BYTES + 7], np.zeros(7, np.uint8)]).astype(np.uint64), 1
            seen = {1: head}
            while width < max((k[0] for k in self.kinds), default=1):
                head = head[:-width] | head[width:] << np.uint64(8 * width)
                width *= 2
                seen[width] = head
            n = min(STEP_BYTES, len(data) - lo)
            for width, mine, heads, first, count, table in self.kinds:
                head = seen[width][:n]
                some = np.flatnonzero(table[head * SPREAD >> np.uint64(64 - TABLE_BITS)])
                head = head[some]
                which = np.minimum(np.searchsorted(heads, head), len(heads) - 1)
                same = heads[which] == head
                some, which = some[same] + lo, which[same]
                many = count[which]
                nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                some, found = np.repeat(some, many), mine[np.repeat(first[which], many) + nth]
                fits = some + self.size[found] <= len(data)
                some, found = some[fits], found[fits]
                size = self.size[found]
                for length in np.unique(size).tolist():
                    here = np.flatnonzero(size == length)
                    x, y = some[here], found[here]
                    for k in range(width, length):
                        ok = data[x + k] == self.bytes[self.start[y] + k]
                        x, y = x[ok], y[ok]
                    at.append(x), number.append(y)
        return np.concatenate(at), np.concatenate(number)

    def search(self, text: str) -> dict[int, int]:
        """How often each pattern that occurs does."""
        number, n = np.unique(self.places(np.frombuffer(text.encode(), np.uint8))[1], return_counts=True)
        return dict(zip(number.tolist(), n.tolist()))

    def texts(self, texts: Iterable[str]) -> Iterator[tuple[int, np.ndarray]]:
        """The numbers of the distinct patterns of each text that has any, with the text's own number; texts are looked at many at a time."""
        held, size, begin = [], 0, 0
        for i, text in enumerate(texts):
            held.append(text.encode())
            size += len(held[-1]) + 1
            if size >= STEP_BYTES:
                yield from self._rows(held, begin)
                held, size, begin = [], 0, i + 1
        yield from self._rows(held, begin)

    def _rows(self, coded: list[bytes], begin: int) -> Iterator[tuple[int, np.ndarray]]:
        at, number = self.places(np.frombuffer(BETWEEN.join(coded), np.uint8))
        starts = np.cumsum([0, *(len(c) + 1 for c in coded)])[:-1]
        pairs = np.unique((np.searchsorted(starts, at, "right") - 1) * max(1, len(self.size)) + number)
        row, number = np.divmod(pairs, max(1, len(self.size)))
        edge = np.flatnonzero(np.concatenate([[True], np.diff(row) != 0, [True]])) if len(row) else np.zeros(1, np.int64)
        for a, z in zip(edge[:-1].tolist(), edge[1:].tolist()):
            yield begin + int(row[a]), number[a:z]


_last: list[tuple[str, Automaton]] = []


def automaton_of(name: str, patterns: list[str]) -> Automaton:
    """The automaton of these patterns; a Python worker that runs several tasks of one pass builds it once."""
    if not _last or _last[0][0] != name:
        _last[:] = [(name, Automaton(patterns))]
    return _last[0][1]


def _blocks(rules: DataFrame, most: int, fold: bool) -> Iterator[tuple[bool, list[dict[str, Any]]]]:
    """Rules dealt to blocks of about so many bytes of patterns, one collected at a time, and whether it is the last: (pattern, priority, label, confidence)."""
    known = rules.where("pattern IS NOT NULL AND pattern <> ''").select("pattern", F.col("priority").cast("long").alias("priority"), F.col("label").cast("string").alias("label"), F.col("confidence").cast("double").alias("confidence")).distinct()
    size = known.agg(F.sum(F.octet_length("pattern"))).first()[0] or 0
    n = max(1, -(-size // most))
    if n > 1:
        known = kept(known, "patterns")
    # patterns that count as one lie in one block
    of = F.pmod(F.xxhash64(F.lower("pattern") if fold else F.col("pattern")), F.lit(n))
    for k in range(n):
        yield k + 1 == n, [r.asDict() for r in known.where(of == k).collect()]


def first_rules(texts: DataFrame, rules: DataFrame, text_col: str = "text", *, fold: bool = True, most: int = AUTOMATON_BYTES) -> DataFrame:
    """texts with label, confidence, pattern and priority of the first rule that has a pattern in the text, and `hits`, how many distinct patterns of the rules occur.

    rules: pattern, priority, label, confidence. The least priority wins, then the smaller label, then the smaller pattern; a pattern may stand in several
    rules. fold: A-Z and other capitals count as small letters on both sides. Null and empty patterns are left out; a null text, or one without any, has null results and no hits.
    Nothing is shuffled: patterns of up to `most` bytes make one automaton that goes to all tasks, more are matched in blocks, each a further pass
    over the texts that keeps the better result and is stored before the next. Columns of texts with names of the results are replaced.
    """
    names = ["label", "confidence", "pattern", "priority", "hits"]
    rest = [c for c in texts.columns if c not in names]
    out = texts.select(*rest, F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("long").alias("priority"), F.lit(0).cast("long").alias("hits"))
    for final, block in _blocks(rules, most, fold):
        lower = [(r["pattern"].lower() if fold else r["pattern"]) for r in block]
        patterns = sorted(set(lower))
        place = {p: i for i, p in enumerate(patterns)}
        best: dict[int, tuple] = {}
        for p, r in zip(lower, block):
            # null priorities and labels last
            key = (r["priority"] is None, r["priority"] or 0, r["label"] is None, r["label"] or "", p)
            if place[p] not in best or key < best[place[p]][0]:
                best[place[p]] = (key, r)
        # rules by rank: the least of those found wins
        order = sorted(range(len(patterns)), key=lambda i: best[i][0])
        rank = np.empty(len(patterns), np.int64)
        rank[order] = np.arange(len(patterns))
        told = {n: [best[i][1][n] for i in order] for n in names[:-1]}
        sent = texts.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, patterns, rank, told))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            name, patterns, rank, told = sent.value
            machine = automaton_of(name, patterns)
            key = lambda at, row: (at["priority"][row] is None, at["priority"][row] or 0, at["label"][row] is None, at["label"][row] or "", at["pattern"][row].lower() if fold else at["pattern"][row])
            for b in batches:
                at = {n: b.schema.get_field_index(n) for n in (text_col, *names)}
                had = {n: b.column(at[n]).to_pylist() for n in names}
                said = ((text.as_py() or "") for text in b.column(at[text_col]))
                for i, found in machine.texts(t.lower() if fold else t for t in said):
                    had["hits"][i] += len(found)
                    k = int(rank[found].min())
                    if had["pattern"][i] is None or key(told, k) < key(had, i):
                        for n in names[:-1]:
                            had[n][i] = told[n][k]
                for n in names:
                    b = b.set_column(at[n], b.schema.field(at[n]), pa.array(had[n], b.schema.field(at[n]).type))
                yield b

        out = out.mapInArrow(run, out.schema)
        if not final:
            # one automaton at a time in a task
            out = kept(out, "rules")
    return out


def grown_dictionary(types: DataFrame, headings: DataFrame, examples: int = 5) -> DataFrame:
    """(type, aliases, examples) of a dictionary after headings were mapped to it.

    types: type, aliases (array). headings: title, type, code, example (an id). A heading without a type that the dictionary knows goes to "REVIEW_<code>". Aliases are a type's own, in
    their order, then new titles in theirs, each once; examples are the ids that come first in order (a fixed few is what they are for). Titles are
    made distinct before they are gathered, so what is gathered is the dictionary.
    """
    known = types.select("type", F.lit(True).alias("__known"))
    mapped = headings.join(known, "type", "left").select(F.when(F.col("__known"), F.col("type")).otherwise(F.concat(F.lit("REVIEW_"), F.coalesce(F.col("code").cast("string"), F.lit("")))).alias("type"), "title", "example")
    titles = mapped.where("title IS NOT NULL").select("type", "title").distinct().groupBy("type").agg(F.array_sort(F.collect_list("title")).alias("titles"))
    each = mapped.where("example IS NOT NULL").select("type", "example").distinct()
    # the least few of each task, then of all: no type's examples meet in one task
    salted = each.groupBy("type", F.pmod(F.xxhash64("example"), F.lit(64)).alias("salt")).agg(F.expr(f"slice(array_sort(collect_list(example)), 1, {examples})").alias("es"))
    few = salted.groupBy("type").agg(F.slice(F.array_sort(F.flatten(F.collect_list("es"))), 1, examples).alias("examples"))
    none = F.array().cast("array<string>")
    out = types.select("type", "aliases").join(titles, "type", "full").join(few, "type", "left")
    return out.select("type", F.array_union(F.coalesce("aliases", none), F.coalesce("titles", none)).alias("aliases"), F.coalesce("examples", F.array().cast(few.schema["examples"].dataType)).alias("examples"))


def expanded(items: DataFrame, profiles: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Items with what their type's profile says (arrays; empty where there is no profile), and `profiled`. profiles: one row a type."""
    found = profiles.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__has"))
    out = items.join(found, items[key] == found["__key"], "left")
    return out.select(*items.columns, *[F.coalesce(F.col(f"__{c}"), F.array().cast(profiles.schema[c].dataType)).alias(c) for c in columns], F.coalesce("__has", F.lit(False)).alias("profiled"))
