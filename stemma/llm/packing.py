"""Best-fit packing by sum of squares: documents into as few token sequences of a fixed size as can be."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrow import column, slices, text_buffer
from ._tables import bounded_batches, stored
from .tokens import encoder, vocabulary

#: Pieces that one packing holds at most; a task with more of them packs several times.
MOST_PIECES = 200_000


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin of each piece, its place there, and each bin's room left.

    The longest pieces come first (equal ones in their order). Each goes to the open bin whose residual gap makes
    the sum of squared counts of open bins per gap smallest; of equal choices the smallest gap wins, and a gap that
    the piece fills takes the bin out of the count. A bin is opened only when no open one has room: with the long
    pieces first this comes out at the lower bound (tokens / capacity) or next to it.
    """
    n = len(lengths)
    of, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
    count = np.zeros(capacity + 1, np.int64)
    stacks: dict[int, list[int]] = {}
    left: list[int] = []
    never = np.int64(1) << 60
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        here = count[s:]
        # N(g) -> N(g) - 1 and N(g - s) -> N(g - s) + 1 changes the sum by 2 (N(g - s) - N(g) + 1)
        change = np.where(here > 0, 2 * (count[: capacity - s + 1] - here + 1), never)
        if here[0] > 0:
            change[0] = 1 - 2 * here[0]
        k = int(change.argmin())
        if change[k] == never:
            b, gap = len(left), capacity
            left.append(capacity)
        else:
            gap = s + k
            b = stacks[gap].pop()
            count[gap] -= 1
        of[i], at[i] = b, capacity - gap
        left[b] = gap - s
        if gap > s:
            stacks.setdefault(gap - s, []).append(b)
            count[gap - s] += 1
    return of, at, np.array(left, np.int64)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, vocabulary_path: str | None = None, slack: int | None = None) -> DataFrame:
    """Tokenise whole texts, end each with end_id, cut only what is longer than capacity, and pack.

    Returns per piece: id_col, piece (from 0), start (its document's ids before it), length, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers), sequence_id, offset (place in the sequence, gapless from 0), room (what
    the sequence has left). A null or empty text is one piece of one id; repeated rows and null ids are packed row by
    row; other columns are not read; an empty table gives no rows.

    Each task of the scan packs its own pieces, so no text or id is shuffled. Sequences left with more than `slack`
    tokens of room (capacity / 64 unless given) are taken apart and packed again across tasks, in rounds of fewer
    tasks, until one task holds what is open.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    path, slack = vocabulary_path or vocabulary(), capacity // 64 if slack is None else slack
    kind = docs.schema[id_col].dataType
    out = T.StructType([T.StructField(id_col, kind), *(T.StructField(c, t) for c, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()), ("room", T.LongType())))])

    def cut(batches):
        encode = encoder(path).encode
        ids, rows, parts = [], [], 0
        base = TaskContext.get().partitionId() << 36
        for batch in batches:
            found = []
            data, off = text_buffer(column(batch, "text"))
            for a, z in slices(off):
                tokens, begins = encode(data[off[a] : off[z]], off[a : z + 1] - off[a], end_id)
                view = memoryview(tokens.astype("<u4")).cast("B")
                for r, (lo, hi) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True), a):
                    for p, at in enumerate(range(lo, hi, capacity)):
                        end = min(hi, at + capacity)
                        found.append((r, p, at - lo, end - at, zlib.crc32(view[4 * at : 4 * end])))
            found = np.array(found, np.int64).reshape(-1, 5)
            ids.append(column(batch, "id").take(pa.array(found[:, 0])))
            rows.append(found[:, 1:])
            parts += len(found)
            if parts >= MOST_PIECES:
                table, base = packed(ids, rows, base)
                yield from table
                ids, rows, parts = [], [], 0
        if parts:
            yield from packed(ids, rows, base)[0]

    def packed(ids, rows, base):
        rows = np.concatenate(rows)
        of, at, left = sum_of_squares(rows[:, 2], capacity)
        cols = [pa.chunked_array(ids), pa.array(rows[:, 0].astype(np.int32)), *(pa.array(x) for x in (rows[:, 1], rows[:, 2], rows[:, 3], base + of, at, left[of]))]
        return pa.table(cols, names=out.names).combine_chunks().to_batches(max_chunksize=20_000), base + len(left)

    def again(batches, level):
        base = (level << 56) + (TaskContext.get().partitionId() << 36)
        ids, rows, parts = [], [], 0
        for batch in batches:
            ids.append(batch.column(0))
            rows.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(1, 5)], 1))
            parts += batch.num_rows
            if parts >= MOST_PIECES:
                table, base = packed(ids, rows, base)
                yield from table
                ids, rows, parts = [], [], 0
        if parts:
            yield from packed(ids, rows, base)[0]

    done = []
    now = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, out), "pieces")
    before, level = None, 1
    while True:
        wide = now.where(F.col("room") > slack)
        n = wide.count()
        if not n or before is not None and (before[1] == 1 or n > 0.9 * before[0]):
            done.append(now)
            break
        done.append(now.where(F.col("room") <= slack))
        tasks = -(-n // 50_000)
        now = stored(wide.repartition(tasks).mapInArrow(lambda b, k=level: again(b, k), out), "pieces")
        before, level = (n, tasks), level + 1
    result = done[0]
    for df in done[1:]:
        result = result.unionByName(df)
    return result


def sequences(docs: DataFrame, pieces: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, vocabulary_path: str | None = None, capacity: int = 2048) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (array of int). docs: the table that pieces came from; capacity: as it was packed.

    Documents are encoded and cut again, and each place gets its ids by all that is known of its piece: id (nulls equal), number, start, length
    and checksum of the ids. Rows with one id may hold different texts; pieces that agree in all of these are one piece, of
    which each place takes a copy. Should two different ones agree, an error says so. An empty table gives no rows. A piece that many places
    copy is one row of a join, whose other side Spark may split.
    """
    bounded_batches(docs.sparkSession)
    path = vocabulary_path or vocabulary()
    key = ["piece", "start", "length", "ids_crc32"]
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        encode = encoder(path).encode
        for batch in batches:
            data, off = text_buffer(column(batch, "text"))
            for a, z in slices(off):
                tokens, begins = encode(data[off[a] : off[z]], off[a : z + 1] - off[a], end_id)
                rows, found = [], []
                for r, (lo, hi) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True), a):
                    for p, at in enumerate(range(lo, hi, capacity)):
                        own = tokens[at : min(hi, at + capacity)].astype("<u4")
                        rows.append(r)
                        found.append((p, at - lo, len(own), zlib.crc32(own.tobytes()), own.astype(np.int32)))
                columns = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())))]
                yield pa.record_batch([column(batch, "id").take(pa.array(rows, pa.int64())), *columns], names=["id", *key, "part"])

    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long, part array<int>")
    same = F.min(F.xxhash64("part")) == F.max(F.xxhash64("part"))
    known = made.groupBy("id", *key).agg(F.when(same, F.first("part")).otherwise(F.raise_error(F.lit("two pieces of one id agree in length and checksum"))).alias("part"))
    known = known.select(F.col("id").alias("__id"), *[F.col(c).alias(f"__{c}") for c in key], "part")
    met = F.col(id_col).eqNullSafe(F.col("__id"))
    for c in key:
        met &= F.col(c) == F.col(f"__{c}")
    placed = pieces.select(id_col, *key, "sequence_id", "offset").join(known, met).select("sequence_id", F.struct("offset", "part").alias("p"))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list("p")), lambda x: x["part"])).alias("ids"))
