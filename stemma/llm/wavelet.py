"""Token ids in a compressed binary format: one wavelet matrix per shard, with rank and select on its bit-planes.

A shard's file holds its planes in blocks that are compressed by themselves, and a directory: of each block, the ones before it and its
place. So one token is read by opening one block a plane; counting a token opens two a plane, and each occurrence is found by a search in the directory.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._arrow import column, slices, text_buffer
from ._tables import bounded_batches, new_path
from .tokens import encoder, vocabulary

MAGIC = b"WVMX2\0\0\0"
#: Bits of a plane's block.
BLOCK = 1 << 16
#: Tokens that a shard holds about; one longer document is a shard of its own.
SHARD_TOKENS = 1 << 19


#: The place of the nth one of each byte.
_NTH = np.array([[*[b for b in range(8) if v >> b & 1], *[0] * 8][:8] for v in range(256)], np.uint8)


class Plane:
    """A row of n bits in blocks; `ranks`: ones before each block, and of all. Blocks are opened when they are asked for."""

    def __init__(self, n: int, blocks: list, ranks: np.ndarray):
        self.n, self.blocks, self.ranks = n, blocks, ranks
        self._open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, one: np.ndarray) -> Plane:
        packed = np.packbits(one, bitorder="little")
        blocks = [packed[lo : lo + BLOCK // 8] for lo in range(0, len(packed), BLOCK // 8)]
        return cls(len(one), blocks, np.concatenate([[0], np.cumsum([int(np.bitwise_count(b).sum()) for b in blocks])]).astype(np.int64))

    def block(self, k: int) -> np.ndarray:
        """The bytes of a block."""
        data = self.blocks[k]
        return data if isinstance(data, np.ndarray) else np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=BLOCK // 8), np.uint8)

    def opened(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """A block's bytes, and the ones before each of them."""
        if k not in self._open:
            data = self.block(k)
            self._open[k] = data, np.concatenate([[0], np.cumsum(np.bitwise_count(data), dtype=np.int64)])
        return self._open[k]

    def bits(self) -> np.ndarray:
        """All of them, unpacked."""
        data = [self.block(k) for k in range(len(self.blocks))]
        return np.unpackbits(np.concatenate(data) if data else np.empty(0, np.uint8), count=self.n, bitorder="little")

    def rank1(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ones before each position, and the bit there (0 at the end)."""
        at = np.asarray(at, np.int64)
        out, bit = np.empty(len(at), np.int64), np.zeros(len(at), np.uint8)
        blocks = at // BLOCK
        for k in np.unique(blocks).tolist():
            own = np.flatnonzero(blocks == k)
            if k == len(self.blocks):
                out[own] = self.ranks[-1]
                continue
            data, before = self.opened(k)
            inner = at[own] - k * BLOCK
            byte, shift = inner >> 3, (inner & 7).astype(np.uint8)
            value = np.append(data, np.uint8(0))[byte]
            out[own] = self.ranks[k] + before[byte] + np.bitwise_count(value & ((np.uint8(1) << shift) - np.uint8(1)))
            bit[own] = value >> shift & 1
        return out, bit

    def select(self, bit: int, nth: np.ndarray) -> np.ndarray:
        """The position of the nth (from 0) such bit: the directory gives the block, its counts the byte, a table the bit."""
        nth = np.asarray(nth, np.int64)
        out = np.empty(len(nth), np.int64)
        ranks = self.ranks if bit else np.minimum(np.arange(len(self.ranks)) * BLOCK, self.n) - self.ranks
        blocks = np.searchsorted(ranks, nth, "right") - 1
        for k in np.unique(blocks).tolist():
            own = np.flatnonzero(blocks == k)
            data, before = self.opened(k)
            if not bit:
                data, before = ~data, np.arange(len(before)) * 8 - before
            rest = nth[own] - ranks[k]
            byte = np.searchsorted(before, rest, "right") - 1
            out[own] = k * BLOCK + byte * 8 + _NTH[data[byte], rest - before[byte]]
        return out


class WaveletMatrix:
    """A sequence of unsigned integers as bit-planes, the highest bit first.

    At each plane the symbols with a zero bit move before those with a one bit, both in order; so a position goes on
    as rank0 or as zeros + rank1, and all of access, count and occurrence lookup are rank and select on single planes.
    """

    def __init__(self, planes: list[Plane], zeros: np.ndarray, n: int):
        self.planes, self.zeros, self.n, self.bits = planes, zeros, n, len(planes)

    @classmethod
    def of(cls, values: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        values = np.asarray(values).astype(np.uint32)
        bits = max(1, int(values.max()).bit_length() if len(values) else 1) if bits is None else bits
        planes, zeros = [], []
        values = values.astype(np.uint16) if bits <= 16 else values
        for b in range(bits - 1, -1, -1):
            one = (values & values.dtype.type(1 << b)).astype(bool)
            planes.append(Plane.of(one))
            low = values[~one]
            zeros.append(len(low))
            values = np.concatenate([low, values[one]])
        return cls(planes, np.array(zeros, np.int64), len(values))

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at some positions."""
        at = np.asarray(at, np.int64)
        out = np.zeros(len(at), np.uint32)
        for k in range(self.bits):
            ones, bit = self.planes[k].rank1(at)
            at = np.where(bit, self.zeros[k] + ones, at - ones)
            out = out << np.uint32(1) | bit
        return out

    def all(self) -> np.ndarray:
        """The whole sequence: from the lowest plane up, each taking its zeros and ones back to where they stood."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        now = np.zeros(self.n, kind)  # in the order below the lowest plane
        for k in range(self.bits - 1, -1, -1):
            one = self.planes[k].bits().view(bool)
            zeros = int(self.zeros[k])
            up = np.empty_like(now)
            up[~one] = now[:zeros]
            up[one] = now[zeros:] | kind(1 << (self.bits - 1 - k))
            now = up
        return now.astype(np.uint32)

    def _range(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        for k in range(self.bits):
            a, b = self.planes[k].rank1(np.array([lo, hi]))[0].tolist()
            lo, hi = (int(self.zeros[k]) + a, int(self.zeros[k]) + b) if symbol >> (self.bits - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        """How often a symbol stands in [lo, hi)."""
        if symbol < 0 or symbol >> self.bits:
            return 0
        a, b = self._range(symbol, min(lo, self.n), self.n if hi is None else min(hi, self.n))
        return b - a

    def occurrences(self, symbol: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """The positions of a symbol in [lo, hi), ascending: select, from the lowest plane up."""
        if symbol < 0 or symbol >> self.bits:
            return np.empty(0, np.int64)
        a, b = self._range(symbol, min(lo, self.n), self.n if hi is None else min(hi, self.n))
        at = np.arange(a, b)
        for k in range(self.bits - 1, -1, -1):
            bit = symbol >> (self.bits - 1 - k) & 1
            at = self.planes[k].select(bit, at - (int(self.zeros[k]) if bit else 0))
        return at


def encode_shard(tokens: np.ndarray, sizes: np.ndarray, level: int = 1) -> bytes:
    """One shard's file: header, zeros per plane, directory (ones before each block, bytes of each), document sizes, then the blocks."""
    m = WaveletMatrix.of(tokens)
    pack = zstandard.ZstdCompressor(level=level).compress
    documents = pack(sizes.astype("<u4").tobytes())
    blocks = [pack(b.tobytes()) for p in m.planes for b in p.blocks]
    ranks = np.concatenate([p.ranks[1:] for p in m.planes]).astype("<u8")
    head = MAGIC + struct.pack("<QQIIQ", m.n, len(sizes), m.bits, BLOCK, len(documents)) + m.zeros.astype("<u8").tobytes()
    return b"".join([head, ranks.tobytes(), np.array([len(b) for b in blocks], "<u4").tobytes(), documents, *blocks])


def decode_shard(data: bytes) -> tuple[WaveletMatrix, np.ndarray]:
    """The matrix (its blocks still closed) and the document sizes of a shard's file."""
    if data[:8] != MAGIC:
        raise ValueError("not a shard of token ids")
    n, docs, bits, block, size = struct.unpack_from("<QQIIQ", data, 8)
    if block != BLOCK:
        raise ValueError(f"blocks of {block} bits")
    at, each = 40, -(-n // BLOCK)
    zeros = np.frombuffer(data, "<u8", bits, at).astype(np.int64)
    at += 8 * bits
    ranks = np.frombuffer(data, "<u8", bits * each, at).astype(np.int64).reshape(bits, each)
    at += 8 * bits * each
    ends = at + 4 * bits * each + size + np.cumsum(np.frombuffer(data, "<u4", bits * each, at).astype(np.int64))
    at += 4 * bits * each
    sizes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at : at + size], max_output_size=max(1, 4 * docs)), "<u4").astype(np.int64)
    edges, view = [at + size, *ends.tolist()], memoryview(data)
    blocks = [view[a:z] for a, z in zip(edges[:-1], edges[1:], strict=True)]
    planes = [Plane(n, blocks[k * each : (k + 1) * each], np.concatenate([[0], ranks[k]])) for k in range(bits)]
    return WaveletMatrix(planes, zeros, n), sizes


def write_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, vocabulary_path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> str:
    """Encode whole texts, end each with end_id, and write shards in ascending order of id_col (null first). Returns the path.

    The table at `path` has one row per shard: its rank (task, number), its counts, the ids of its documents and the
    shard's file as a binary value, each within its own row group, so it can live in any store that Spark writes to.
    A null or empty text has end_id alone; rows with the same id stand in the order of their texts; other columns are
    not read; an empty table gives a path with no shards. Texts are dealt by ranges of the id, so one id that very
    many rows share stays in one task (and in shards of bounded size); nothing else depends on how rows are spread.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    vocab = vocabulary_path or vocabulary()
    id_type = docs.schema[id_col].dataType.simpleString()

    def encode(batches):
        encode_texts = encoder(vocab).encode
        task, number, held, size, ids = TaskContext.get().partitionId(), 0, [], 0, []

        def shard():
            tokens, sizes = np.concatenate(held), np.array([len(x) for x in held], np.int64)
            docs_of = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), pa.concat_arrays(ids))
            return pa.record_batch([pa.array([task], pa.int32()), pa.array([number], pa.int32()), pa.array([len(held)], pa.int64()), pa.array([len(tokens)], pa.int64()), docs_of, pa.array([encode_shard(tokens, sizes)], pa.binary())], names=["task", "number", "n_docs", "n_tokens", "ids", "file"])

        for batch in batches:
            keys, lo = column(batch, "id"), 0
            data, off = text_buffer(column(batch, "text"))
            for a, z in slices(off):
                tokens, begins = encode_texts(data[off[a] : off[z]], off[a : z + 1] - off[a], end_id)
                for r in range(a, z):
                    held.append(tokens[begins[r - a] : begins[r - a + 1]])
                    size += len(held[-1])
                    if size >= shard_tokens:
                        ids.append(keys[lo : r + 1])
                        yield shard()
                        held, size, ids, lo, number = [], 0, [], r + 1, number + 1
            ids.append(keys[lo:])
        if held:
            yield shard()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")
    shards = rows.mapInArrow(encode, f"task int, number int, n_docs long, n_tokens long, ids array<{id_type}>, file binary")
    shards.write.option("parquet.block.size", 16 << 20).option("compression", "uncompressed").parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id", group: int = 1000) -> DataFrame:
    """Documents of written shards: id_col, start (ids of all documents before it), tokens (little-endian unsigned 32-bit ids)."""
    table = spark.read.parquet(path)
    id_type = table.schema["ids"].dataType.elementType.simpleString()

    def decode(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                matrix, sizes = decode_shard(column(batch, "file")[r].as_py())
                tokens = matrix.all().astype("<u4")
                ends = np.cumsum(sizes)
                ids = column(batch, "ids")[r].values
                for lo in range(0, len(sizes), 2000):
                    some = slice(lo, lo + 2000)
                    first = int(ends[lo] - sizes[lo])
                    off = np.concatenate([[0], ends[some] - first]) * 4
                    data = pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(tokens[first : int(ends[some][-1])].tobytes())])
                    task, number = ([column(batch, c)[r].as_py()] * (len(off) - 1) for c in ("task", "number"))
                    yield pa.record_batch([ids[some], pa.array(task, pa.int32()), pa.array(number, pa.int32()), pa.array(ends[some] - sizes[some]), data], names=[id_col, "task", "number", "inner", "tokens"])

    docs = table.select("task", "number", "ids", "file").mapInArrow(decode, f"`{id_col}` {id_type}, task int, number int, inner long, tokens binary")
    return _placed(docs, table, group).select(id_col, (F.col("base") + F.col("inner")).alias("start"), "tokens")


def _placed(rows: DataFrame, table: DataFrame, group: int) -> DataFrame:
    """Rows of shards (task, number) with `base`: the ids of all shards before."""
    few = table.count() <= 500_000  # 24 bytes a shard
    # places of shards: sums within groups of them, then over groups; only counts move
    counts = table.groupBy("task").agg(F.sum("n_tokens").alias("n")).withColumn("g", F.floor(F.col("task") / group))
    groups = counts.groupBy("g").agg(F.sum("n").alias("n")).select("g", (F.sum("n").over(W.orderBy("g")) - F.col("n")).alias("base"))
    tasks = counts.join(groups, "g").select("task", (F.col("base") + F.sum("n").over(W.partitionBy("g").orderBy("task")) - F.col("n")).alias("base"))
    starts = table.select("task", "number", "n_tokens").join(tasks, "task").select("task", "number", (F.col("base") + F.sum("n_tokens").over(W.partitionBy("task").orderBy("number")) - F.col("n_tokens")).alias("base"))
    return rows.join(F.broadcast(starts) if few else starts, ["task", "number"])


def count_tokens(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """(token int, n long): how often each token asked for stands in written shards. Two blocks a plane are opened in each shard; tokens that are nowhere have 0."""
    asked = sorted(set(tokens))

    def run(batches):
        total = np.zeros(len(asked), np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                matrix, _ = decode_shard(column(batch, "file")[r].as_py())
                total += np.array([matrix.count(t) for t in asked], np.int64)
        yield pa.record_batch([pa.array(asked, pa.int32()), pa.array(total)], names=["token", "n"])

    found = spark.read.parquet(path).select("file").mapInArrow(run, "token int, n long")
    every = spark.createDataFrame([(t, 0) for t in asked], "token int, n long")
    return found.unionByName(every).groupBy("token").agg(F.sum("n").alias("n"))


def find_tokens(spark: SparkSession, path: str, tokens: list[int], id_col: str = "doc_id", group: int = 1000) -> DataFrame:
    """(token int, id_col, position long, place long): every occurrence of the tokens asked for, its place in its document and among all ids."""
    asked = sorted(set(tokens))
    table = spark.read.parquet(path)
    id_type = table.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                matrix, sizes = decode_shard(column(batch, "file")[r].as_py())
                ends = np.cumsum(sizes)
                task, number = (column(batch, c)[r].as_py() for c in ("task", "number"))
                for t in asked:
                    at = matrix.occurrences(t)
                    doc = np.searchsorted(ends, at, "right")
                    for lo in range(0, len(at), 50_000):
                        a, d = at[lo : lo + 50_000], doc[lo : lo + 50_000]
                        fixed = [pa.array(np.full(len(a), x, np.int32)) for x in (task, number, t)]
                        yield pa.record_batch([*fixed, column(batch, "ids")[r].values.take(pa.array(d)), pa.array(a - ends[d] + sizes[d]), pa.array(a)], names=["task", "number", "token", id_col, "position", "inner"])

    found = table.select("task", "number", "ids", "file").mapInArrow(run, f"task int, number int, token int, `{id_col}` {id_type}, position long, inner long")
    return _placed(found, table, group).select("token", id_col, "position", (F.col("base") + F.col("inner")).alias("place"))
