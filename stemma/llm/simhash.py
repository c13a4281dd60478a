"""SimHash near-duplicates: fingerprints linked by the generalised pigeonhole principle.

Two uses. near_duplicates() links 64-bit fingerprints within a radius of a few bits: every such pair is met. With `similarity`
it links texts whose shingle sets have that Jaccard similarity: fingerprints of 128 bits of such pairs differ in about a seventh of their
bits, blocks and thresholds are planned for that share, and what is found is verified on the sets themselves. Most links are met so; what is
left between the components of these is met exactly, by the shingles that two similar sets must share (see across()).
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._arrow import column, mix
from ._components import components
from ._tables import bounded_batches, stored, unused

BITS = 64
#: A block value that more distinct fingerprints share is not probed; see link_fingerprints().
HOT_BLOCK = 64
#: Cost of one probe against that of one candidate, for the allocation of thresholds: in joins, and in compared groups.
PROBE_COST, ROW_COST = 2.0, 500.0
#: Bits of a block that one histogram counts.
PIECE = 11
#: Bits of a wide fingerprint, and of the pairs at the least similarity the share that its blocks are to meet.
WIDE_BITS, MEET = 128, 0.95
#: Rows of one key that are compared in one go; a key of more is compared in parts.
HOT_KEY = 4000
#: Distinct texts, about, of which the frequent shingles are told, and the most shingles that are told; both say only in which order shingles are taken.
SEEN_TEXTS, MOST_FREQUENT = 20_000, 100_000
#: Bits of a set's sketch, powers of two of 64 on: as many as it has members, and so many at most.
MOST_SKETCH = 1 << 14
#: Pairs that a task gathers before it writes them.
PAIRS = 200_000
#: Room for rounding where a similarity is turned into a count.
EPS = 1e-9


def _majority(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fingerprints of runs of n hashes each (n > 0): a bit is set if over half of a run's hashes have it."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at = np.concatenate([[0], np.cumsum(n)[:-1]])
    ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _rarest(h: np.ndarray, n: np.ndarray, frequent: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of n hashes each (n > 0) the first in one order of all hashes, the frequent ones last: as many as hold one that any similar set shares. (hashes, number of each run)."""
    run = np.repeat(np.arange(len(n)), n)
    rank = np.zeros(len(h), np.int64)
    if len(frequent):
        by = np.argsort(frequent)
        at = np.minimum(np.searchsorted(frequent, h, sorter=by), len(frequent) - 1)
        rank = np.where(frequent[by[at]] == h, len(frequent) - by[at], 0)
    order = np.lexsort((h, rank, run))
    place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    many = n - np.ceil(similarity * n - EPS).astype(np.int64) + 1
    return h[order][place < np.repeat(many, n)], many


def _sketches(h: np.ndarray, n: np.ndarray) -> pa.Array:
    """Of runs of n hashes each (n > 0) whether an odd number falls on each of its places: sets differ in at least as many hashes as their sketches in bits. See _apart()."""
    places = 1 << np.ceil(np.log2(np.clip(n, 64, MOST_SKETCH))).astype(np.int64)
    edge = np.append(0, np.cumsum(places))
    at = np.repeat(edge[:-1], n) + (mix(h) & np.repeat(places - 1, n).astype(np.uint64)).astype(np.int64)
    bits = np.packbits((np.bincount(at, minlength=edge[-1]) & 1).astype(np.uint8))
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((edge // 8).astype(np.int32)), pa.py_buffer(bits)])


def _apart(flat: np.ndarray, edge: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many bits the sketches i and j differ, words flat[edge[x] : edge[x + 1]] of each: the longer of two is folded to the shorter's length, which makes of it the sketch of that length."""
    n = np.diff(edge)
    far, common = np.zeros(len(i), np.int64), np.minimum(n[i], n[j])
    for words in np.unique(common).tolist():
        some = np.flatnonzero(common == words)
        for lo in range(0, len(some), max(1, MOST_SKETCH * 16 // words)):
            which = some[lo : lo + max(1, MOST_SKETCH * 16 // words)]
            both = np.zeros((len(which), words), np.uint64)
            for x in (i[which], j[which]):
                for k in range(0, int(n[x].max()), words):
                    longer = np.flatnonzero(n[x] > k)
                    both[longer] ^= flat[(edge[x[longer]] + k)[:, None] + np.arange(words)]
            far[which] = np.bitwise_count(both).sum(axis=1, dtype=np.int64)
    return far


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, wide: bool = False, frequent: np.ndarray | None = None, similarity: float = 1.0) -> DataFrame:
    """(id_col, fp long, digest long) for each row: SimHash over all shingles of so many words, repeats included, and a hash of the text.

    Texts are lower-cased in A-Z and cut at ASCII white space; a shingle is XXH64 of its words joined by a space. Fewer
    words make one shingle; no words (null, empty or blank texts) have fingerprint 0. wide: over the set of shingles, with
    fp2 long (64 more bits), size int (distinct shingles), sum long (a hash of the set), rarest array<long> and sketch binary (see _rarest()
    and _sketches(); empty and null of no words).
    """
    frequent = np.empty(0, np.uint64) if frequent is None else frequent

    def run(batches):
        import xxhash

        digest = xxhash.xxh64_intdigest
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.uint64)
            distinct, many = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            held, sizes, rows, first, sketches, at = [], [], [], [], [pa.array([None], pa.binary())], np.zeros(batch.num_rows, np.int64)

            def flush():
                if rows:
                    h, n = np.array(held, np.uint64), np.array(sizes, np.int64)
                    out[0, rows] = _majority(h, n)
                    if wide:
                        m = mix(h)
                        out[1, rows] = _majority(m, n)
                        out[2, rows] = np.add.reduceat(mix(m), np.cumsum(n) - n)
                        some, many[rows] = _rarest(h, n, frequent, similarity)
                        first.append(some)
                        at[rows] = np.arange(len(rows)) + sum(map(len, sketches))
                        sketches.append(_sketches(h, n))
                    held.clear(), sizes.clear(), rows.clear()

            for r, text in enumerate(column(batch, "text").cast(pa.binary()).to_pylist()):
                parts = text.lower().split() if text else ()
                if not parts:
                    continue
                some = _shingles(parts, words, seed, digest)
                if wide:
                    some = set(some)
                    distinct[r] = len(some)
                held += some
                sizes.append(len(some))
                rows.append(r)
                if len(held) > 100_000:
                    flush()
            flush()
            cols = [column(batch, "id"), pa.array(out[0].view(np.int64)), column(batch, "digest")]
            if wide:
                rarest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(np.concatenate([np.empty(0, np.uint64), *first]).view(np.int64)))
                cols += [pa.array(out[1].view(np.int64)), pa.array(distinct), pa.array(out[2].view(np.int64)), rarest, pa.concat_arrays(sketches).take(pa.array(at))]
            yield pa.record_batch(cols, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "fp", "digest", "fp2", "size", "sum", "rarest", "sketch"] if wide else ["id", "fp", "digest"]
    text = F.col(text_col).cast("string")
    made = f"id {kind}, fp long, digest long" + (", fp2 long, size int, sum long, rarest array<long>, sketch binary" if wide else "")
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("digest")).mapInArrow(run, made).withColumnRenamed("id", id_col)


def _shingles(parts: list[bytes], words: int, seed: int, digest) -> list[int]:
    """Hashes of the shingles of lower-cased words, repeats included."""
    flat = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    k = min(words, len(parts))
    return [digest(flat[a:z], seed) for a, z in zip((end - size)[: len(parts) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)]


def block_count(n: int, radius: int) -> int:
    """Blocks into which 64 bits are cut for n fingerprints, by the work of evenly spread ones: fewer and wider as n grows."""

    def work(m: int) -> float:
        total = 0.0
        for i in range(m):
            width = (BITS + i) // m
            t = (radius - m + 1 + i) // m
            probes = sum(math.comb(width, d) for d in range(t + 1))
            total += probes * (PROBE_COST + n / 2.0**width)
        return total

    return min(range(min(2, radius + 1), radius + 2), key=lambda m: (work(m), -m))


class Partitions:
    """Bits grouped into blocks by correlation, and estimates of how many fingerprints a probe meets.

    Fingerprints are rows of 64-bit words (n, words).
    """

    def __init__(self, pairs: np.ndarray, n: int, radius: int, blocks: int, most: int | None = None, probe_cost: float = PROBE_COST):
        """pairs[i, j]: how many of n distinct fingerprints have bits i and j. most: the greatest threshold of a block."""
        self.radius, self.m, self.n, self.probe_cost = radius, blocks, n, probe_cost
        self.most = radius if most is None else most
        bits = len(pairs)
        p = np.diag(pairs) / max(n, 1)
        cov = pairs / max(n, 1) - np.outer(p, p)
        sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
        corr = np.abs(cov / np.outer(sd, sd))
        np.fill_diagonal(corr, 0)
        # grow one block after another around its most correlated pair: what moves together is tested together
        left, self.blocks = set(range(bits)), []
        for k in range(self.m):
            size = (bits - sum(map(len, self.blocks))) // (self.m - k)
            rest = sorted(left)
            i = rest[int(corr[np.ix_(rest, rest)].max(axis=1).argmax())]
            block = [i]
            left.discard(i)
            while len(block) < size:
                rest = sorted(left)
                i = rest[int(corr[np.ix_(rest, block)].mean(axis=1).argmax())]
                block.append(i)
                left.discard(i)
            self.blocks.append(sorted(block))
        # pieces of blocks: small enough for a histogram of all their values
        self.pieces = [[x.tolist() for x in np.array_split(np.array(b), -(-len(b) // PIECE))] for b in self.blocks]

    def pick(self, fps: np.ndarray, bits: list[int]) -> np.ndarray:
        out = np.zeros(len(fps), np.int64)
        for k, b in enumerate(bits):
            out |= (fps[:, b >> 6] >> np.uint64(b & 63) & np.uint64(1)).astype(np.int64) << k
        return out

    def set_histograms(self, counts: dict[tuple[int, int], np.ndarray]) -> None:
        """Turn counts of piece values into, per value, the share of fingerprints at distance 0, 1, ... `most`."""
        self.near = {}
        for key, c in counts.items():
            size = len(c)
            at = np.arange(size)
            # number at each distance, by adding one bit position after another
            table = [c.astype(float)] + [np.zeros(size) for _ in range(self.most)]
            for b in range(size.bit_length() - 1):
                flip = at ^ (1 << b)
                table = [table[0]] + [table[d] + below[flip] for d, below in zip(range(1, self.most + 1), table[:-1], strict=True)]
            self.near[key] = np.stack(table) / max(1.0, c.sum())

    def costs(self, fps: np.ndarray) -> np.ndarray:
        """(m, most + 2, len(fps)): estimated work of giving block i threshold t - 1; threshold -1 costs nothing."""
        out = np.zeros((self.m, self.most + 2, len(fps)))
        for i, pieces in enumerate(self.pieces):
            share = None
            for k, bits in enumerate(pieces):
                x = self.near[i, k][:, self.pick(fps, bits)]
                share = x if share is None else np.stack([sum(share[d] * x[t - d] for d in range(t + 1)) for t in range(self.most + 1)])
            probes, width, ways, total = 0, len(self.blocks[i]), 1, np.zeros(len(fps))
            for t in range(self.most + 1):
                total = total + share[t]
                probes += ways
                ways = ways * (width - t) // (t + 1)
                out[i, t + 1] = self.n * total + self.probe_cost * probes
        return out

    def allocate(self, costs: np.ndarray) -> np.ndarray:
        """Thresholds (len(fps), m) of least total cost whose sum is radius - m + 1, by dynamic programming over blocks.

        With thresholds of that sum, two fingerprints within the radius differ by at most its threshold in some block
        (generalised pigeonhole principle); -1 leaves a block out.
        """
        m, kinds, n = costs.shape
        goal = self.radius - m + 1 + m  # thresholds are counted from -1
        best = np.full((goal + 1, n), np.inf)
        best[0] = 0
        picks = []
        for i in range(m):
            nxt, pick = np.full((goal + 1, n), np.inf), np.zeros((goal + 1, n), np.int8)
            for have, t in product(range(goal + 1), range(kinds)):
                if have + t <= goal:
                    cost = best[have] + costs[i, t]
                    better = cost < nxt[have + t]
                    nxt[have + t][better] = cost[better]
                    pick[have + t][better] = t
            best = nxt
            picks.append(pick)
        out, have = np.zeros((n, m), np.int64), np.full(n, goal)
        for i in range(m - 1, -1, -1):
            t = picks[i][have, np.arange(n)]
            out[:, i] = t - 1
            have = have - t
        return out

    def flips(self, width: int, t: int) -> np.ndarray:
        """All values of `width` bits with at most t ones."""
        out = [0]
        last = [(0, -1)]
        for _ in range(t):
            last = [(v | 1 << b, b) for v, top in last for b in range(top + 1, width)]
            out += [v for v, _ in last]
        return np.array(out, np.uint64).view(np.int64)


def _words(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([column(batch, c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in names], axis=1)


def _pair_counts(fps: DataFrame, names: list[str]) -> tuple[np.ndarray, int]:
    """How many fingerprints have each two bits: sums of each task, added up (at most 2,081 rows, or 8,257 of two words)."""
    size = BITS * len(names)

    def run(batches):
        total, n = np.zeros((size, size), np.int64), 0
        for batch in batches:
            bits = np.unpackbits(_words(batch, names).view(np.uint8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
            n += len(bits)
        i, j = np.triu_indices(size)
        yield pa.record_batch([pa.array(np.append(i, -1), pa.int32()), pa.array(np.append(j, -1), pa.int32()), pa.array(np.append(total[i, j], n))], names=["i", "j", "n"])

    out, n = np.zeros((size, size)), 0
    for r in fps.select(*names).mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        if r.i < 0:
            n = r.n
        else:
            out[r.i, r.j] = out[r.j, r.i] = r.n
    return out, n


def _histograms(fps: DataFrame, parts: Partitions, names: list[str]) -> None:
    """Counts of all values of the blocks' pieces: at most 2 ** PIECE rows for each piece."""

    def run(batches):
        counts = {(i, k): np.zeros(1 << len(h), np.int64) for i, hs in enumerate(parts.pieces) for k, h in enumerate(hs)}
        for batch in batches:
            fp = _words(batch, names)
            for (i, k), c in counts.items():
                c += np.bincount(parts.pick(fp, parts.pieces[i][k]), minlength=len(c))
        for (i, k), c in counts.items():
            at = np.flatnonzero(c)
            yield pa.record_batch([pa.array(np.full(len(at), i), pa.int32()), pa.array(np.full(len(at), k), pa.int32()), pa.array(at), pa.array(c[at])], names=["i", "k", "v", "n"])

    counts = {(i, k): np.zeros(1 << len(h), np.int64) for i, hs in enumerate(parts.pieces) for k, h in enumerate(hs)}
    for r in fps.select(*names).mapInArrow(run, "i int, k int, v long, n long").groupBy("i", "k", "v").agg(F.sum("n").alias("n")).collect():
        counts[r.i, r.k][r.v] = r.n
    parts.set_histograms(counts)


def link_fingerprints(fps: DataFrame, radius: int = 2, hot: int = HOT_BLOCK, blocks: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) whose graph has the components of all pairs within radius.

    Bits are grouped into blocks by their correlation, as many as block_count() says: radius + 1 up to some 10^7 fingerprints, then fewer and
    wider ones with thresholds above 0, so that a value's crowd does not grow with the table. For each fingerprint, dynamic programming allots
    thresholds to blocks by the estimated number of candidates; it then probes the block values within them, and
    candidates are verified on all 64 bits. Every pair within the radius is met this way.

    What is left is skew: a block value of more than `hot` fingerprints is left out of the index, so candidates stay in proportion to the
    input. Fingerprints that have or probe such a value are linked exactly in another way: two of them are within
    2r (or 2r + 1) bits of each other only if some value is within r (r + 1) of both, so each goes to all values around it
    and is linked with the smallest met there. A pair that the index cannot meet has both ends in this set.
    """
    pairs, n = _pair_counts(fps, ["fp"])
    if n < 2:
        return fps.sparkSession.createDataFrame([], "a long, b long")
    parts = Partitions(pairs, n, radius, block_count(n, radius) if blocks is None else blocks)
    _histograms(fps, parts, ["fp"])

    def index(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, bits in enumerate(parts.blocks):
                yield pa.record_batch([pa.array(np.full(len(fp), i, np.int32)), pa.array(parts.pick(fp.view(np.uint64)[:, None], bits)), pa.array(fp)], names=["part", "value", "fp"])

    def probe(batches):
        flips = {(i, t): parts.flips(len(b), t) for i, b in enumerate(parts.blocks) for t in range(radius + 1)}
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo in range(0, len(every), 2000):
                fp = every[lo : lo + 2000]
                u = fp.view(np.uint64)[:, None]
                ts = parts.allocate(parts.costs(u))
                for i, bits in enumerate(parts.blocks):
                    value = parts.pick(u, bits)
                    for t in range(radius + 1):
                        some = ts[:, i] == t
                        if some.any():
                            f = flips[i, t]
                            yield pa.record_batch([pa.array(np.full(some.sum() * len(f), i, np.int32)), pa.array((value[some][:, None] ^ f).ravel()), pa.array(np.repeat(fp[some], len(f)))], names=["part", "value", "probe"])

    at = stored(fps.select("fp").mapInArrow(index, "part int, value long, fp long"), "index")
    ask = stored(fps.select("fp").mapInArrow(probe, "part int, value long, probe long"), "probes")
    full = at.groupBy("part", "value").count().where(F.col("count") > hot).select("part", "value")
    cool = at.join(full, ["part", "value"], "left_anti")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("probe")))
    met = ask.join(cool, ["part", "value"]).where((F.col("fp") != F.col("probe")) & (near <= radius)).select(F.least("fp", "probe").alias("a"), F.greatest("fp", "probe").alias("b"))
    crowd = at.join(full, ["part", "value"], "left_semi").select("fp").unionByName(ask.join(full, ["part", "value"], "left_semi").select(F.col("probe").alias("fp"))).distinct()

    inner, outer = radius // 2, (radius + 1) // 2

    def around(batches):
        f = parts.flips(BITS, outer)
        core = np.bitwise_count(f.view(np.uint64)) <= inner
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo in range(0, len(every), 10_000):
                fp = every[lo : lo + 10_000]
                yield pa.record_batch([pa.array((fp[:, None] ^ f).ravel()), pa.array(np.repeat(fp, len(f))), pa.array(np.tile(core, len(fp)))], names=["center", "fp", "core"])

    hub = F.min(F.when(F.col("core"), F.col("fp"))).over(W.partitionBy("center"))
    stars = crowd.mapInArrow(around, "center long, fp long, core boolean").select("fp", hub.alias("hub")).where("hub != fp").select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b"))
    return met.unionByName(stars).distinct()


def wide_blocks(n: int, share: float) -> tuple[int, int]:
    """Blocks of a wide fingerprint, and their thresholds on average, for pairs that differ in such a share of bits.

    Of all that meet MEET of these pairs (some block within its threshold), the one of least work: a row for each probe and what it meets.
    """
    best = None
    for m in range(4, 17):
        width = WIDE_BITS // m
        for t in range(4):
            inside = sum(math.comb(width, d) * share**d * (1 - share) ** (width - d) for d in range(t + 1))
            probes = sum(math.comb(width, d) for d in range(t + 1))
            work = m * probes * (ROW_COST + n / 2.0**width)
            if (1 - inside) ** m <= 1 - MEET and (best is None or work < best[0]):
                best = work, m, t
    return best[1], best[2]


def forest(u: np.ndarray, v: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Which links (u, v) of length d make a least spanning forest of n nodes: by levels of d, all links of a level at once."""
    label, kept = np.arange(n), []
    for level in np.unique(d):
        at = np.flatnonzero(d == level)
        while len(at):
            a, b = label[u[at]], label[v[at]]
            live = a != b
            at, a, b = at[live], a[live], b[live]
            if not len(at):
                break
            high, one = np.unique(np.maximum(a, b), return_index=True)
            kept.append(at[one])
            up = np.arange(n)
            up[high] = np.minimum(a, b)[one]
            while (up[up] != up).any():
                up = up[up]
            label = up[label]
    return np.concatenate(kept) if kept else np.empty(0, np.int64)


def similar_fingerprints(nodes: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b: structs of fp, fp2 and sum) between sets with wide fingerprints (fp, fp2, sum, size) that may have that Jaccard similarity.

    Similar sets differ in a known share of bits, and in size by no more than the similarity; so blocks are keyed by the power of two of the
    size, and a set near its upper end probes the next one too. Bits are grouped by correlation, and dynamic programming allots each
    fingerprint thresholds of a fixed sum over its blocks (pigeonhole: every pair within that sum is met; beyond it most are, MEET at the
    least similarity). Fingerprints of one key are compared on all bits in their task; of the pairs that are close only a least
    spanning forest goes on, so a large group of near-copies gives about one link a member and key and never its pairs.
    A key of many rows is compared in parts: its rows as queries against each part.
    """
    names = ["fp", "fp2", "sum"]
    spark = nodes.sparkSession
    kind = "struct<fp: bigint, fp2: bigint, sum: bigint>"
    pairs, n = _pair_counts(nodes, names[:2])
    if n < 2:
        return spark.createDataFrame([], f"a {kind}, b {kind}")
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    limit = math.floor(WIDE_BITS * share + 2.3 * math.sqrt(WIDE_BITS * share * (1 - share)))
    m, t = wide_blocks(n, share)
    parts = Partitions(pairs, n, m * (t + 1) - 1, m, most=t + 1, probe_cost=ROW_COST)
    _histograms(nodes, parts, names[:2])

    def deal(batches):
        """Rows of keys: 1 stands in the index, 2 asks, 3 both."""
        flips = {(i, k): parts.flips(len(b), k) for i, b in enumerate(parts.blocks) for k in range(parts.most + 1)}
        for batch in batches:
            every, sizes = _words(batch, names), column(batch, "size").to_numpy(zero_copy_only=False).astype(np.float64)
            for lo in range(0, len(every), 2000):
                fp, size = every[lo : lo + 2000], np.maximum(sizes[lo : lo + 2000], 1)
                level = np.floor(np.log2(size)).astype(np.int64)
                wide = np.floor(np.log2(size / similarity + 1e-9)).astype(np.int64) > level
                ts = parts.allocate(parts.costs(fp))
                for i, bits in enumerate(parts.blocks):
                    value = parts.pick(fp, bits)
                    found = [(np.arange(len(fp)), level, value, np.where(ts[:, i] >= 0, 3, 1))]
                    for k in range(parts.most + 1):
                        some = np.flatnonzero(ts[:, i] == k)
                        if len(some):
                            f = flips[i, k]
                            for which, up, flip in ((some, 0, f[1:]), (some[wide[some]], 1, f)):
                                if len(which) and len(flip):
                                    row = np.repeat(which, len(flip))
                                    found.append((row, level[row] + up, (value[which][:, None] ^ flip).ravel(), np.full(len(row), 2)))
                    row, at, value, does = (np.concatenate(x) for x in zip(*found, strict=True))
                    key = (at * 32 + i) << 32 | value
                    yield pa.record_batch([pa.array(key), pa.array(does.astype(np.int8)), *(pa.array(fp[row, c].view(np.int64)) for c in range(3))], names=["key", "does", *names])

    dealt = stored(nodes.select(*names, "size").mapInArrow(deal, "key long, does byte, fp long, fp2 long, sum long"), "dealt")
    full = dealt.groupBy("key").count().where(F.col("count") > HOT_KEY).select("key", F.ceil(F.col("count") / HOT_KEY).cast("int").alias("parts"))
    split = dealt.join(full, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    split = split.select("key", "does", *names, F.pmod(F.xxhash64(*names), F.col("parts")).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    split = split.withColumn("does", (F.col("does").bitwiseAND(F.lit(2)) + F.when(F.col("own") == F.col("part"), F.col("does").bitwiseAND(F.lit(1))).otherwise(0)).cast("byte")).where("does > 0")
    rows = split.select("key", "part", "does", *names).repartition("key", "part").sortWithinPartitions("key", "part")

    def compare(batches):
        held, key = [], None
        for batch in batches:
            keys, part, does = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("key", "part", "does"))
            fp = _words(batch, names)
            edge = np.flatnonzero(np.concatenate([[True], (np.diff(keys) != 0) | (np.diff(part) != 0), [True]]))
            for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if (keys[a], part[a]) != key and held:
                    yield from links(held)
                    held = []
                key = keys[a], part[a]
                held.append((does[a:z], fp[a:z]))
        if held:
            yield from links(held)

    def links(held):
        does, fp = (np.concatenate([h[i] for h in held]) for i in range(2))
        if len(fp) < 2:
            return
        index = np.flatnonzero(does & 1)
        asks = np.flatnonzero(does & 2)
        u, v, d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8)
        for lo in range(0, len(asks), 256):
            a = asks[lo : lo + 256]
            far = np.bitwise_count(fp[a, 0][:, None] ^ fp[index, 0]) + np.bitwise_count(fp[a, 1][:, None] ^ fp[index, 1])
            i, j = np.nonzero(far <= limit)
            other = (fp[a[i]] != fp[index[j]]).any(axis=1)
            i, j = i[other], j[other]
            if len(i):
                u, v, d = np.append(u, a[i]), np.append(v, index[j]), np.append(d, far[i, j])
                tree = forest(u, v, d, len(fp))
                u, v, d = u[tree], v[tree], d[tree]
        if len(u):
            signed = fp.view(np.int64)
            ends = [pa.StructArray.from_arrays([pa.array(signed[x, c]) for c in range(3)], names) for x in (u, v)]
            yield pa.record_batch(ends, names=["a", "b"])

    found = rows.mapInArrow(compare, f"a {kind}, b {kind}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _frequent(docs: DataFrame, text_col: str, words: int, seed: int) -> np.ndarray:
    """Hashes of shingles that several texts hold, the most frequent first: of all texts, or some SEEN_TEXTS distinct ones. They tell in which order shingles are taken, not which links are found."""

    def run(batches):
        import xxhash

        for batch in batches:
            some = [h for t in column(batch, "text").cast(pa.binary()).to_pylist() if t and not t.isspace() for h in set(_shingles(t.lower().split(), words, seed, xxhash.xxh64_intdigest))]
            yield pa.record_batch([pa.array(np.array(some, np.uint64).view(np.int64))], names=["h"])

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    one_in = max(1, texts.count() // SEEN_TEXTS)
    seen = texts.where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0).distinct()
    counted = seen.mapInArrow(run, "h long").groupBy("h").count().where("count > 2").orderBy(F.col("count").desc(), "h").limit(MOST_FREQUENT)
    return np.array([r.h for r in counted.select("h").collect()], np.int64).view(np.uint64)


def _least_shared(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """How many members sets of these sizes share at least if they are similar."""
    return np.ceil(similarity / (1 + similarity) * (x + y) - EPS).astype(np.int64)


def across(nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b: n of two sets): all pairs of sets in different components that may have that Jaccard similarity. nodes: n long, c long (component), size, rarest, sketch.

    Similar sets share a member among their `rarest` (prefix filter), so each set goes to the keys of these, and sets of one key are paired if size and
    places allow that this is the first member that they share, and if their sketches allow the similarity. Sets of one component are not paired. Which
    sets have another to be compared with is found first, a row for each set and key, so sketches go nowhere else, and only pairs that these allow are
    written. A key of over HOT_KEY sets is compared in tiles of its parts.
    """
    columns = ["key", "n", "c", "size", "place"]
    rows = nodes.select(F.posexplode("rarest").alias("place", "key"), "n", "c", "size").select(*columns)
    rows = rows.repartition("key").sortWithinPartitions("key")

    def pairs(keys, c, size, place, own):
        """Pairs (i, j) of rows, one at a time for each row; own: only rows that differ in it."""
        order = np.lexsort((c, keys))
        keys, c, size, place = (x[order] for x in (keys, c, size, place))
        own = None if own is None else own[order]
        edge = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))
        end = np.repeat(edge[1:], np.diff(edge))
        turn = np.append(np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (c[1:] != c[:-1]))), len(keys))
        j = np.repeat(turn[1:], np.diff(turn))
        i = np.arange(len(keys))
        while len(i):
            live = j < end[i]
            i, j = i[live], j[live]
            least = _least_shared(size[i], size[j], similarity)
            ok = (place[i] <= size[i] - least) & (place[j] <= size[j] - least)
            if own is not None:
                ok &= own[i] != own[j]
            if ok.any():
                yield order[i[ok]], order[j[ok]]
            j = j + 1

    def meet(batches):
        """Rows that have another to be compared with; of keys of many sets all."""
        held, full = None, None

        def some_of(some, crowd):
            yield pa.record_batch([*(pa.array(x) for x in some), pa.array(np.full(len(some[0]), crowd))], names=[*columns, "crowd"])

        def whole(some):
            keys, _, c, size, place = some
            used = np.zeros(len(keys), bool)
            for i, j in pairs(keys, c, size, place, None):
                used[i] = used[j] = True
            if used.any():
                yield from some_of([x[used] for x in some], False)

        for batch in batches:
            some = [column(batch, x).to_numpy(zero_copy_only=False) for x in columns]
            if held is not None:
                some = [np.concatenate(x) for x in zip(held, some, strict=True)]
            keys = some[0]
            if not len(keys):
                continue
            edge = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))
            many = np.diff(edge)
            crowd = np.repeat((many > HOT_KEY) | (keys[edge[:-1]] == full), many) if full is not None else np.repeat(many > HOT_KEY, many)
            last = np.zeros(len(keys), bool)
            last[edge[-2] :] = not crowd[-1]
            if crowd.any():
                yield from some_of([x[crowd] for x in some], True)
            if crowd[-1]:
                full = keys[-1]
            alone = np.repeat(many == 1, many)
            yield from whole([x[~crowd & ~last & ~alone] for x in some])
            held = [x[last] for x in some]
        if held is not None and len(held[0]):
            yield from whole(held)

    met = stored(rows.mapInArrow(meet, "key long, n long, c long, size int, place int, crowd boolean"), "met")
    full = met.where("crowd").groupBy("key").agg(F.count("*").alias("rows"), F.min("c").alias("lo"), F.max("c").alias("hi")).select("key", F.ceil(F.col("rows") / HOT_KEY).cast("int").alias("parts"), "lo", "hi")
    tiles = met.join(full, "key", "left").where("lo IS NULL OR lo < hi").withColumn("parts", F.coalesce("parts", F.lit(1)))
    tiles = tiles.withColumn("own", F.pmod(F.xxhash64("n"), F.col("parts")).cast("int")).join(nodes.select("n", "sketch"), "n").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    named = [*columns, "own", "p", "q"]
    tiles = tiles.select(*columns, "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "sketch").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")

    def tile(batches):
        held, found, many = None, [], 0

        def written():
            if found:
                a, b = np.unique(np.concatenate(found, axis=1), axis=1)
                found.clear()
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

        def wholes():
            """Rows of whole tiles, many at a time."""
            nonlocal held
            for batch in batches:
                batch = pa.record_batch([column(batch, x) for x in (*named, "sketch")], names=[*named, "sketch"])
                table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
                if not len(table):
                    continue
                at = [table[x].to_numpy() for x in ("key", "p", "q")]
                last = int(np.flatnonzero(np.append(True, np.logical_or.reduce([x[1:] != x[:-1] for x in at])))[-1])
                (batch,) = table.to_batches()
                yield batch.slice(0, last)
                held = batch.slice(last)
            if held is not None:
                yield held

        for whole in wholes():
            for ab in close(whole):
                found.append(ab)
                many += ab.shape[1]
                if many > PAIRS:
                    yield from written()
                    many = 0
        yield from written()

    def close(batch):
        """(2, pairs) of n, of whole tiles."""
        if not batch.num_rows:
            return
        key, n, c, size, place, own, p, q = (column(batch, x).to_numpy(zero_copy_only=False) for x in named)
        sketch = column(batch, "sketch").to_pylist()
        flat, edge = np.frombuffer(b"".join(sketch), np.uint64), np.append(0, np.cumsum([len(x) // 8 for x in sketch]))
        # in a tile of one part all rows may meet: each counts as a part there
        fresh = np.append(True, (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]))
        part = np.where(p == q, np.arange(len(own)), own - (1 << 30))
        for i, j in pairs(np.cumsum(fresh), c, size, place, part):
            ok = _apart(flat, edge, i, j) <= size[i].astype(np.int64) + size[j] - 2 * _least_shared(size[i], size[j], similarity)
            if ok.any():
                i, j = i[ok], j[ok]
                yield np.stack([np.minimum(n[i], n[j]), np.maximum(n[i], n[j])])

    return tiles.mapInArrow(tile, "a long, b long").distinct()


def _verified(links: DataFrame, texts: DataFrame, words: int, seed: int, similarity: float) -> DataFrame:
    """The links (a, b) whose texts' shingle sets have at least that Jaccard similarity. texts: node, text; one row a node."""

    def run(batches):
        import xxhash

        digest = xxhash.xxh64_intdigest
        for batch in batches:
            ok, last, own = [], None, set()
            for x, y in zip(column(batch, "x").cast(pa.binary()).to_pylist(), column(batch, "y").cast(pa.binary()).to_pylist(), strict=True):
                if x != last:
                    last, own = x, set(_shingles((x or b"").lower().split() or [b""], words, seed, digest))
                other = set(_shingles((y or b"").lower().split() or [b""], words, seed, digest))
                both = len(own & other)
                ok.append(both >= similarity * (len(own) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    kind = links.schema["a"].dataType.simpleString()
    pairs = links.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return pairs.select("a", "b", "x", "y").mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, seed: int = 42, hot: int = HOT_BLOCK, similarity: float | None = None) -> DataFrame:
    """(id_col, fp long, component_id) for each row: component_id is the smallest id reachable over links.

    Links join fingerprints within the radius or, with `similarity`, texts whose shingle sets have at least that Jaccard similarity, all of them
    either way. Equal fingerprints (sets) are one node, whose id is the smallest of its rows, so copies never meet in pairs. Rows without
    words have fingerprint 0 and are linked like any others; repeated rows and ids each get their row; null ids are
    larger than all others and give a null component_id only where all of a component are null; an empty table gives
    no rows; other columns are not read.
    """
    prints, of = _grouped(docs, id_col, text_col, words, radius, seed, hot, similarity)
    ids = of.groupBy("c").agg(F.min("low").alias("component_id"))
    return prints.join(of.join(ids, "c").select("node", "component_id"), "node").select(id_col, "fp", "component_id")


def _least(id_col: str) -> Column:
    """The row that stands for others: the smallest id (null last), then the smallest hash of its text."""
    return F.min(F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col("digest").alias("d")))


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, radius: int, seed: int, hot: int, similarity: float | None) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows (with `node`), and of each node its least id and a number that its component shares."""
    bounded_batches(docs.sparkSession)
    told = {} if similarity is None else {"wide": True, "frequent": _frequent(docs, text_col, words, seed), "similarity": similarity}
    prints = stored(fingerprints(docs, id_col, text_col, words, seed, **told), "fingerprints")
    if similarity is None:
        prints = prints.withColumn("node", F.col("fp"))
        nodes = prints.groupBy("node").agg(F.min(id_col).alias("low"))
        found = components(link_fingerprints(nodes.select(F.col("node").alias("fp")), radius, hot))
        return prints, nodes.join(found, "node", "left").select("node", "low", F.coalesce("component", "node").alias("c"))
    prints = prints.withColumn("node", F.struct("fp", "fp2", "sum"))
    nodes = stored(prints.groupBy("node").agg(F.min(id_col).alias("low"), _least(id_col).alias("k"), F.max("size").alias("size"), F.first("rarest").alias("rarest"), F.first("sketch").alias("sketch")), "nodes")
    repeats = _repeats(prints, id_col)

    def similar(links: DataFrame) -> DataFrame:
        used = nodes.join(links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct(), "node").select("node", "k.i", "k.d")
        text = F.col(text_col).cast("string")
        base = docs.select(F.col(id_col).alias("i"), text.alias("text"), F.xxhash64(text).alias("d"))
        texts = base.join(used, base["i"].eqNullSafe(used["i"]) & (base["d"] == used["d"])).select("node", "text")
        # rows that repeat both id and text are one
        return _verified(links, texts.groupBy("node").agg(F.min("text").alias("text")) if repeats else texts, words, seed, similarity)

    found = components(similar(stored(similar_fingerprints(nodes.select("node.fp", "node.fp2", "node.sum", "size"), similarity), "similar")))
    parts = stored(nodes.join(found, "node", "left").select("node", "low", F.coalesce("component", "node").alias("c"), F.col("node.sum").alias("n"), "size", "rarest", "sketch"), "parts")
    # links between these components that fingerprints do not tell
    of = parts.select("node", "c")
    apart = across(parts.select("n", F.col("c.sum").alias("c"), "size", "rarest", "sketch"), similarity)
    more = similar(stored(apart.join(parts.select(F.col("n").alias("a"), F.col("node").alias("x")), "a").join(parts.select(F.col("n").alias("b"), F.col("node").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b")), "close"))
    ends = more.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").select("x", "y")
    whole = components(ends, "x", "y").toDF("c", "component")
    return prints, parts.select("node", "low", "c").join(whole, "c", "left").select("node", "low", F.coalesce("component", "c").alias("c"))


def _repeats(prints: DataFrame, id_col: str) -> bool:
    """Whether some id stands with the same text twice."""
    return not prints.groupBy(id_col, "digest").count().where("count > 1").isEmpty()


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, seed: int = 42, hot: int = HOT_BLOCK, similarity: float | None = None) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: the one with the smallest id (null last), then hash of its text.

    Of rows that repeat both, the one with the smallest hash of all columns that can be hashed.
    """
    prints, of = _grouped(docs, id_col, text_col, words, radius, seed, hot, similarity)
    keep = stored(prints.join(of.select("node", "c"), "node").groupBy("c").agg(_least(id_col).alias("k")).select("k.i", "k.d"), "kept")
    digest = F.xxhash64(F.col(text_col).cast("string"))
    rows = docs.join(keep, docs[id_col].eqNullSafe(keep["i"]) & (digest == keep["d"]), "left_semi")
    if not _repeats(prints, id_col):
        return rows
    number = unused(docs.columns, "nth")
    known = [f.name for f in docs.schema if f.dataType.typeName() not in ("map", "variant")]
    return rows.withColumn(number, F.row_number().over(W.partitionBy(id_col, digest).orderBy(F.xxhash64(*known)))).where(F.col(number) == 1).drop(number)
