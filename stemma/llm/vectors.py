"""Embedding near-duplicates: spherical-cap filters with list-decodable random product codes."""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrow import column
from ._components import components
from ._tables import stored

#: Filters that two vectors at the threshold share on average, over all codes.
SHARED = 14.0
#: Independent codes. How many filters of one code a vector exceeds varies with its place; over several it evens out.
CODES = 4
#: Vectors that a filter holds on average.
BUCKET = 32
#: A filter of more rows is compared in parts of this many.
HOT_FILTER = 1000
#: Members of a unit that are compared with another's in one go; larger units are compared in parts of this size.
PART = 4096
#: Directions of the first round that gathers tight groups; each next round has so many times more.
COARSE = 16
#: What a comparison writes: two units that link with all members, two whose members are to be compared, how many a unit links with, and an edge of a tree of links.
WHOLE, OPEN, COUNTED, LINKED = range(4)


@dataclass
class ProductCode:
    """Filter directions (c_1, ..., c_m) / sqrt(m), each part one of `size` random unit vectors, in randomly turned space.

    A vector is in the caps of all directions whose product with it is at least `least`. They are listed without trying
    all size ** m: parts are joined one after another, keeping what can still reach the bound (list decoding).
    """

    turn: np.ndarray
    parts: list[np.ndarray]
    least: float

    @classmethod
    def plan(cls, n: int, dim: int, cosine: float, seed: int = 11, shared: float = SHARED / CODES) -> ProductCode:
        """A code whose filters hold BUCKET of n vectors on average, and pairs at the cosine share so many of them."""
        per_vector, normal = 20.0, NormalDist()
        for _ in range(30):
            filters = max(16.0, n * per_vector / BUCKET)
            z = normal.inv_cdf(1 - min(0.2, per_vector / filters))
            # of the caps of a vector, those that one at the cosine is in too
            both = 2 * (1 - normal.cdf(z * math.sqrt((1 - cosine) / (1 + cosine))))
            per_vector = shared / max(0.01, 0.9 * both)
        return cls.of(filters, dim, z / math.sqrt(dim), seed)

    @classmethod
    def of(cls, filters: float, dim: int, least: float, seed: int) -> ProductCode:
        """A code of about so many directions."""
        m = 1
        while filters ** (1 / m) > 256 and m < dim:
            m += 1
        size = math.ceil(filters ** (1 / m))
        rng = np.random.default_rng(seed)
        turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        parts = []
        for cols in np.array_split(np.arange(dim), m):
            c = rng.normal(size=(size, len(cols)))
            parts.append(c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(m))
        return cls(turn, parts, least)

    def _products(self, x: np.ndarray) -> list[np.ndarray]:
        y, at, out = x @ self.turn, 0, []
        for c in self.parts:
            out.append(y[:, at : at + c.shape[1]] @ c.T)
            at += c.shape[1]
        return out

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all directions that exceed the bound."""
        parts = self._products(x)
        rest = np.cumsum([p.max(axis=1) for p in parts[::-1]], axis=0)[::-1]  # the most that parts from i on can add
        row, code, have = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        for i, p in enumerate(parts):
            most = rest[i + 1] if i + 1 < len(parts) else np.zeros(len(x))
            total = have[:, None] + p[row]
            r, k = np.nonzero(total + most[row][:, None] >= self.least)
            have, code, row = total[r, k], code[r] * p.shape[1] + k, row[r]
        return row, code

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The direction closest to each vector."""
        code = np.zeros(len(x), np.int64)
        for p in self._products(x):
            code = code * p.shape[1] + p.argmax(axis=1)
        return code


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Unit rows, in double precision; scaled by their greatest component first, so that no square overflows or vanishes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(vec: Column) -> Column:
    """Not null, of some length, all components present and finite, not all zero."""
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(vec) > 0) & finite & F.exists(vec, lambda v: v != 0), F.lit(False))


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """One row per vector: id_col, n_links (other vectors of at least this cosine), component_id (smallest id reachable).

    Equal vectors are one class. Classes within half the angle of a common centre form a unit: all of its members
    link with each other, so a dense group needs no pairs within. Filters bring units together; the angle between
    centres and their radii decide most pairs of units as wholes (all members link, or none); links of vectors that are alone in their units, as those of a
    diffuse group are, are counted where they are met, and of which link which only a tree is written; only in between members
    are compared, where what is written is how many each links with, not with which. Every link counted is implied by exact angles or verified in double precision; a pair is missed only
    if it shares no filter (about one in a million of pairs at the threshold if filters were independent; measured recall stands in the README).

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are their own
    component; only vectors of the same length are compared; repeated ids each get their row; null ids are larger than others; an
    empty table gives no rows; other columns are not read. A filter with many units is compared in parts, each pair of parts by itself.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    good = rows.where(_usable(F.col("v")))
    classes = stored(good.groupBy("v").agg(F.min("id").alias("low"), F.count("*").alias("copies")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    sizes = sorted((r[0], r[1]) for r in classes.groupBy(F.size("v")).count().collect())
    found = None
    for dim, n in sizes:
        own = classes.where(F.size("v") == dim)
        part = _links_of(own, dim, n, cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "cid long, n_links long, component long")
    found = stored(found, "vector-links")
    lows = found.join(classes.select("cid", "low"), "cid").groupBy("component").agg(F.min("low").alias("component_id"))
    of = classes.select("cid", "v").join(found, "cid").join(lows, "component").select("v", "n_links", "component_id")
    linked = rows.join(of, "v", "left")
    return linked.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))


def _met(a: np.ndarray, b: np.ndarray, kind: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a), pa.array(b), pa.array(kind.astype(np.int32)), pa.array(w)], names=["a", "b", "kind", "w"])


class Forest:
    """Connected parts of the links of one comparison: a tree for each, whatever the number of links."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, links: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> None:
        """links: which row meets which column. Within the block labels spread until they stay, then one step for each row and column."""
        n = len(rows)
        low, across = np.arange(n), np.full(len(columns), n)
        while True:
            across = np.minimum(across, np.where(links, low[:, None], n).min(axis=0))
            now = np.minimum(low, np.where(links, across[None, :], n).min(axis=1))
            if (now == low).all():
                break
            low = now
        for own, label in ((rows, low), (columns, across)):
            for x, k in zip(own[label < n].tolist(), rows[label[label < n]].tolist(), strict=True):
                a, b = self.top(x), self.top(k)
                self.up[max(a, b)] = min(a, b)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        pairs = [(x, t) for x in list(self.up) if (t := self.top(x)) != x]
        return np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)


def shared_before(lists: pa.ListArray, a: np.ndarray, b: np.ndarray, links: np.ndarray, own: int) -> np.ndarray:
    """Which of the linked pairs have a filter in common that comes before this one, in columns of at most 2,048 filters at a time."""
    rows, columns = np.flatnonzero(links.any(axis=1)), np.flatnonzero(links.any(axis=0))
    earlier = []
    for at in (a[rows], b[columns]):
        some = lists.take(pa.array(at))
        of, value = np.repeat(np.arange(len(at)), np.diff(some.offsets.to_numpy())), some.flatten().to_numpy()
        earlier.append((of[value < own], value[value < own]))
    common = np.intersect1d(earlier[0][1], earlier[1][1])
    out = np.zeros(links.shape, bool)
    met = np.zeros((len(rows), len(columns)), bool)
    for lo in range(0, len(common), 2048):
        part = common[lo : lo + 2048]
        held = []
        for (of, value), n in zip(earlier, (len(rows), len(columns)), strict=True):
            k = np.searchsorted(part, value)
            hit = (k < len(part)) & (part[np.minimum(k, len(part) - 1)] == value)
            m = np.zeros((n, len(part)), np.float32)
            m[of[hit], k[hit]] = 1
            held.append(m)
        met |= held[0] @ held[1].T > 0
    out[np.ix_(rows, columns)] = met
    return out


def _links_of(classes: DataFrame, dim: int, n: int, cosine: float) -> DataFrame:
    """(cid, n_links, component) for classes (cid, v, copies) of one length; component: a unit's number."""
    codes, angle = [ProductCode.plan(n, dim, cosine, seed=11 + k) for k in range(CODES)], math.acos(cosine)
    units = _units(classes, dim, n, angle)
    centres = classes.select(F.col("cid").alias("unit"), "v")
    heads = units.groupBy("unit").agg(F.max("far").alias("far"), F.sum("copies").alias("weight"), F.count("*").alias("members"))

    def filters(batches):
        for batch in batches:
            x = _matrix(column(batch, "v"), dim)
            unit = column(batch, "unit").to_numpy()
            for lo in range(0, len(x), 256):
                part = x[lo : lo + 256]
                for k, code in enumerate(codes):
                    row, f = code.decode(part)
                    # the nearest direction counts even where it does not exceed the bound
                    row, f = np.append(row, np.arange(len(part))), np.append(f, code.nearest(part))
                    yield pa.record_batch([pa.array(f * CODES + k), pa.array(unit[lo + row])], names=["filter", "unit"])

    # members, not centres, are looked up: a unit is met wherever one of its members is
    caps = stored(units.select("unit", "v").mapInArrow(filters, "filter long, unit long").distinct(), "caps")
    full = caps.groupBy("filter").count().where(F.col("count") > HOT_FILTER).select("filter", F.ceil(F.col("count") / HOT_FILTER).cast("int").alias("parts"))
    dealt = caps.join(full, "filter", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("unit"), F.col("parts")).cast("int"))
    dealt = dealt.select("filter", "unit", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select("filter", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "unit")
    # a vector alone in its unit brings its filters along: a pair of such counts in the least filter that both have, so that no pair needs to be written
    alone = heads.where("members = 1").select("unit")
    lists = caps.join(alone, "unit").groupBy("unit").agg(F.sort_array(F.collect_list("filter")).alias("filters"))
    shape = heads.join(centres, "unit").join(lists, "unit", "left").select("unit", "v", "far", "weight", "filters")
    rows = dealt.join(shape, "unit").repartition("filter", "lo", "hi").sortWithinPartitions("filter", "lo", "hi")

    def compare(batches):
        held, key = [], None
        for batch in batches:
            cols = [column(batch, c).to_numpy(zero_copy_only=False) for c in ("filter", "lo", "hi", "own", "unit", "far", "weight")]
            x = _matrix(column(batch, "v"), dim)
            lists = column(batch, "filters")
            edge = np.flatnonzero(np.concatenate([[True], (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0), [True]]))
            for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                now = (cols[0][a], cols[1][a], cols[2][a])
                if now != key and held:
                    yield from pairs(held, key)
                    held = []
                key = now
                held.append((cols[3][a:z], cols[4][a:z], cols[5][a:z], cols[6][a:z], x[a:z], lists[a:z]))
        if held:
            yield from pairs(held, key)

    def pairs(held, key):
        own, unit, far, weight, x = (np.concatenate([h[i] for h in held]) for i in range(5))
        lists = pa.concat_arrays([h[5].combine_chunks() if isinstance(h[5], pa.ChunkedArray) else h[5] for h in held])
        single = lists.is_valid().to_numpy(zero_copy_only=False)
        left = np.flatnonzero(own == key[1])
        right = np.flatnonzero(own == key[2])
        out, forest = np.zeros(len(x), np.int64), Forest()
        for lo in range(0, len(left), 512):
            a = left[lo : lo + 512]
            dot = x[a] @ x[right].T
            reach = far[a][:, None] + far[right][None, :]
            # only what can hold a link
            near = dot >= np.cos(np.minimum(math.pi, angle + reach + 1e-9))
            if key[1] == key[2]:
                near &= unit[a][:, None] < unit[right][None, :]
            both = single[a][:, None] & single[right][None, :]
            links = near & both & (dot >= cosine)
            if links.any():
                links &= ~shared_before(lists, a, right, links, key[0])
                out[a] += links @ weight[right]
                out[right] += weight[a] @ links
                forest.join(links, unit[a], unit[right])
            i, j = np.nonzero(near & ~both)
            if not len(i):
                continue
            d, r = dot[i, j], reach[i, j]
            whole = np.where(r == 0, d >= cosine, np.arccos(np.clip(d, -1, 1)) + r <= angle - 1e-9)
            keep = whole | (r > 0)
            i, j, whole = i[keep], j[keep], whole[keep]
            u, v = unit[a[i]], unit[right[j]]
            yield _met(np.minimum(u, v), np.maximum(u, v), np.where(whole, WHOLE, OPEN), np.zeros(len(u), np.int64))
        at = np.flatnonzero(out)
        if len(at):
            yield _met(unit[at], unit[at], np.full(len(at), COUNTED), out[at])
            u, v = forest.edges()
            yield _met(u, v, np.full(len(u), LINKED), np.zeros(len(u), np.int64))

    found = stored(rows.select("filter", "lo", "hi", "own", "unit", "far", "weight", "v", "filters").mapInArrow(compare, "a long, b long, kind int, w long"), "met")
    met = found.where(F.col("kind").isin(WHOLE, OPEN)).select("a", "b", "kind").distinct()
    whole = met.where(F.col("kind") == WHOLE).select("a", "b")
    # members of two units meet in one task, as rows of each and not as pairs; larger units in parts
    parts = heads.select("unit", F.ceil(F.col("members") / PART).cast("int").alias("n"))
    open_ = met.where(F.col("kind") == OPEN).select("a", "b")
    open_ = open_.join(parts.select(F.col("unit").alias("a"), F.col("n").alias("na")), "a").join(parts.select(F.col("unit").alias("b"), F.col("n").alias("nb")), "b")
    member = units.select("unit", "cid", "v", "copies")
    own = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = open_.join(member, open_["a"] == member["unit"]).select("a", "b", own("na").alias("i"), every("nb").alias("j"), F.lit(0).alias("side"), "cid", "v", "copies")
    right = open_.join(member, open_["b"] == member["unit"]).select("a", "b", every("na").alias("i"), own("nb").alias("j"), F.lit(1).alias("side"), "cid", "v", "copies")

    def count(batches):
        held, key = [], None
        for batch in batches:
            cols = [column(batch, c).to_numpy() for c in ("a", "b", "i", "j", "side", "cid", "copies")]
            x = _matrix(column(batch, "v"), dim)
            new = np.zeros(len(x), bool)
            for c in cols[:4]:
                new[1:] |= c[1:] != c[:-1]
            edge = [0, *np.flatnonzero(new).tolist(), len(x)]
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                if hi > lo:
                    now = tuple(int(c[lo]) for c in cols[:4])
                    if now != key and held:
                        yield from links(held, key)
                        held = []
                    key = now
                    held.append((cols[4][lo:hi], cols[5][lo:hi], cols[6][lo:hi], x[lo:hi]))
        if held:
            yield from links(held, key)

    def links(held, key):
        """How many vectors of the other side each member links with."""
        side, cid, copies, x = (np.concatenate([h[k] for h in held]) for k in range(4))
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        k = np.zeros(len(x), np.int64)
        for lo in range(0, len(one), 512):
            some = one[lo : lo + 512]
            met = x[some] @ x[two].T >= cosine
            k[some] += met @ copies[two]
            k[two] += copies[some] @ met
        at = np.flatnonzero(k)
        if len(at):
            yield pa.record_batch([pa.array(np.full(len(at), key[0])), pa.array(np.full(len(at), key[1])), pa.array(cid[at]), pa.array(k[at])], names=["a", "b", "cid", "k"])

    between = left.unionByName(right).repartition("a", "b", "i", "j").sortWithinPartitions("a", "b", "i", "j").mapInArrow(count, "a long, b long, cid long, k long")
    between = stored(between, "verified")
    weights = heads.select("unit", "weight")
    by_unit = whole.join(weights.withColumnRenamed("unit", "b"), "b").select(F.col("a").alias("unit"), "weight").unionByName(whole.join(weights.withColumnRenamed("unit", "a"), "a").select(F.col("b").alias("unit"), "weight"))
    by_unit = by_unit.unionByName(found.where(F.col("kind") == COUNTED).select(F.col("a").alias("unit"), F.col("w").alias("weight"))).groupBy("unit").agg(F.sum("weight").alias("out"))
    by_class = between.groupBy("cid").agg(F.sum("k").alias("more"))
    groups = components(whole.unionByName(between.select("a", "b").distinct()).unionByName(found.where(F.col("kind") == LINKED).select("a", "b")))
    counted = units.select("unit", "cid").join(weights, "unit").join(by_unit, "unit", "left").join(by_class, "cid", "left")
    counted = counted.select("unit", "cid", (F.col("weight") - 1 + F.coalesce("out", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_links"))
    return counted.join(groups, counted["unit"] == groups["node"], "left").select("cid", "n_links", F.coalesce("component", "unit").alias("component"))


def _units(classes: DataFrame, dim: int, n: int, angle: float) -> DataFrame:
    """(unit, cid, v, copies, far): every class in one unit; far: its angle to the centre, which is the vector of class `unit`.

    In each round, vectors (later: centres) that are nearest to the same direction are tried with the first of
    them by a hash as their centre. It is found with map-side combine, and is one row in the join that follows. Rounds go from few directions to
    as many as there are vectors: a group is gathered, before it is cut up, in the round in which it makes up much of its cell.
    """
    units = classes.select(F.col("cid").alias("unit"), "cid", "v", "copies", F.lit(0.0).alias("far"))
    for k in range(max(2, math.ceil(math.log(max(2, n), COARSE)))):
        coarse = ProductCode.of(COARSE ** (k + 1), dim, 0.0, seed=101 + k)

        def keys(batches, coarse=coarse):
            for batch in batches:
                yield pa.record_batch([column(batch, "unit"), column(batch, "v"), column(batch, "far"), pa.array(coarse.nearest(_matrix(column(batch, "v"), dim)))], names=["unit", "v", "far", "key"])

        heads = units.groupBy("unit").agg(F.max("far").alias("far")).join(classes.select(F.col("cid").alias("unit"), "v"), "unit").select("unit", "v", "far")
        keyed = stored(heads.mapInArrow(keys, "unit long, v array<double>, far double, key long"), "keys")
        low = keyed.groupBy("key").agg(F.min_by(F.struct("unit", "v"), F.xxhash64("unit")).alias("m")).select("key", F.col("m.v").alias("c"), F.col("m.unit").alias("centre"))

        def near(batches):
            for batch in batches:
                d = np.einsum("ij,ij->i", _matrix(column(batch, "v"), dim), _matrix(column(batch, "c"), dim))
                ok = np.arccos(np.clip(d, -1, 1)) + column(batch, "far").to_numpy() <= angle / 2 - 1e-9
                yield batch.select(["unit", "centre"]).filter(pa.array(ok))

        moves = keyed.join(low, "key").where("unit != centre").select("unit", "centre", "v", "far", "c").mapInArrow(near, "unit long, centre long")
        moved = units.join(moves, "unit", "left").select(F.coalesce("centre", "unit").alias("unit"), "cid", "v", "copies")
        to = moved.join(classes.select(F.col("cid").alias("unit"), F.col("v").alias("c")), "unit")

        def measure(batches):
            for batch in batches:
                d = np.einsum("ij,ij->i", _matrix(column(batch, "v"), dim), _matrix(column(batch, "c"), dim))
                far = np.where(column(batch, "unit").to_numpy() == column(batch, "cid").to_numpy(), 0.0, np.arccos(np.clip(d, -1, 1)))
                yield pa.record_batch([column(batch, c) for c in ("unit", "cid", "v", "copies")] + [pa.array(far)], names=["unit", "cid", "v", "copies", "far"])

        units = stored(to.mapInArrow(measure, "unit long, cid long, v array<double>, copies long, far double"), "units")
    return units
