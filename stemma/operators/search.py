"""Vector search: exact top-k, filters and label transfer."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scores import norm
from .dictionary import automaton_of

#: Queries that are sent to all tasks at once; more are searched in blocks of about this many.
MOST_BROADCAST = 20_000
#: Rows and bytes that the centres of an index are fitted on.
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 64 << 20
#: Vectors and queries whose products are worked out at once, and pairs that are then compared in full.
VECTOR_ROWS, QUERY_ROWS, PAIR_ROWS = 4_096, 512, 1 << 17
#: Rows of a section that meet others in one task.
PART_ROWS = 4_096
#: Sampled vectors that each list of an index stands for at least, and queries that the number of lists to look into is measured on.
LEAST_PER_LIST, MEASURED_QUERIES = 39, 200
#: Distinct words whose tokens a task keeps at once.
MOST_WORDS = 100_000


def clamp_k(k: int | None, most: int = 50, default: int = 5) -> int:
    return max(1, min(most, k or default))


def top_k(vectors: DataFrame, queries: DataFrame, k: int | None = 5, *, id_col: str = "vec_id", vec_col: str = "embedding", excluded: DataFrame | None = None, where: Column | None = None, unlike: tuple[str, str] | None = None) -> DataFrame:
    """The k most similar vectors of each query (query_id, query_vec): query_id, id_col, similarity, rank from 1.

    A query never finds itself. excluded: (query_id, id_col) pairs to leave out, as blocked ones are. unlike: columns of vectors and of queries; pairs in which they are equal are left out before they are ranked. Ties go to the smaller id.
    Vectors that are zero, null, hold nulls or are of another length have similarity 0. Queries are a stated set: up to MOST_BROADCAST of them go to all tasks, more are searched
    in blocks by a hash of their id. Vectors are dealt to all cores; each task holds k rows per query (and as many more as a query has excluded ones), and gives no more.
    """
    k = clamp_k(k)
    blocks = max(1, -(-queries.count() // MOST_BROADCAST))
    of = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    more = 0 if excluded is None else excluded.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    mine = F.col(unlike[0]) if unlike else F.lit(None).cast("int")
    base = vectors.where(F.lit(True) if where is None else where).where(F.col(id_col).isNotNull()).select(F.col(id_col), F.col(vec_col).cast("array<double>").alias("__v"), mine.alias("__mine"))
    base = base.repartition(2 * vectors.sparkSession.sparkContext.defaultParallelism, id_col)
    theirs = F.col(unlike[1]) if unlike else F.lit(None).cast("int")
    asked = queries.where("query_id IS NOT NULL").select("query_id", F.col("query_vec").cast("array<double>").alias("query_vec"), theirs.alias("__theirs"))
    found = reduce(DataFrame.unionByName, [_nearest(base, asked.where(of == b), k + more, id_col) for b in range(blocks)])
    if excluded is not None:
        found = found.join(excluded, ["query_id", id_col], "left_anti")
    order = W.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col(id_col))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class _Sides:
    """Vectors prepared for comparison: m (void rows, which are null, hold nulls or are of another length, are zero), size (their norms), unit (for products that tell how similar they may be) and odd (not finite, or too large or small for that)."""

    def __init__(self, column: pa.Array, dim: int):
        lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(lengths == dim)
        flat = column.take(pa.array(at)).flatten()
        void = np.zeros(len(column), bool)
        void[lengths != dim] = True
        void[at[~pc.is_valid(flat).to_numpy(zero_copy_only=False).reshape(len(at), dim).all(axis=1)]] = True
        self.m = np.zeros((len(column), dim))
        self.m[at] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False).reshape(len(at), dim)
        self.m[void], self.void = 0, void
        with np.errstate(all="ignore"):
            self.size = np.sqrt(_dots(self.m, self.m))
            self.odd = ~np.isfinite(self.m).all(axis=1) | (self.size > 1e70) | ((self.size < 1e-70) & (self.m != 0).any(axis=1))
            self.unit = np.where((self.odd | (self.size == 0))[:, None], 0.0, self.m / np.where(self.size == 0, 1, self.size)[:, None])


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scalar products of rows, added up from the first component to the last, as scores.dot() does."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str) -> DataFrame:
    """(query_id, id_col, similarity) of each task's k best vectors (id_col, __v, __mine) of one block of queries (query_id, query_vec, __theirs).

    A product of matrices tells which pairs can be among the best; these are worked out component by component, so that equal vectors are equally similar.
    """
    part = queries.toArrow()
    vecs = part.column("query_vec").combine_chunks()
    names, labels = part.column("query_id").to_pylist(), part.column("__theirs").to_pylist()
    sent = vectors.sparkSession.sparkContext.broadcast((vecs, names, labels))
    shape = pa.schema([pa.field("query_id", part.schema.field("query_id").type), pa.field(id_col, _arrow_type(vectors, id_col)), pa.field("similarity", pa.float64())])
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {id_col} {vectors.schema[id_col].dataType.simpleString()}, similarity double"

    def run(batches):
        vecs, names, labels = sent.value
        code: dict = {}
        theirs = np.array([-1 if v is None else code.setdefault(v, len(code)) for v in labels], np.int64)
        place: dict = {}
        for i, name in enumerate(names):
            place.setdefault(name, []).append(i)
        dims = [d for d in pc.unique(pc.list_value_length(vecs)).to_pylist() if d]
        # queries of a length are compared with vectors made for it; those without one, or empty, are similar to nothing
        length = pc.fill_null(pc.list_value_length(vecs), 0).to_numpy(zero_copy_only=False)
        groups = [(d, np.flatnonzero(length == d)) for d in [*dims, 0] if (length == d).any()]
        sides = {d: _Sides(vecs.take(pa.array(at)), max(d, 1)) for d, at in groups}
        best = _Best(len(names), k)
        for batch in batches:
            ordered = batch.take(pc.sort_indices(batch.column(0)))
            for lo in range(0, batch.num_rows, VECTOR_ROWS):
                some = ordered.slice(lo, VECTOR_ROWS)
                ids = some.column(0).to_pylist()
                mine = np.array([-2 if v is None else code.get(v, -3) for v in some.column(2).to_pylist()], np.int64)
                for dim, at in groups:
                    rows = _Sides(some.column(1), max(dim, 1))
                    keep = _few_copies(rows.m, mine, k + 1) if len(set(ids)) == len(ids) else np.arange(len(ids))
                    own = {j: place[ids[i]] for j, i in enumerate(keep.tolist()) if ids[i] in place}
                    for q in range(0, len(at), QUERY_ROWS):
                        best.meet(at[q : q + QUERY_ROWS], sides[dim], slice(q, q + QUERY_ROWS), rows, keep, mine[keep], theirs, own, ids)
        r, c = np.nonzero(best.filled)
        yield pa.RecordBatch.from_pydict({"query_id": [names[i] for i in r], id_col: best.ids[r, c].tolist(), "similarity": best.sims[r, c]}, schema=shape)

    return vectors.mapInArrow(run, kinds)


def _few_copies(m: np.ndarray, label: np.ndarray, most: int) -> np.ndarray:
    """The rows but those that come after `most` others with the same components and label."""
    whole = np.ascontiguousarray(np.hstack([m, label[:, None].astype(float)]))
    of = np.unique(whole.view(np.dtype((np.void, whole.shape[1] * 8))).ravel(), return_inverse=True)[1].ravel()
    order = np.argsort(of, kind="stable")
    first = np.concatenate([[True], np.diff(of[order]) != 0])
    nth = np.empty(len(of), np.int64)
    nth[order] = np.arange(len(of)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    return np.flatnonzero(nth < most)


class _Best:
    """The k most similar vectors of each query so far: larger similarity (not a number is the largest, as in Spark), then smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.sims, self.ids, self.filled = np.full((queries, k), -np.inf), np.full((queries, k), None, object), np.zeros((queries, k), bool)

    def meet(self, who: np.ndarray, asked: _Sides, part: slice, rows: _Sides, keep: np.ndarray, mine: np.ndarray, theirs: np.ndarray, own: dict[int, list[int]], ids: list) -> None:
        """Queries `who` (rows `part` of asked) meet the rows `keep` of vectors. own: the queries that such a row is itself."""
        may = asked.unit[part] @ rows.unit[keep].T
        may[asked.odd[part]] = np.inf
        may[:, rows.odd[keep]] = np.inf
        may[theirs[who][:, None] == mine] = -np.inf
        for j, several in own.items():
            for i in several:
                at = int(np.searchsorted(who, i))
                if at < len(who) and who[at] == i:
                    may[at, j] = -np.inf
        least = np.where(self.filled[who, -1], np.where(np.isnan(self.sims[who, -1]), np.inf, self.sims[who, -1]), -2.0)
        if (least == -2.0).any() and may.shape[1] > self.k:
            least = np.maximum(least, np.partition(may, -self.k, axis=1)[:, -self.k])
        i, j = np.nonzero((may >= least[:, None] - 1e-9) & (may > -np.inf))
        for lo in range(0, len(i), PAIR_ROWS):
            self._add(who, asked, part, rows, keep, i[lo : lo + PAIR_ROWS], j[lo : lo + PAIR_ROWS], ids)

    def _add(self, who, asked, part, rows, keep, i, j, ids) -> None:
        a, b = i + part.start, keep[j]
        with np.errstate(all="ignore"):
            size = rows.size[b] * asked.size[a]
            sim = np.where(((size > 0) | np.isnan(size)) & ~rows.void[b] & ~asked.void[a], _dots(rows.m[b], asked.m[a]) / np.where(size == 0, 1, size), 0.0)
        some = np.unique(who[i])
        old_q, old_c = np.nonzero(self.filled[some])
        q = np.concatenate([who[i], some[old_q]])
        sims = np.concatenate([sim, self.sims[some[old_q], old_c]])
        name = np.concatenate([_objects(ids)[b], self.ids[some[old_q], old_c]])
        rank = np.empty(len(name), np.int64)
        rank[np.argsort(name, kind="stable")] = np.arange(len(name))
        order = np.lexsort((rank, -np.where(np.isnan(sims), np.inf, sims), q))
        first = np.concatenate([[True], np.diff(q[order]) != 0])
        nth = np.arange(len(q)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        order, nth = order[nth < self.k], nth[nth < self.k]
        self.sims[q[order], nth], self.ids[q[order], nth], self.filled[q[order], nth] = sims[order], name[order], True


def _objects(values: list) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, which rows they are of): rows that are null, zero, of another length or not finite are left out."""
    same = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    rows = np.flatnonzero(same.to_numpy(zero_copy_only=False))
    m = np.array(column.filter(same).flatten().to_numpy(zero_copy_only=False), float).reshape(len(rows), dim)
    top = np.abs(m).max(axis=1, initial=0.0)
    fine = np.isfinite(top) & (top > 0)
    m = m[fine] / top[fine, None]
    return m / np.linalg.norm(m, axis=1, keepdims=True), rows[fine]


def fit_centres(vectors: DataFrame, lists: int = 100, *, id_col: str = "vec_id", vec_col: str = "embedding", rounds: int = 10) -> np.ndarray:
    """Directions that an index files vectors under: spherical k-means over a bounded sample.

    The sample is the SAMPLE_ROWS rows whose ids have the smallest hashes, or as many as SAMPLE_BYTES hold. Without a usable vector there are no centres.
    """
    first = vectors.select(F.max(F.size(vec_col))).first()[0]
    dim = first if first and first > 0 else 0
    if not dim:
        return np.zeros((0, 0))
    some = vectors.where(F.size(vec_col) == dim).select(F.col(vec_col).cast("array<double>").alias("v"), F.xxhash64(id_col).alias("h")).orderBy("h").limit(min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    m, _ = _matrix(some.toArrow().column("v").combine_chunks(), dim)
    centres = m[np.linspace(0, len(m) - 1, min(lists, -(-len(m) // LEAST_PER_LIST))).astype(int)]
    for _ in range(rounds if len(m) else 0):
        at = np.argmax(m @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, at, m)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 0, total / np.maximum(size, 1e-300), centres)
    return centres


def index_vectors(vectors: DataFrame, centres: np.ndarray, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Every vector with the list it is filed under (id_col, vec_col, list): its nearest centre; -1 for vectors that cannot be searched. Store it by `list` to let searches skip files."""
    base = vectors.select(F.col(id_col), F.col(vec_col).cast("array<double>").alias(vec_col))
    sent = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        c = sent.value
        for batch in batches:
            at = np.full(batch.num_rows, -1, np.int32)
            m, rows = _matrix(batch.column(1), c.shape[1]) if len(c) else (None, [])
            if len(rows):
                at[rows] = np.argmax(m @ c.T, axis=1)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(at)], names=[id_col, vec_col, "list"])

    return base.mapInArrow(run, f"{id_col} {base.schema[id_col].dataType.simpleString()}, {vec_col} array<double>, list int")


def measured_probes(indexed: DataFrame, queries: DataFrame, centres: np.ndarray, k: int | None = 5, *, recall: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> int:
    """The fewest lists to look into that give this share of the exact neighbours of MEASURED_QUERIES queries (those with the smallest hashes of their ids); all of them if nothing can be measured."""
    some = queries.orderBy(F.xxhash64("query_id")).limit(MEASURED_QUERIES)
    exact = search_index(indexed, some, centres, k, probes=max(1, len(centres)), id_col=id_col, vec_col=vec_col).select("query_id", id_col)
    # at most k rows for each measured query
    met = indexed.select(id_col, "list").join(F.broadcast(exact), id_col).join(F.broadcast(some), "query_id").select("list", F.col("query_vec").cast("array<double>").alias("q")).toArrow()
    if not met.num_rows:
        return max(1, len(centres))
    q, rows = _matrix(met.column("q").combine_chunks(), centres.shape[1])
    order = np.argsort(np.argsort(-(q @ centres.T), axis=1), axis=1)
    place = np.sort(order[np.arange(len(q)), met.column("list").to_numpy()[rows]])
    return int(place[max(0, int(np.ceil(recall * len(place))) - 1)]) + 1


def search_index(indexed: DataFrame, queries: DataFrame, centres: np.ndarray, k: int | None = 5, *, probes: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Approximate top_k(): each query (query_id, query_vec) is compared with the vectors of its `probes` nearest lists.

    As many probes as lists give the exact answer; vectors of equal similarity may stand for each other at the end of a list. Queries go to all tasks in
    blocks of about MOST_BROADCAST; each task holds k rows per query of a block, and gives no more.
    """
    k = clamp_k(k)
    kind = indexed.schema[id_col].dataType.simpleString()
    asked = queries.select(F.col("query_id"), F.col("query_vec").cast("array<double>").alias("query_vec"))
    blocks = max(1, -(-asked.count() // MOST_BROADCAST))
    found = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        q, rows = _matrix(part.column("query_vec").combine_chunks(), centres.shape[1]) if len(centres) else (np.zeros((0, 0)), [])
        ids = [part.column("query_id")[int(i)].as_py() for i in rows]
        near = np.argsort(-(q @ centres.T), axis=1)[:, :probes] if len(ids) else np.zeros((0, 0), int)
        sent = indexed.sparkSession.sparkContext.broadcast((q, ids, near))

        def run(batches, sent=sent):
            q, ids, near = sent.value
            of_list = {c: np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near).tolist()}
            place: dict = {}
            for i, name in enumerate(ids):
                place.setdefault(name, []).append(i)
            best, names = np.full((len(ids), k), -np.inf), np.full((len(ids), k), None, object)
            for batch in batches:
                lists = batch.column(2).to_numpy(zero_copy_only=False)
                for c in np.unique(lists).tolist():
                    at = np.flatnonzero(lists == c)
                    who = of_list.get(c)
                    if who is None:
                        continue
                    m, fine = _matrix(batch.column(1).take(pa.array(at)), q.shape[1])
                    own = np.array([batch.column(0)[int(i)].as_py() for i in at[fine]] + [None], object)[:-1]
                    for lo in range(0, len(who), 1024):
                        some = who[lo : lo + 1024]
                        s = q[some] @ m.T
                        where = {int(w): i for i, w in enumerate(some)}
                        for j, name in enumerate(own):
                            for w in place.get(name, ()):
                                if w in where:
                                    s[where[w], j] = -np.inf
                        all_s = np.hstack([best[some], s])
                        top = np.argsort(-all_s, axis=1, kind="stable")[:, :k]
                        all_n = np.hstack([names[some], np.broadcast_to(own, (len(some), len(own)))])
                        best[some], names[some] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_n, top, 1)
            r, c = np.nonzero(np.isfinite(best))
            yield pa.RecordBatch.from_pydict({"query_id": [ids[i] for i in r], id_col: names[r, c].tolist(), "similarity": best[r, c]}, schema=shape)

        shape = pa.schema([pa.field("query_id", part.schema.field("query_id").type), pa.field(id_col, _arrow_type(indexed, id_col)), pa.field("similarity", pa.float64())])
        block = indexed.select(id_col, vec_col, "list").mapInArrow(run, f"query_id {asked.schema['query_id'].dataType.simpleString()}, {id_col} {kind}, similarity double")
        found = block if found is None else found.unionByName(block)
    order = W.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col(id_col))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    return df.select(column).limit(0).toArrow().schema.field(column).type


def transfer_labels(vectors: DataFrame, labelled: Column, label_col: str, section_col: str, *, k: int = 3, least: float = 0.82, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each row without a label, that of its most similar labelled one in its section among the k nearest of at least `least`.

    Both sides of a section are cut into parts of about PART_ROWS rows; each pair of parts meets in one task, which keeps k rows per open one, so a hot section is
    many tasks and no pair is written. Similarities are compared to twelve places, ties go to the smaller id; vectors that are null, zero, not finite or of
    another length are similar to nothing.
    """
    base = vectors.where(F.col(section_col).isNotNull()).select(F.col(section_col).alias("s"), F.col(id_col).alias("i"), F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).alias("l"), labelled.alias("has")).where("has is not null")
    # one row a section
    parts = base.groupBy("s").agg(*[F.greatest(F.lit(1), F.ceil(F.count_if(c) / PART_ROWS)).cast("int").alias(n) for n, c in (("open_parts", ~F.col("has")), ("some_parts", F.col("has")))])
    rows = base.join(parts, "s")
    of = lambda n: F.pmod(F.xxhash64("i"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    open_ = rows.where("not has").select("s", of("open_parts").alias("a"), every("some_parts").alias("b"), "i", "v")
    some = rows.where("has").select(F.col("s").alias("s2"), every("open_parts").alias("a2"), of("some_parts").alias("b2"), F.col("i").alias("from_id"), F.col("v").alias("from_v"), F.col("l").alias("label"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        lv, rv = left.column("v").combine_chunks(), right.column("from_v").combine_chunks()
        ids, mine, theirs, sims = right.column("from_id"), [], [], []
        for dim in filter(None, pc.unique(pc.list_value_length(lv)).to_pylist()):
            (q, at), (m, of) = _matrix(lv, dim), _matrix(rv, dim)
            rank = np.empty(len(of), np.int64)
            rank[pc.array_sort_indices(ids.take(pa.array(of)).combine_chunks()).to_numpy()] = np.arange(len(of))
            for lo in range(0, len(at), 512):
                s = np.round(q[lo : lo + 512] @ m.T, 12)
                for r, row in enumerate(s):
                    good = np.flatnonzero(row >= least)
                    good = good[np.lexsort((rank[good], -row[good]))[:k]]
                    mine.append(np.full(len(good), at[lo + r])), theirs.append(of[good]), sims.append(row[good])
        flat = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0, t))
        mine, theirs = flat(mine, np.int64), flat(theirs, np.int64)
        return pa.table({"i": left.column("i").take(mine), "from_id": ids.take(theirs), "l": right.column("label").take(theirs), "similarity": flat(sims, float)})

    kind = {f.name: f.dataType.simpleString() for f in base.schema}
    near = open_.groupBy("s", "a", "b").cogroup(some.groupBy("s2", "a2", "b2")).applyInArrow(meet, f"i {kind['i']}, from_id {kind['i']}, l {kind['l']}, similarity double")
    order = W.partitionBy("i").orderBy(F.col("similarity").desc(), F.col("from_id"))
    best = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    return best.groupBy(F.col("i").alias(id_col)).agg(F.min_by("l", "n").alias("label"), F.max("similarity").alias("similarity"), F.count("*").alias("neighbours"))


def check_vectors(vectors: DataFrame, dim: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows that cannot be searched, and why: no vector, wrong length, missing or non-finite parts, zero norm."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    reason = F.when(v.isNull(), "MISSING").when(F.size(v) != dim, "LENGTH").when(bad, "NOT_FINITE").when(norm(v) == 0, "ZERO")
    return vectors.select(id_col, reason.alias("reason")).where("reason is not null")


def upsert_vectors(stored: DataFrame, incoming: DataFrame, keys: list[str], hash_col: str = "text_hash") -> DataFrame:
    """What each incoming row would do: CREATE, UPDATE (another text hash) or SKIP. Incoming rows are one per key."""
    old = stored.select(*keys, F.col(hash_col).alias("__old"), F.lit(True).alias("__known"))
    action = F.when(~F.coalesce("__known", F.lit(False)), "CREATE").when(~F.col(hash_col).eqNullSafe(F.col("__old")), "UPDATE").otherwise("SKIP")
    return incoming.join(old, keys, "left").withColumn("action", action).drop("__old", "__known")


def partial_hits(docs: DataFrame, queries: DataFrame, *, id_col: str = "doc_id", query_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(query_col, id_col, hit) of each query and text that holds any of its tokens: the share of the query's tokens, repeats included, that it holds.

    Tokens are what white space surrounds in a query, so one that a text holds lies within a word of it: each distinct word is searched
    once while it stays in a cache, new words of many texts in one go. Queries are a stated set: up to MOST_BROADCAST of them go to all tasks, more in blocks by a hash of
    their id and text, each with a pass over the texts; nothing is shuffled.
    """
    blocks = max(1, -(-queries.count() // MOST_BROADCAST))
    of = F.pmod(F.xxhash64(query_col, text_col), F.lit(blocks))
    parts = [_partial_hits(docs, queries.where(of == b), id_col, query_col, text_col) for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def _partial_hits(docs: DataFrame, queries: DataFrame, id_col: str, query_col: str, text_col: str) -> DataFrame:
    """As above, for one block of queries."""
    asked = queries.select(F.col(query_col).alias("q"), F.col(text_col).cast("string").alias("text")).toArrow()
    own = [(t or "").split() for t in asked.column("text").to_pylist()]
    some = [i for i, w in enumerate(own) if w]
    names = asked.column("q").combine_chunks().take(pa.array(some, pa.int64()))
    number: dict[str, int] = {}
    flat = np.array([number.setdefault(w, len(number)) for i in some for w in own[i]], np.int64)
    size = np.array([len(own[i]) for i in some], np.int64)
    begin = np.cumsum(size) - size
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, list(number), flat, size, begin, names))
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kinds = f"q {queries.schema[query_col].dataType.simpleString()}, id {base.schema['id'].dataType.simpleString()}, hit double"

    def run(batches):
        name, own, flat, size, begin, names = sent.value
        found, none = automaton_of(name, own), np.zeros(0, np.int64)
        cache: dict[str, np.ndarray] = {}

        def look(words: set[str]) -> None:
            """Tokens of all words that the cache lacks, looked for in one go."""
            new = [w for w in words if w not in cache]
            if len(cache) + len(new) > MOST_WORDS:
                cache.clear()
                new = list(words)
            cache.update(dict.fromkeys(new, none))
            cache.update((new[i], held) for i, held in found.texts(new))

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo in range(0, batch.num_rows if len(size) else 0, 256):
                of, row, rate = [], [], []
                words = [set((t.as_py() or "").split()) for t in texts[lo : lo + 256]]
                look(set().union(*words))
                for r, mine in enumerate(words, lo):
                    held = np.zeros(len(own), bool)
                    held[np.concatenate([none, *map(cache.__getitem__, mine)])] = True
                    n = np.add.reduceat(held[flat], begin, dtype=np.int64)
                    at = np.flatnonzero(n)
                    of.append(at), row.append(np.full(len(at), r)), rate.append(n[at] / size[at])
                yield pa.record_batch([names.take(pa.array(np.concatenate(of))), ids.take(pa.array(np.concatenate(row))), pa.array(np.concatenate(rate))], names=["q", "id", "hit"])

    return base.mapInArrow(run, kinds).select(F.col("q").alias(query_col), F.col("id").alias(id_col), F.round("hit", 6).alias("hit"))
