"""Substring deduplication with a log-structured index of window fingerprints.

The log. Each batch of documents becomes one immutable run in the shared folder: the fingerprints of its windows, sorted and bucketed by
value, listed in a manifest. A new batch is merge-joined with the runs before it; as many runs of one level as FANOUT are compacted to one of the next. A
window's fingerprint is the least hash among its grams of GRAM words (winnowing: Schleimer, Wilkerson, Aiken,
"Winnowing: Local Algorithms for Document Fingerprinting"). It depends on the window's words alone, so equal windows always
agree on it, and neighbouring windows mostly share one: a run holds about one value in seven words.

Verification. Windows whose fingerprint was met more than once are compared by a 96-bit hash of all their words; the earliest
keeps its words. Which windows to compare is asked of a bit sketch of the repeated fingerprints; it has a fixed
greatest size and no false negatives, so a full sketch costs time and never changes the result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from ._arrow import NOT_SPACE, column, gram_hashes, padded, row_of, slices, text_buffer, word_hashes, words
from ._tables import bounded_batches, new_path, remove

#: Words of a gram whose hash can be a window's fingerprint.
GRAM = 8
#: The sketch's most bits; 16 MB. A larger one keeps verification selective for more repeated fingerprints.
SKETCH_BITS = 27
#: Windows or fingerprints that a task holds before it makes them unique and sends them on.
MOST_WINDOWS = 400_000
#: Parts into which a task cuts its windows at most.
MOST_BUCKETS = 1 << 14
#: Runs of one level that are merged to one of the next.
FANOUT = 3
#: Batches of a table that is not added to an earlier log: enough for compaction.
BATCHES = FANOUT + 2
#: Windows that a task decides, and texts that a task cuts, about; where there are more, there are more tasks.
TASK_WINDOWS, TASK_TEXTS = 4_000_000, 200_000


def _slide(x: np.ndarray, k: int, op) -> np.ndarray:
    """op over each k values in a row, by doubling; len(x) - k + 1 values."""
    out, size, power, width, rest = None, 0, x, 1, k
    while rest:
        if rest & 1:
            out, size = (power, width) if out is None else (op(out[: len(x) - size - width + 1], power[size : size + len(x) - size - width + 1]), size + width)
        rest >>= 1
        if rest:
            power = op(power[:-width], power[width:])
            width *= 2
    return out


class Windows:
    """The windows of a slice of texts and their fingerprints."""

    def __init__(self, data: np.ndarray, off: np.ndarray, width: int):
        self.buf, self.width = padded(data), width
        self.s, self.e, self.first = words(data, off, NOT_SPACE)
        self.h = word_hashes(self.buf, self.s, self.e)
        gram = min(GRAM, width)
        n = len(self.h)
        if n < width:
            self.start = np.empty(0, np.int64)
            return
        end = np.repeat(self.first[1:], np.diff(self.first))
        fits = np.arange(n - width + 1) + width <= end[: n - width + 1]
        self.gram = gram_hashes(self.h, gram)
        least = _slide(self.gram, width - gram + 1, np.minimum)
        self.start = np.flatnonzero(fits)
        self.least = least[self.start]
        self.every, self.fits, self.span = least, fits, width - gram + 1

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """The hash of every gram that is the least of some window, and its text: once for each place, so repeats within a text count."""
        if not len(self.start):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        at_most = np.concatenate([np.zeros(self.span - 1, np.uint64), np.where(self.fits, self.every, 0), np.zeros(self.span - 1, np.uint64)])
        at = np.flatnonzero(self.gram == _slide(at_most, self.span, np.maximum))
        return self.gram[at], np.searchsorted(self.first, at, "right") - 1

    def digests(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of the windows from these words on."""
        second = word_hashes(self.buf, self.s, self.e, seed=0x5D588B65)
        return gram_hashes(self.h, self.width)[which], gram_hashes(second, self.width)[which]


class FingerprintLog:
    """Sorted immutable runs of window fingerprints, bucketed files in a folder that all executors share.

    The folder holds a folder for each run and a manifest, a table to which each version adds a row: the runs in force, with
    their levels. A run counts once the manifest lists it, so an append that dies leaves the log as it was. Opening the
    folder again, in any session, goes on where it stood.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.path = (path or new_path(spark, "log")).rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version, self.runs = 0, []
        last = self._manifest()
        if last is not None:
            self.version, self.buckets = last.version, last.buckets
            self.runs = [(r.name, r.level) for r in last.runs]

    def _manifest(self):
        try:
            return self.spark.read.schema("version long, buckets int, runs array<struct<name: string, level: int>>").parquet(f"{self.path}/manifest").orderBy(F.desc("version")).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _commit(self, runs: list[tuple[str, int]]) -> None:
        row = self.spark.createDataFrame([(self.version + 1, self.buckets, runs)], "version long, buckets int, runs array<struct<name: string, level: int>>")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        self.version, self.runs = self.version + 1, runs

    def _write(self, df: DataFrame) -> str:
        """A run of (h, again, known); its table is only a handle for the time of writing."""
        run, table = f"run-{uuid.uuid4().hex}", f"stemma_run_{uuid.uuid4().hex}"
        try:
            # dealt by h already, by the hash that buckets use: one file a bucket, sorted on writing
            df.write.bucketBy(self.buckets, "h").sortBy("h").format("parquet").option("path", f"{self.path}/{run}").saveAsTable(table)
        finally:
            self.spark.sql(f"drop table if exists {table}")
        return run

    def _read(self, run: str) -> DataFrame:
        """A run by its buckets: a handle is made for the plan to see them, and goes again; the files are not its own."""
        table, at = f"stemma_run_{uuid.uuid4().hex}", f"{self.path}/{run}".replace("'", "\\'")
        self.spark.sql(f"create table {table} (h bigint, again boolean, known boolean) using parquet clustered by (h) sorted by (h) into {self.buckets} buckets location '{at}'")
        try:
            return self.spark.table(table)
        finally:
            self.spark.sql(f"drop table if exists {table}")

    def history(self) -> DataFrame | None:
        """All values of the runs in force, each once per run."""
        every = None
        for run, _ in self.runs:
            some = self._read(run).select("h")
            every = some if every is None else every.unionByName(some)
        return every

    def append(self, values: DataFrame) -> DataFrame:
        """Add a batch: values (h long, again boolean: more than one place). Returns those that repeat, here or in history."""
        now = values.groupBy("h").agg((F.count("*") > 1).alias("many"), F.max("again").alias("again")).select("h", F.expr("many or again").alias("again"))
        # one run after another, so that each is read bucket by bucket in its order
        met = F.lit(False)
        for i, (run, _) in enumerate(self.runs):
            now = now.join(self._read(run).select("h", F.lit(True).alias(f"r{i}")), "h", "left")
            met = met | F.coalesce(F.col(f"r{i}"), F.lit(False))
        run = self._write(now.select("h", (F.col("again") | met).alias("again"), met.alias("known")))
        self._commit([*self.runs, (run, 0)])
        again = self._read(run).where("again").select("h")
        self.compact()
        return again

    def compact(self) -> None:
        """Merge the runs of a level to one of the next, as long as there are `fanout` of them. What was merged stays until vacuum() or drop(), as plans may still read it."""
        level = 0
        while level <= max((at for _, at in self.runs), default=-1):
            own = [run for run, at in self.runs if at == level]
            if len(own) >= self.fanout:
                every = None
                for run in own:
                    some = self._read(run).where("not known").select("h")
                    every = some if every is None else every.unionByName(some)
                # a value is new in one run only; one of an older level stays there
                merged = self._write(every.repartition(self.buckets, "h").select("h", F.lit(False).alias("again"), F.lit(False).alias("known")))
                self._commit([r for r in self.runs if r[1] != level] + [(merged, level + 1)])
            level += 1

    def vacuum(self) -> None:
        """Delete the runs that the manifest no longer lists."""
        in_force = {run for run, _ in self.runs}
        rows = self.spark.read.parquet(f"{self.path}/manifest").select(F.explode("runs.name").alias("run")).distinct().collect()  # one row for each append
        for r in rows:
            if r.run not in in_force:
                remove(self.spark, f"{self.path}/{r.run}")

    def drop(self) -> None:
        remove(self.spark, self.path)
        self.version, self.runs = 0, []


def _sketch(values: DataFrame, most_bits: int, n: int) -> tuple[np.ndarray, int]:
    """A bitmap of the top bits of all n values of column h. What reaches the driver is bounded by its size."""
    bits = max(10, min(most_bits, int(16 * max(n, 1)).bit_length()))
    parts = values.select(F.shiftrightunsigned("h", 64 - bits).alias("at")).select(F.shiftright("at", 5).alias("w"), F.expr("shiftleft(1, cast(at & 31 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))

    def pack(batches):
        for batch in batches:
            w, b = (batch.column(i).to_numpy(zero_copy_only=False).astype(t) for i, t in ((0, "<i4"), (1, "<i4")))
            yield pa.record_batch([pa.array([w.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], names=["w", "b"])

    sketch = np.zeros(1 << (bits - 5), np.int32)
    for r in parts.mapInArrow(pack, "w binary, b binary").toLocalIterator():
        sketch[np.frombuffer(r.w, "<i4")] = np.frombuffer(r.b, "<i4")
    return sketch.view(np.uint32), bits


def repeated_windows(docs: DataFrame, width: int = 20, batches: int = BATCHES, sketch_bits: int = SKETCH_BITS, log: FingerprintLog | None = None, history: DataFrame | None = None) -> DataFrame:
    """Windows that also start earlier, packed: group, and of its texts ids and digests; doc (place among them) and start of each window.

    docs: id, text, digest (of the text) and group (an int that id and digest decide). A group has a row for each task that found some.
    history: the documents (id, text) whose windows `log` holds already; they come before all of docs, and get no rows.
    """
    spark = docs.sparkSession
    own, log = log is None, log or FingerprintLog(spark)

    def fingerprints(record_batches):
        found, size = [], 0
        for batch in record_batches:
            data, off = text_buffer(column(batch, "text"))
            part = column(batch, "batch").to_numpy()
            for lo, hi in slices(off):
                h, row = Windows(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], width).fingerprints()
                found.append((part[lo + row], h))
                size += len(h)
            if size >= MOST_WINDOWS:
                yield from unique(found)
                found, size = [], 0
        if found:
            yield from unique(found)

    def unique(found):
        part, h = (np.concatenate([x[i] for x in found]) for i in range(2))
        for k in np.unique(part).tolist():
            value, n = np.unique(h[part == k], return_counts=True)
            yield from pa.table([pa.array(np.full(len(value), k, np.int32)), pa.array(value.view(np.int64)), pa.array(n > 1)], names=["batch", "h", "again"]).to_batches(max_chunksize=100_000)

    # every text is read once; batches are dealt by a hash, whatever the type of ids
    dealt = docs.select("text", F.pmod(F.xxhash64("id", "digest"), F.lit(batches)).cast("int").alias("batch")).mapInArrow(fingerprints, "batch int, h long, again boolean")
    path = new_path(spark, "batches")
    dealt.write.partitionBy("batch").parquet(path)
    values = spark.read.schema("h long, again boolean, batch int").parquet(path)
    repeats = None
    for k in range(batches):
        again = log.append(values.where(F.col("batch") == k).select("h", "again"))
        repeats = again if repeats is None else repeats.unionByName(again)
    many = repeats.count()
    sketch, bits = _sketch(repeats, sketch_bits, many)
    if own:
        log.drop()
    remove(spark, path)
    if history is not None:
        docs = docs.unionByName(history.select("id", "text", F.xxhash64("text").alias("digest"), F.lit(-1).alias("group")))
    sent = spark.sparkContext.broadcast(sketch)
    kind = docs.schema["id"].dataType
    ids_type = T.ArrayType(kind)
    # a fingerprint stands for some seven windows, and each is met in two tasks or more
    buckets = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 20 * many // TASK_WINDOWS), MOST_BUCKETS)
    packed = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("ids", ids_type), T.StructField("digests", T.ArrayType(T.LongType())), T.StructField("groups", T.ArrayType(T.IntegerType())), *(T.StructField(c, T.BinaryType()) for c in ("w1", "w2", "doc", "start"))])

    def compare(record_batches):
        """Windows to compare, by bucket of their hash. Of those that a task holds more than once only the first goes on."""
        bitmap = sent.value
        held, ids, digests, groups, rows, size = [], [], [], [], 0, 0
        for batch in record_batches:
            data, off = text_buffer(column(batch, "text"))
            for lo, hi in slices(off):
                one = Windows(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], width)
                if not len(one.start):
                    continue
                at = (one.least >> np.uint64(64 - bits)).astype(np.int64)
                which = one.start[(bitmap[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1)).astype(bool)]
                if len(which):
                    a, b = one.digests(which)
                    r = row_of(one.first)[which]
                    held.append((a, (b >> np.uint64(32)).astype(np.uint32), (r + lo + rows).astype(np.int64), which - one.first[r]))
                    size += len(which)
            # copies, as slices would keep the batch's texts
            ids.append(pa.array(column(batch, "id").to_pylist(), column(batch, "id").type))
            digests.append(column(batch, "digest").to_numpy(zero_copy_only=False).copy())
            groups.append(column(batch, "group").to_numpy(zero_copy_only=False).copy())
            rows += batch.num_rows
            if size >= MOST_WINDOWS:
                yield from deal(held, ids, digests, groups)
                held, ids, digests, groups, rows, size = [], [], [], [], 0, 0
        if held:
            yield from deal(held, ids, digests, groups)

    def deal(held, ids, digests, groups):
        w1, w2, doc, start = (np.concatenate([x[i] for x in held]) for i in range(4))
        ids, digests, groups = pa.concat_arrays(ids), np.concatenate(digests), np.concatenate(groups)
        first, _ = _firsts(w1, w2, _ranks(ids, groups)[doc], start)
        for mark, which in ((0, np.flatnonzero(first)), (-1, np.flatnonzero(~first & (groups[doc] >= 0)))):
            if mark:  # decided: only where they start is sent on, in the bucket of the first hash of its text
                key = (digests[doc[which]].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            else:
                key = (w1[which] % np.uint64(buckets)).astype(np.int64)
            which = which[np.lexsort((start[which], doc[which], key))]
            key = np.sort(key)
            edge = np.flatnonzero(np.diff(key, prepend=-1, append=-1))
            for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                some = which[a:z]
                used, back = np.unique(doc[some], return_inverse=True)
                none = pa.array([None], pa.binary())
                yield pa.record_batch([pa.array([int(key[a])], pa.int32()), _list(ids.take(pa.array(used))), _list(pa.array(digests[used])), _list(pa.array(groups[used])), none if mark else _bytes(w1[some]), none if mark else _bytes(w2[some]), _bytes(_narrow(back)), _bytes(_narrow(start[some]))], names=packed.names)

    def decide(record_batches):
        """All of a task's buckets at once: numbers only, whose share is set by the number of tasks."""
        ids, digests, groups, rows, open_, done = [], [], [], 0, [], []
        for batch in record_batches:
            for r in range(batch.num_rows):
                own = column(batch, "ids")[r].values
                ids.append(pa.array(own.to_pylist(), own.type))
                digests.append(column(batch, "digests")[r].values.to_numpy(zero_copy_only=False).copy())
                groups.append(column(batch, "groups")[r].values.to_numpy(zero_copy_only=False).copy())
                w1, w2, doc, start = (column(batch, c)[r].as_py() for c in ("w1", "w2", "doc", "start"))
                doc, start = _wide(doc) + rows, _wide(start)
                rows += len(own)
                if w1 is None:
                    done.append((doc, start))
                else:
                    open_.append((np.frombuffer(w1, np.uint64), np.frombuffer(w2, np.uint32), doc, start))
        if not rows:
            return
        ids, digests, groups = pa.concat_arrays(ids), np.concatenate(digests), np.concatenate(groups)
        # a text has an entry for each bucket; take the first
        rank = _ranks(ids, groups)
        order = np.lexsort((digests, rank))
        new = np.concatenate([[True], (np.diff(rank[order]) != 0) | (np.diff(digests[order]) != 0)])
        one = np.empty(rows, np.int64)
        one[order] = order[new][np.cumsum(new) - 1]
        if open_:
            w1, w2, doc, start = (np.concatenate([x[i] for x in open_]) for i in range(4))
            first, _ = _firsts(w1, w2, rank[doc], start)
            later = ~first & (groups[doc] >= 0)
            done.append((doc[later], start[later]))
        doc, start = (np.concatenate([x[i] for x in done]) for i in range(2))
        doc = one[doc]
        order = np.lexsort((start, doc, groups[doc]))
        doc, start = doc[order], start[order]
        edge = np.flatnonzero(np.diff(groups[doc], prepend=-1, append=-1))
        for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            used, back = np.unique(doc[a:z], return_inverse=True)
            yield pa.record_batch([pa.array([int(groups[doc[a]])], pa.int32()), _list(ids.take(pa.array(used))), _list(pa.array(digests[used])), _bytes(_narrow(back)), _bytes(_narrow(start[a:z]))], names=out.names)

    out = T.StructType([T.StructField("group", T.IntegerType()), T.StructField("ids", ids_type), T.StructField("digests", T.ArrayType(T.LongType())), T.StructField("doc", T.BinaryType()), T.StructField("start", T.BinaryType())])
    return docs.select("id", "text", "digest", "group").mapInArrow(compare, packed).repartitionById(buckets, "bucket").mapInArrow(decide, out)


def _firsts(w1: np.ndarray, w2: np.ndarray, rank: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows are at the earliest place of their kind (all that share it), and the order by kind and place."""
    place = rank << 32 | start
    order = np.lexsort((place, w2, w1))
    a, b, p = w1[order], w2[order], place[order]
    head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    first = np.empty(len(p), bool)
    first[order] = p == np.repeat(p[head], np.diff(np.append(head, len(p))))
    return first, order


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes()], pa.binary())


def _list(x: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)


def _narrow(x: np.ndarray) -> np.ndarray:
    """As 16 bits where they do, with a mark in front; see _wide()."""
    x = np.asarray(x)
    return np.concatenate([[1], x]).astype("<u2") if x.max(initial=0) < 1 << 16 else np.concatenate([[0, 0], x]).astype("<u4")


def _wide(data: bytes) -> np.ndarray:
    return (np.frombuffer(data, "<u2")[1:] if data[0] else np.frombuffer(data, "<u4")[2:]).astype(np.int64)


def _ranks(ids: pa.Array, groups: np.ndarray) -> np.ndarray:
    """Ranks of texts: those of history (group -1) before others, then by id, null first; equal ids equal."""
    rank = pc.fill_null(pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense"), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    rank[~ids.is_valid().to_numpy(zero_copy_only=False)] = 0
    return rank + (groups >= 0) * (len(ids) + 1)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, batches: int | None = None, layout: str = "words", keep: list[str] | None = None, sketch_bits: int = SKETCH_BITS, log: FingerprintLog | None = None, history: DataFrame | None = None) -> DataFrame:
    """Texts without the words of windows that also start earlier.

    A window is `width` consecutive words (runs of anything but ASCII white space) of one text; it starts earlier in a text of a
    smaller id, or in the same text further ahead. Every word that such a later window covers goes; windows are judged
    on the input. Returns id_col, the columns in `keep`, n_words, n_removed, kept: the words left, joined by one space
    (layout "words"), or the text with the white space it had (layout "text": removed words go with the space behind them; an untouched
    text is as it was).

    Null texts have no words and stay null under layout "text"; null ids come before all others; rows with the same id
    count as the same document, so equal windows at the same place of two of them are both kept; repeated rows
    each get their row; an empty table gives no rows.

    Incremental use: with `log`, docs are one new batch that is added to it (unless `batches` says otherwise), and `history` names the documents
    it holds (with the same columns for id and text), which count as earlier than all of docs. Windows of docs that stand in history
    go too; history is read once to verify them and not changed. Without `log`, docs are dealt to BATCHES batches of a log of their own.
    The log is written when this is called, the rows when they are asked for.

    Every text is read once for fingerprints, once for verification and once for removal. Fingerprints and
    windows are made unique in the tasks that read them, so a passage that very many texts share is shuffled
    once per batch of rows. Texts are shuffled once, by a hash of id and
    text, to meet what goes from them.
    """
    keep = keep or []
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]).withColumn("digest", F.xxhash64("text"))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.count() // TASK_TEXTS)
    base = base.withColumn("group", F.pmod(F.xxhash64("id", "digest"), F.lit(tasks)).cast("int"))
    if history is not None:
        history = history.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    batches = batches or (BATCHES if log is None else 1)
    found = repeated_windows(base.select("id", "text", "digest", "group"), width, batches, sketch_bits, log, history)
    # texts and what goes from them meet by group, the latter first
    lacks = [F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema if f.name != "group"]
    texts = base.select("group", F.lit(1).alias("kind"), *[c for c in base.columns if c != "group"], *lacks)
    lacks = [F.lit(None).cast(f.dataType).alias(f.name) for f in base.schema if f.name != "group"]
    marks = found.select("group", F.lit(0).alias("kind"), *lacks, *[c for c in found.columns if c != "group"])
    rows = marks.unionByName(texts).repartitionById(tasks, "group").sortWithinPartitions("kind")
    front = [base.schema["id"], *(base.schema[f"k{i}"] for i in range(len(keep)))]
    out = T.StructType([*front, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def run(record_batches):
        goes: dict[tuple, list[np.ndarray]] = {}
        for batch in record_batches:
            marks = int(np.count_nonzero(column(batch, "kind").to_numpy() == 0))
            for r in range(marks):
                keys = zip(column(batch, "ids")[r].as_py(), column(batch, "digests")[r].as_py(), strict=True)
                doc, start = _wide(column(batch, "doc")[r].as_py()), _wide(column(batch, "start")[r].as_py()).astype(np.int32)
                for key, own in zip(keys, np.split(start, np.flatnonzero(np.diff(doc)) + 1), strict=True):
                    goes.setdefault(key, []).append(own)
            batch = batch.slice(marks)
            if not batch.num_rows:
                continue
            n_words, n_removed, kept = [], [], []
            keys = zip(column(batch, "id").to_pylist(), column(batch, "digest").to_pylist(), strict=True)
            some = [goes.get(k) for k in keys]
            for r, text in enumerate(column(batch, "text").cast(pa.binary()).to_pylist()):
                if text is None:
                    n_words.append(0), n_removed.append(0), kept.append(b"" if layout == "words" else None)
                    continue
                if some[r] is None:
                    parts = text.split()
                    n_words.append(len(parts)), n_removed.append(0), kept.append(b" ".join(parts) if layout == "words" else text)
                    continue
                data = np.frombuffer(text, np.uint8)
                s, e, _ = words(data, np.array([0, len(data)]), NOT_SPACE)
                d = np.zeros(len(s) + 1, np.int32)
                at = np.concatenate(some[r])
                np.add.at(d, at, 1)
                np.add.at(d, at + width, -1)
                left = np.flatnonzero(np.cumsum(d[:-1]) == 0)
                n_words.append(len(s)), n_removed.append(len(s) - len(left))
                if layout == "words":
                    parts = text.split()
                    kept.append(b" ".join([parts[i] for i in left.tolist()]))
                else:
                    stop = np.append(s[1:], len(data))
                    lead = text[: int(s[0])] if len(s) else text
                    kept.append(lead + b"".join([text[a:z] for a, z in zip(s[left].tolist(), stop[left].tolist(), strict=True)]))
            cols = [column(batch, f.name) for f in front]
            yield pa.record_batch([*cols, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=out.names)

    done = rows.mapInArrow(run, out)
    return done.select(F.col("id").alias(id_col), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_words", "n_removed", "kept")
