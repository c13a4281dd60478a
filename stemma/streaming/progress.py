"""Progress of jobs as a stream: windows, idempotent replay, keyed merges and custom state."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import shared_folder


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def progress_stream(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums per window and kind; state older than the watermark goes."""
    kept = events.withWatermark("ts", late)
    return kept.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def dedupe_stream(events: DataFrame, keys: list[str], late: str = "2 days") -> DataFrame:
    """Each key once within the watermark: replayed files change nothing."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


#: Runs of one level that are merged to a run of the next.
FAN = 8


def upsert_batches(path: str, keys: list[str], order: str, fan: int = FAN) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merges each batch into the table at `path`, which has one row a key, the newest by `order`; see read_upserted().

    A batch writes only its own rows, the newest of each key, as a run of level 0; when `fan` runs of a level are there, they are merged to one of the
    next, so a row is written once a level, a logarithm of the batches, and the table as a whole never again for one batch. Runs are named by the batch they end with and
    are replaced whole, so a batch that runs again changes nothing, and a run counts only once its write has been committed.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        _newest(batch, keys, order).write.mode("overwrite").parquet(_run(path, 0, number))
        level, width = 1, fan
        while (number + 1) % width == 0:
            part = _covering(spark, path, number + 1 - width, number, level - 1, fan)
            if part:
                _merged(spark, part, keys, order).write.mode("overwrite").parquet(_run(path, level, number))
            level, width = level + 1, width * fan

    return write


def read_upserted(spark: SparkSession, path: str, keys: list[str], order: str, fan: int = FAN) -> DataFrame | None:
    """What upsert_batches() has merged so far: one row a key, from the fewest runs that cover all batches. None if nothing is there."""
    last = max(_committed(spark, path, 0), default=None)
    part = [] if last is None else _covering(spark, path, 0, last, None, fan)
    return _merged(spark, part, keys, order) if part else None


def drop_covered(spark: SparkSession, path: str, fan: int = FAN) -> int:
    """Delete the runs that merged ones stand for, when no reader needs them any more; returns how many."""
    last = max(_committed(spark, path, 0), default=-1)
    # the last run of level 0 says how far the table goes
    needed, gone = {*_covering(spark, path, 0, last, None, fan), _run(path, 0, last)}, 0
    for level, runs in enumerate(_levels(spark, path)):
        for n in runs:
            if _run(path, level, n) not in needed:
                at, fs = _at(spark, _run(path, level, n))
                fs.delete(at, True)
                gone += 1
    return gone


def _newest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *rest)).alias("r")).select(*keys, "r.*")


def _run(path: str, level: int, number: int) -> str:
    return f"{path}/level={level}/run={number}"


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _committed(spark: SparkSession, path: str, level: int) -> set[int]:
    """Runs of a level whose write has been committed."""
    at, fs = _at(spark, f"{path}/level={level}")
    if not fs.exists(at):
        return set()
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return {int(n.removeprefix("run=")) for n in names if n.startswith("run=") and fs.exists(_at(spark, f"{path}/level={level}/{n}/_SUCCESS")[0])}


def _levels(spark: SparkSession, path: str) -> list[set[int]]:
    """The committed runs of every level that there is; a level may have none left."""
    out: list[set[int]] = []
    while True:
        at, fs = _at(spark, f"{path}/level={len(out)}")
        if not fs.exists(at):
            return out
        out.append(_committed(spark, path, len(out)))


def _covering(spark: SparkSession, path: str, first: int, last: int, top: int | None, fan: int) -> list[str]:
    """The fewest committed runs, of levels up to `top`, that hold the batches from first to last; a batch that wrote none is passed over."""
    known = _levels(spark, path)[: None if top is None else top + 1]
    out, at = [], first
    while at <= last:
        for level in range(len(known) - 1, -1, -1):
            end = at + fan**level - 1
            if at % fan**level == 0 and end <= last and end in known[level]:
                out.append(_run(path, level, end))
                at = end + 1
                break
        else:
            at += 1
    return out


def _merged(spark: SparkSession, runs: list[str], keys: list[str], order: str) -> DataFrame:
    return _newest(spark.read.parquet(*runs), keys, order)


def sessions_with_state(events: DataFrame, gap_minutes: int = 24 * 60) -> DataFrame:
    """Sessions of each user by a gap in event time, with state that lives across batches: user_id, start, end, n. A session comes out when the next one begins or its time is up."""

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        limit = pd.Timedelta(minutes=gap_minutes)
        start, end, n = (pd.Timestamp(state.get[0]), pd.Timestamp(state.get[1]), state.get[2]) if state.exists else (None, None, 0)
        done = []
        if state.hasTimedOut:
            done.append((key[0], start, end, n))
            state.remove()
        else:
            times = pd.concat([f["ts"] for f in frames]).sort_values()
            for t in times:
                if start is not None and t - end > limit:
                    done.append((key[0], start, end, n))
                    start, n = None, 0
                start, end, n = t if start is None else start, t if end is None or start is None else max(end, t), n + 1
            state.update((start.isoformat(), end.isoformat(), n))
            state.setTimeoutTimestamp(int((end + limit).timestamp() * 1000) + 1)
        yield pd.DataFrame(done, columns=["user_id", "start", "end", "n"])

    kept = events.withWatermark("ts", f"{gap_minutes} minutes").select("user_id", "ts")
    return kept.groupBy("user_id").applyInPandasWithState(step, "user_id long, start timestamp, end timestamp, n long", "start string, end string, n long", "append", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """All that is there now, as a table in the folder that all executors share, where the stream's state is too; nothing passes through the driver.

    Each batch replaces its own part of the table, so one that runs again changes nothing. complete: the last batch is the result, else all of them.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stemma/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(_run(f"{folder}/rows", 0, number))

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    runs = sorted(_committed(spark, f"{folder}/rows", 0))
    if not runs:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[_run(f"{folder}/rows", 0, n) for n in (runs[-1:] if mode == "complete" else runs)])
