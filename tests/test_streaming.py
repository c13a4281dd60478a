"""Streams over the events table."""

from __future__ import annotations

import os
import random

from pyspark.sql import functions as F

from stemma.streaming import dedupe_stream, run_available, sessions_with_state, upsert_batches
from stemma.streaming import progress as P
from stemma.streaming.progress import drop_covered, progress_stream, read_events, read_upserted


def test_dedupe(spark, sf):
    found = run_available(dedupe_stream(read_events(spark, sf), ["event_id"]), "append")
    assert found.count() == spark.read.parquet(f"{sf}/events.parquet").select("event_id").distinct().count()


def test_upsert_batches(spark, tmp_path):
    """Two batches with keys in common, the second one twice: one row a key, the newest, also where it came first."""
    path, schema = str(tmp_path / "t"), "k long, ts long, v string"
    write, read = upsert_batches(path, ["k"], "ts"), lambda: read_upserted(spark, path, ["k"], "ts")
    assert read() is None
    write(spark.createDataFrame([(1, 10, "a"), (1, 12, "b"), (2, 50, "c")], schema), 0)
    second = spark.createDataFrame([(1, 20, "d"), (2, 40, "late"), (3, 1, None)], schema)
    write(second, 1)
    write(second, 1)
    assert sorted(map(tuple, read().select("k", "ts", "v").collect())) == [(1, 20, "d"), (2, 50, "c"), (3, 1, None)]


def test_upserts_in_levels(spark, tmp_path):
    """Twenty batches by threes, some again, one missing, one killed: the newest rows; a batch writes its own rows, and few runs are read."""
    path = str(tmp_path / "t")
    write = upsert_batches(path, ["k"], "ts", fan=3)
    rng, want = random.Random(2), {}
    for n in range(20):
        if n == 7:
            continue
        rows = [(rng.randrange(40), rng.randrange(1000), f"{n}") for _ in range(10)]
        for _ in range(rng.choice([1, 1, 2])):
            write(spark.createDataFrame(rows, "k long, ts long, v string").coalesce(1), n)
        for k, ts, v in rows:
            want[k] = max(want.get(k, (-1, "")), (ts, v))
    # a write that was not committed does not count
    os.makedirs(f"{path}/level=0/run=20")
    (tmp_path / "t/level=0/run=20/part-0.parquet").write_bytes(b"no table")
    read = lambda: {r.k: (r.ts, r.v) for r in read_upserted(spark, path, ["k"], "ts", fan=3).collect()}
    assert read() == want
    assert P._covering(spark, path, 0, 19, None, 3) == [f"{path}/level=2/run=8", f"{path}/level=2/run=17", f"{path}/level=0/run=18", f"{path}/level=0/run=19"]
    sizes = [spark.read.parquet(f"{path}/level=0/run={n}").count() for n in range(20) if n != 7]
    assert max(sizes) <= 10
    assert drop_covered(spark, path, fan=3) > 15 and read() == want


def test_a_stream_goes_on(spark, sf, tmp_path):
    """A second run of a stream into the table takes only what is new."""
    days = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    source, path = str(tmp_path / "in"), str(tmp_path / "t")
    write = upsert_batches(path, ["user_id"], "ts")
    seen = []

    def run():
        stream = spark.readStream.schema(days.schema).parquet(source)
        q = stream.writeStream.foreachBatch(lambda b, n: (seen.append(b.count()), write(b, n))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()

    days.where("event_id % 3 <> 0").write.mode("append").parquet(source)
    run()
    days.where("event_id % 3 = 0").write.mode("append").parquet(source)
    run()
    assert sum(seen) == days.count() and len(seen) >= 2
    want = {r.user_id: r.ts for r in days.groupBy("user_id").agg(F.max("ts").alias("ts")).collect()}
    assert {r.user_id: r.ts for r in read_upserted(spark, path, ["user_id"], "ts").collect()} == want


def test_results_are_shared(spark, sf):
    """Results lie in the shared folder, not in the driver's memory."""
    found = run_available(progress_stream(read_events(spark, sf)))
    assert all(spark.conf.get("spark.checkpoint.dir").removeprefix("file://") in f for f in found.inputFiles())


def test_sessions(spark, sf):
    found = run_available(sessions_with_state(read_events(spark, sf)), "append")
    assert found.where("n < 1 or end < start").count() == 0
