"""Streams against their batch counterparts."""

import glob
import os
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from reelgraph.config import ClusterSettings
from reelgraph.operators import workers as wk
from reelgraph.sources import driver_tables as dt
from reelgraph.streaming import workers as sw

SCHEMA = "worker_id string, task_id string, at timestamp, status string, processing_time double"


@pytest.fixture(scope="module")
def events(spark, sf):
    """Worker events written as files in time order, so that the stream sees several batches."""
    folder = tempfile.mkdtemp(prefix="reelgraph-events-")
    rows = dt.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("worker_id"), F.col("event_id").cast("string").alias("task_id"),
        F.col("ts").cast("timestamp").alias("at"),
        F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), F.col("value").alias("processing_time"),
    )
    rows.repartitionByRange(4, "at").sortWithinPartitions("at").write.mode("overwrite").parquet(folder)
    for i, name in enumerate(sorted(glob.glob(f"{folder}/part-*"))):
        os.utime(name, (1_600_000_000 + i, 1_600_000_000 + i))  # the stream reads files by age
    return folder


def run(stream, mode):
    name = "m" + uuid.uuid4().hex
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return stream.sparkSession.table(name)


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_results_match_batch(spark, events):
    got = run(sw.worker_results(source(spark, events)), "complete")
    want = wk.worker_results(spark.read.parquet(events))
    round_ = [F.round("mean_processing_time", 9).alias("m"), "worker_id", "tasks_completed", "tasks_failed"]
    assert sorted(map(tuple, got.select(*round_).collect())) == sorted(map(tuple, want.select(*round_).collect()))


def test_latest_status_matches_batch(spark, events):
    got = run(sw.latest_status(source(spark, events)), "complete")
    want = spark.read.parquet(events).groupBy("worker_id").agg(F.max("at"), F.count("*"))
    assert sorted(map(tuple, got.select("worker_id", "last_heartbeat", "heartbeats").collect())) == sorted(map(tuple, want.collect()))


def test_offline_events_match_batch(spark, events):
    timeout = 6 * 3600.0
    got = run(sw.offline_events(source(spark, events), timeout, "1 minute"), "append").select("worker_id", "last_heartbeat")
    batch = spark.read.parquet(events).select("worker_id", (F.unix_micros("at") / 1e6).alias("ts"))
    gaps = {(r[0], round(r[1], 3)) for r in wk.offline_periods(batch, timeout).select("worker_id", "last_heartbeat").collect()}
    streamed = {(r[0], round(r[1], 3)) for r in got.select("worker_id", F.unix_micros("last_heartbeat") / 1e6).collect()}
    # The stream also closes sessions with nothing after them, once the watermark passes.
    ends = {(r[0], round(r[1], 3)) for r in batch.groupBy("worker_id").agg(F.max("ts")).collect()}
    assert gaps - streamed == set() and streamed - gaps <= ends


def test_duplicates_and_rejects(spark):
    folder = tempfile.mkdtemp(prefix="reelgraph-dup-")
    rows = spark.createDataFrame([("w1", "t1", 10.0), ("w1", "t1", 20.0), ("w2", "t2", 30.0), (None, "t3", 40.0)], "worker_id string, task_id string, s double")
    rows.select("worker_id", "task_id", F.timestamp_seconds("s").alias("at"), F.lit("completed").alias("status"), F.lit(1.0).alias("processing_time")).coalesce(1).write.mode("overwrite").parquet(folder)
    assert sorted(r["task_id"] for r in run(sw.once_per_task(source(spark, folder)), "append").collect()) == ["t1", "t2", "t3"]
    known = spark.createDataFrame([("w1",)], "worker_id string")
    good, bad = sw.known_workers_only(source(spark, folder), known)
    assert run(good, "append").count() == 2
    assert {r["reason"] for r in run(bad, "append").collect()} == {"unknown worker", "missing field"}


def test_task_tracking(spark):
    folder = tempfile.mkdtemp(prefix="reelgraph-tasks-")
    rows = [("t1", 1, "assigned"), ("t1", 2, "failed"), ("t1", 3, "assigned"), ("t1", 4, "completed"), ("t1", 5, "failed"),
            ("t2", 1, "assigned"), ("t2", 2, "worker_lost"), ("t2", 3, "assigned"), ("t2", 4, "worker_lost"), ("t3", 1, "failed"), ("t3", 2, "failed")]
    spark.createDataFrame(rows, "task_id string, s int, event string").select("task_id", F.timestamp_seconds("s").alias("at"), "event").coalesce(1).write.mode("overwrite").parquet(folder)
    stream = spark.readStream.schema("task_id string, at timestamp, event string").parquet(folder)
    out = run(sw.track_tasks(stream, ClusterSettings(max_retries=1)), "append").orderBy("task_id", "at").collect()
    assert [(r["task_id"], r["status"], r["retry_count"]) for r in out] == [
        ("t1", "assigned", 0), ("t1", "pending", 1), ("t1", "assigned", 1), ("t1", "completed", 1),
        ("t2", "assigned", 0), ("t2", "pending", 1), ("t2", "assigned", 1), ("t2", "failed", 2),
        ("t3", "pending", 1), ("t3", "failed", 1),
    ]


def test_snapshots(spark, events):
    folder, seen = tempfile.mkdtemp(prefix="reelgraph-snap-"), []
    q = sw.snapshot_every(sw.latest_status(source(spark, events)), lambda df, i: seen.append(df.count()), folder, "0 seconds")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert seen and seen[-1] == spark.read.parquet(events).select("worker_id").distinct().count()


def test_worker_states_and_recovery(spark):
    hb = spark.createDataFrame([("a", 0.0, "busy", 1), ("b", 150.0, "available", 2), ("c", 95.0, "busy", 3)], "worker_id string, ts double, status string, event_id int")
    states = wk.worker_states(hb, 170.0, pinged=spark.createDataFrame([("b", False)], "worker_id string, reachable boolean"))
    got = {r["worker_id"]: (r["status"], r["lost"]) for r in states.collect()}
    assert got == {"a": ("offline", True), "b": ("error", False), "c": ("offline", False)}
    tasks = spark.createDataFrame([("t1", "a", "processing", 3), ("t2", "a", "assigned", 0), ("t3", "c", "processing", 3), ("t4", "a", "completed", 0), ("t5", "b", "assigned", 0)],
                                  "task_id string, worker_id string, status string, retry_count int")
    out = {r["task_id"]: (r["worker_id"], r["status"], r["retry_count"]) for r in wk.recover_tasks(tasks, states).collect()}
    assert out == {"t1": (None, "failed", 4), "t2": (None, "pending", 1), "t3": (None, "pending", 3), "t4": ("a", "completed", 0), "t5": ("b", "assigned", 0)}
    assert wk.cancel_open(tasks).filter("status = 'cancelled'").count() == 2
