"""Worker liveness, results and task recovery as streams.

Input streams carry an event-time column ``at`` (timestamp).  Sources and sinks are the caller's: any
``readStream`` in, any ``writeStream`` out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, functions as F

from reelgraph.config import ClusterSettings


def latest_status(heartbeats: DataFrame) -> DataFrame:
    """Last heartbeat and status per worker; use with output mode ``update`` or ``complete``."""
    return heartbeats.groupBy("worker_id").agg(
        F.max("at").alias("last_heartbeat"), F.max_by("status", "at").alias("status"), F.count("*").alias("heartbeats")
    )


def known_workers_only(heartbeats: DataFrame, workers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split heartbeats into those of registered workers and those to reject.

    A heartbeat without worker or time is rejected as well.
    """
    complete = F.col("worker_id").isNotNull() & F.col("at").isNotNull()
    good = heartbeats.filter(complete)
    registered = workers.select("worker_id").distinct()
    accepted = good.join(registered, "worker_id", "left_semi")
    unknown = good.join(registered, "worker_id", "left_anti").withColumn("reason", F.lit("unknown worker"))
    broken = heartbeats.filter(~complete).withColumn("reason", F.lit("missing field"))
    return accepted, unknown.unionByName(broken)


def offline_events(heartbeats: DataFrame, timeout_seconds: float, lateness: str = "10 minutes") -> DataFrame:
    """One row each time a worker has been silent for longer than the timeout; output mode ``append``.

    A worker's heartbeats form a session; the session closes when the watermark passes the last of them
    by the timeout, and that close is the offline event.  State is one open session per worker.
    """
    gap = f"{int(timeout_seconds * 1_000_000) + 1} microseconds"
    return (
        heartbeats.withWatermark("at", lateness)
        .groupBy("worker_id", F.session_window("at", gap).alias("s"))
        .agg(F.max("at").alias("last_heartbeat"), F.count("*").alias("heartbeats"))
        .select(
            "worker_id", "last_heartbeat", F.timestamp_add("MICROSECOND", F.lit(int(timeout_seconds * 1_000_000)), "last_heartbeat").alias("offline_at"),
            "heartbeats",
        )
    )


def worker_results(results: DataFrame) -> DataFrame:
    """Completed and failed counts and running mean time per worker; output mode ``update``."""
    s = F.col("status")
    return results.groupBy("worker_id").agg(
        F.count_if(s == "completed").alias("tasks_completed"), F.count_if(s == "failed").alias("tasks_failed"),
        F.coalesce(F.avg(F.when(s == "completed", F.col("processing_time"))), F.lit(0.0)).alias("mean_processing_time"),
    )


def once_per_task(results: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """Each task's result once, however often it is reported within the time to live.

    State of a task is dropped when the watermark passes it, which is also the clean-up of old tasks.
    """
    return results.withWatermark("at", ttl).dropDuplicatesWithinWatermark(["task_id"])


def track_tasks(events: DataFrame, settings: ClusterSettings = ClusterSettings(), ttl: str = "24 hours") -> DataFrame:
    """Follow tasks through ``assigned``, ``completed``, ``failed`` and ``worker_lost`` events.

    Emits one row per transition: a failed task is retried while it has retries, a task of a lost worker
    is retried or, past the limit, failed.  State is a status, a retry count and an expiry per task, and
    is removed by an event-time timer.  Output mode ``append``.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    limit = settings.max_retries
    keep_ms = int(settings.task_ttl_hours * 3_600_000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, retries = state.get if state.exists else ("pending", 0)
        out = []
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        for at, event in zip(rows["at"], rows["event"]):
            if status in ("completed", "cancelled"):
                continue
            if event == "assigned":
                status = "assigned"
            elif event == "completed":
                status = "completed"
            elif event == "failed":
                again = retries < limit
                status, retries = ("pending", retries + 1) if again else ("failed", retries)
            elif event == "worker_lost" and status in ("assigned", "processing"):
                retries += 1
                status = "pending" if retries <= limit else "failed"
            else:
                continue
            out.append((key[0], at, event, status, retries))
        state.update((status, retries))
        latest = int(rows["at"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(latest + keep_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["task_id", "at", "event", "status", "retry_count"])

    return (
        events.withWatermark("at", ttl)
        .groupBy("task_id")
        .applyInPandasWithState(
            step, "task_id string, at timestamp, event string, status string, retry_count int",
            "status string, retry_count int", "append", GroupStateTimeout.EventTimeTimeout,
        )
    )


def snapshot_every(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "30 seconds",
                   mode: str = "complete"):
    """Start a query that hands a status snapshot to ``write`` at a fixed interval; stop it with ``.stop()``."""
    return (
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(processingTime=interval).start()
    )
