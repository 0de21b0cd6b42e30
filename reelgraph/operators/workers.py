"""Worker liveness and task bookkeeping over event tables (the batch side of ``streaming.workers``).

Heartbeats are ``worker_id, ts, status, event_id``; results are ``task_id, worker_id, status,
processing_time, ...``; times are Unix seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reelgraph.config import ClusterSettings
from reelgraph.operators.folding import gap_to_next

TERMINAL = ("completed", "failed", "cancelled")


def latest_heartbeats(heartbeats: DataFrame) -> DataFrame:
    """The last heartbeat of every worker: a partial aggregate, so a chatty worker costs one row per task."""
    return heartbeats.groupBy("worker_id").agg(
        F.max("ts").alias("last_heartbeat"), F.max_by("status", F.struct("ts", "event_id")).alias("status"),
        F.count("*").alias("heartbeats"),
    )


def offline_periods(heartbeats: DataFrame, timeout: float, bucket: float = 86400.0) -> DataFrame:
    """Silences longer than ``timeout``: when each worker went offline and for how long it had been silent."""
    rows = gap_to_next(heartbeats.select("worker_id", "ts"), "worker_id", "ts", "silence", max(bucket, timeout))
    return rows.filter(F.col("silence") > timeout).select(
        "worker_id", F.col("ts").alias("last_heartbeat"), (F.col("ts") + timeout).alias("offline_at"), "silence"
    )


def worker_states(heartbeats: DataFrame, now: float, settings: ClusterSettings = ClusterSettings(), pinged: DataFrame | None = None):
    """Status of each worker at ``now``: offline after two missed intervals, error when a ping failed.

    ``pinged`` lists (worker_id, reachable) of the workers that were probed.  ``lost`` marks workers
    that have been offline for more than five intervals.
    """
    rows = latest_heartbeats(heartbeats).withColumn("silence", F.lit(float(now)) - F.col("last_heartbeat"))
    offline = F.col("silence") > settings.heartbeat_seconds * settings.offline_factor
    status = F.when(offline, F.lit("offline"))
    if pinged is not None:
        rows = rows.join(pinged, "worker_id", "left")
        status = status.when(~F.coalesce("reachable", F.lit(True)), F.lit("error"))
    return rows.withColumn("status", status.otherwise(F.col("status"))).withColumn(
        "lost", offline & (F.col("silence") > settings.heartbeat_seconds * settings.dead_factor)
    ).drop("reachable")


def recover_tasks(tasks: DataFrame, workers: DataFrame, settings: ClusterSettings = ClusterSettings()) -> DataFrame:
    """Tasks after their workers' failures.

    An open task of an offline worker goes back to pending.  One of a lost worker is retried too, its
    retry count rising, and fails once the count passes the limit.
    """
    gone = workers.filter(F.col("status") == "offline").select("worker_id", "lost")
    rows = tasks.join(gone, "worker_id", "left")
    hit = F.col("lost").isNotNull() & F.col("status").isin("assigned", "processing")
    retries = F.col("retry_count") + F.when(hit & F.col("lost"), 1).otherwise(0)
    fails = hit & F.col("lost") & (retries > settings.max_retries)
    return rows.select(
        *[c for c in tasks.columns if c not in ("worker_id", "status", "retry_count")],
        F.when(hit, F.lit(None).cast("string")).otherwise(F.col("worker_id")).alias("worker_id"),
        F.when(fails, "failed").when(hit, "pending").otherwise(F.col("status")).alias("status"),
        retries.alias("retry_count"),
    )


def available_workers(workers: DataFrame, results: DataFrame) -> DataFrame:
    """Available workers, the fastest on average first."""
    pace = worker_results(results).select("worker_id", "mean_processing_time")
    return workers.filter(F.col("status") == "available").join(pace, "worker_id", "left").orderBy(
        F.coalesce("mean_processing_time", F.lit(0.0)), "worker_id"
    )


def worker_results(results: DataFrame) -> DataFrame:
    """Completed and failed tasks per worker and the mean time of the completed ones."""
    s = F.col("status")
    return results.groupBy("worker_id").agg(
        F.count_if(s == "completed").alias("tasks_completed"), F.count_if(s == "failed").alias("tasks_failed"),
        F.coalesce(F.avg(F.when(s == "completed", F.col("processing_time"))), F.lit(0.0)).alias("mean_processing_time"),
    )


def retry_decisions(tasks: DataFrame, settings: ClusterSettings = ClusterSettings()) -> DataFrame:
    """Failed tasks go back to pending while they have retries left."""
    again = (F.col("status") == "failed") & (F.col("retry_count") < settings.max_retries)
    return tasks.withColumns({
        "status": F.when(again, "pending").otherwise(F.col("status")),
        "retry_count": F.col("retry_count") + again.cast("int"),
    })


def expire_tasks(tasks: DataFrame, now: float, settings: ClusterSettings = ClusterSettings()) -> DataFrame:
    """Tasks without the finished ones older than the time to live."""
    age = F.lit(float(now)) - F.coalesce("completed_time", "created_time")
    old = F.col("status").isin(*TERMINAL) & (age > settings.task_ttl_hours * 3600)
    return tasks.filter(~F.coalesce(old, F.lit(False)))  # a task without times is kept


def cancel_open(tasks: DataFrame) -> DataFrame:
    """Shutdown: pending and assigned tasks become cancelled."""
    return tasks.withColumn(
        "status", F.when(F.col("status").isin("pending", "assigned"), "cancelled").otherwise(F.col("status"))
    )
