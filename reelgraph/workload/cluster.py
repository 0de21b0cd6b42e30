"""Worker and task queries over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgraph.config import ClusterSettings
from reelgraph.operators import stats, workers as wk
from reelgraph.sources import driver_tables as dt
from reelgraph.workload.registry import query

TIMEOUT = 6 * 3600.0
NOW = 1706745600.0  # 2024-02-01
SLOW = ClusterSettings(heartbeat_seconds=3 * 3600.0)


@query(
    "latest_heartbeats", "ST1",
    sql="""SELECT worker_id, round(max(ts), 3) AS last_heartbeat, arg_max(status, (ts, event_id)) AS status, count(*) AS heartbeats
           FROM heartbeats GROUP BY 1""",
    views="heartbeats",
)
def latest_heartbeats(spark, sf_dir):
    return wk.latest_heartbeats(dt.heartbeats(spark, sf_dir)).withColumn("last_heartbeat", F.round("last_heartbeat", 3))


@query(
    "worker_liveness", "ST2",
    sql=f"""SELECT worker_id, round(ts, 3) AS last_heartbeat, round(ts + {TIMEOUT}, 3) AS offline_at, round(nx - ts, 3) AS silence
            FROM (SELECT *, lead(ts) OVER (PARTITION BY worker_id ORDER BY ts) AS nx FROM heartbeats) WHERE nx - ts > {TIMEOUT}""",
    views="heartbeats",
)
def worker_liveness(spark, sf_dir):
    rows = wk.offline_periods(dt.heartbeats(spark, sf_dir), TIMEOUT)
    return rows.select("worker_id", *[F.round(c, 3).alias(c) for c in ("last_heartbeat", "offline_at", "silence")])


@query(
    "worker_states", "ST2 ST3 TOP8",
    sql=f"""WITH l AS (SELECT worker_id, max(ts) AS t, arg_max(status, (ts, event_id)) AS s FROM heartbeats GROUP BY 1)
            SELECT worker_id, CASE WHEN {NOW} - t > 21600 THEN 'offline' ELSE s END AS status, {NOW} - t > 54000 AS lost FROM l""",
    views="heartbeats",
)
def worker_states(spark, sf_dir):
    return wk.worker_states(dt.heartbeats(spark, sf_dir), NOW, SLOW).select("worker_id", "status", "lost")


def _tasks(spark, sf_dir):
    rows = dt.task_results(spark, sf_dir)
    retries = F.when(F.col("processing_time") > 60, 3).otherwise(F.col("processing_time").cast("int") % 4)
    done = F.when(F.col("status").isin("completed", "failed"), F.col("created_time") + F.col("processing_time"))
    return rows.withColumn("retry_count", retries).withColumn("completed_time", done)


@query(
    "task_recovery", "ST3",
    sql=f"""WITH l AS (SELECT worker_id, {NOW} - max(ts) AS q FROM heartbeats GROUP BY 1),
              t AS (SELECT r.*, CASE WHEN processing_time > 60 THEN 3 ELSE trunc(processing_time)::INT % 4 END AS n, q,
                      q > 21600 AND status = 'processing' AS hit FROM task_results r LEFT JOIN l USING (worker_id))
            SELECT task_id, CASE WHEN hit THEN NULL ELSE worker_id END AS worker_id,
                   CASE WHEN hit AND q > 54000 AND n + 1 > 3 THEN 'failed' WHEN hit THEN 'pending' ELSE status END AS status,
                   (n + CASE WHEN hit AND q > 54000 THEN 1 ELSE 0 END)::INT AS retry_count FROM t""",
    views="heartbeats task_results",
)
def task_recovery(spark, sf_dir):
    states = wk.worker_states(dt.heartbeats(spark, sf_dir), NOW, SLOW)
    return wk.recover_tasks(_tasks(spark, sf_dir), states, SLOW).select("task_id", "worker_id", "status", "retry_count")


@query(
    "worker_running_mean", "ST5",
    sql="""SELECT worker_id, count(*) FILTER (status = 'completed') AS tasks_completed, count(*) FILTER (status = 'failed') AS tasks_failed,
             round(coalesce(avg(processing_time) FILTER (status = 'completed'), 0), 6) AS mean_processing_time
           FROM task_results GROUP BY 1""",
    views="task_results",
)
def worker_running_mean(spark, sf_dir):
    rows = wk.worker_results(dt.task_results(spark, sf_dir))
    return rows.withColumn("mean_processing_time", F.round("mean_processing_time", 6))


@query(
    "task_retries", "ST5",
    sql="""WITH t AS (SELECT task_id, status, CASE WHEN processing_time > 60 THEN 3 ELSE trunc(processing_time)::INT % 4 END AS n FROM task_results)
           SELECT task_id, CASE WHEN status = 'failed' AND n < 3 THEN 'pending' ELSE status END AS status,
                  (n + CASE WHEN status = 'failed' AND n < 3 THEN 1 ELSE 0 END)::INT AS retry_count FROM t""",
    views="task_results",
)
def task_retries(spark, sf_dir):
    return wk.retry_decisions(_tasks(spark, sf_dir)).select("task_id", "status", "retry_count")


@query(
    "available_workers", "TOP8",
    sql="""WITH l AS (SELECT worker_id, arg_max(status, (ts, event_id)) AS s FROM heartbeats GROUP BY 1)
           SELECT worker_id, round(coalesce(avg(processing_time) FILTER (status = 'completed'), 0), 6) AS mean_processing_time
           FROM l JOIN task_results USING (worker_id) WHERE s = 'available' GROUP BY 1""",
    views="heartbeats task_results",
)
def available_workers(spark, sf_dir):
    rows = wk.available_workers(wk.latest_heartbeats(dt.heartbeats(spark, sf_dir)), dt.task_results(spark, sf_dir))
    return rows.select("worker_id", F.round("mean_processing_time", 6).alias("mean_processing_time"))


@query(
    "cluster_status", "AGG16 ST6",
    sql=f"""WITH l AS (SELECT worker_id, {NOW} - max(ts) AS q, arg_max(status, (ts, event_id)) AS s FROM heartbeats GROUP BY 1),
              w AS (SELECT CASE WHEN q > 21600 THEN 'offline' ELSE s END AS s FROM l)
            SELECT 'total_workers' AS metric, count(*)::DOUBLE AS value FROM w
            UNION ALL SELECT 'available_workers', count(*) FILTER (s = 'available') FROM w
            UNION ALL SELECT 'busy_workers', count(*) FILTER (s = 'busy') FROM w
            UNION ALL SELECT 'offline_workers', count(*) FILTER (s = 'offline') FROM w
            UNION ALL SELECT 'utilization', round(count(*) FILTER (s = 'busy') * 100.0 / count(*), 6) FROM w
            UNION ALL SELECT 'total_tasks', count(*) FROM task_results
            UNION ALL SELECT 'pending_tasks', count(*) FILTER (status = 'pending') FROM task_results
            UNION ALL SELECT 'processing_tasks', count(*) FILTER (status = 'processing') FROM task_results
            UNION ALL SELECT 'completed_tasks', count(*) FILTER (status = 'completed') FROM task_results
            UNION ALL SELECT 'failed_tasks', count(*) FILTER (status = 'failed') FROM task_results""",
    views="heartbeats task_results",
)
def cluster_status(spark, sf_dir):
    states = wk.worker_states(dt.heartbeats(spark, sf_dir), NOW, SLOW)
    return stats.cluster_status(states, dt.task_results(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(
    "task_ttl", "ST8",
    sql=f"""SELECT task_id, status FROM task_results WHERE NOT (status IN ('completed', 'failed')
              AND {NOW} - (created_time + processing_time) > 10 * 24 * 3600)""",
    views="task_results",
)
def task_ttl(spark, sf_dir):
    return wk.expire_tasks(_tasks(spark, sf_dir), NOW, ClusterSettings(task_ttl_hours=240.0)).select("task_id", "status")


@query(
    "rolling_metrics", "AGG17",
    sql="""SELECT round(avg(value), 6) AS mean_value, round(avg(g), 6) AS mean_gpu FROM (
             SELECT value, CASE WHEN event_type <> 'view' THEN value / 2 END AS g FROM events ORDER BY ts DESC, event_id DESC LIMIT 500)""",
)
def rolling_metrics(spark, sf_dir):
    rows = dt.table(spark, sf_dir, "events").withColumn("gpu", F.when(F.col("event_type") != "view", F.col("value") / 2))
    out = stats.rolling_average(rows, ["value", "gpu"], "ts", "event_id", 500)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    "rolling_metrics_all", "AGG17",
    sql="SELECT round(avg(value), 6) AS mean_value FROM events",
)
def rolling_metrics_all(spark, sf_dir):
    out = stats.rolling_average(dt.table(spark, sf_dir, "events"), ["value"], "ts", "event_id")
    return out.select(F.round("mean_value", 6).alias("mean_value"))


@query(
    "health_rules", "MNT4",
    sql="""WITH m AS (SELECT user_id::VARCHAR AS worker_id, count(*) FILTER (event_type IN ('error', 'view', 'signup')) AS failed, count(*) AS total,
                        min(value) < 0.2 AS low_mem, max(value) > 200 AS low_disk, count(*) FILTER (value > 150) AS bad FROM events GROUP BY 1),
              i AS (SELECT *, (bad > 0)::INT + low_mem::INT + low_disk::INT + (failed / total::DOUBLE > 0.5)::INT AS n FROM m)
           SELECT worker_id, n::BIGINT AS issues, CASE WHEN n = 0 THEN 'healthy' WHEN n < 3 THEN 'degraded' ELSE 'unhealthy' END AS overall FROM i""",
)
def health_rules(spark, sf_dir):
    """Health of each user's stream, from its own error share and extremes."""
    v = F.col("value")
    m = dt.table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("worker_id")).agg(
        F.count_if(F.col("event_type").isin("error", "view", "signup")).alias("failed"), F.count("*").alias("total"),
        (F.min(v) < 0.2).alias("memory_short"), (F.max(v) > 200).alias("disk_short"), F.count_if(v > 150).alias("failed_models"),
    ).withColumn("initialized", F.lit(True))
    return stats.health(m).select("worker_id", F.size("issues").cast("bigint").alias("issues"), "overall")


@query(
    "advanced_advice", "MNT4",
    sql="""WITH m AS (SELECT user_id::VARCHAR AS worker_id, avg(value) * 4 AS mem, max(value) / 4 AS cpu, min(value) * 100 AS disk,
                        count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type <> 'error') / count(*)::DOUBLE AS ok,
                        max(value) AS secs FROM events GROUP BY 1)
           SELECT worker_id, concat_ws(',', CASE WHEN mem > 80 THEN 'high memory use' END, CASE WHEN cpu > 90 THEN 'high cpu use' END,
             CASE WHEN disk > 90 THEN 'low disk space' END, CASE WHEN errors > 10 THEN 'high model error rate' END,
             CASE WHEN ok < 0.8 THEN 'low success rate' END, CASE WHEN secs > 300 THEN 'slow processing' END) AS advice FROM m""",
)
def advanced_advice(spark, sf_dir):
    v, kind = F.col("value"), F.col("event_type")
    m = dt.table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("worker_id")).agg(
        (F.avg(v) * 4).alias("memory_percent"), (F.max(v) / 4).alias("cpu_percent"), (F.min(v) * 100).alias("disk_percent"),
        F.count_if(kind == "error").alias("model_errors"), (F.count_if(kind != "error") / F.count("*")).alias("success_rate"),
        F.max(v).alias("mean_seconds"),
    )
    return stats.advanced_advice(m).select("worker_id", F.array_join("advice", ",").alias("advice"))
