"""Counts, rates and rule-based advice.  Every aggregate combines map-side before its shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def _metric_rows(row: DataFrame) -> DataFrame:
    """Turn a one-row frame into (metric, value) rows."""
    names = row.columns
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return row.select(F.inline(pairs))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _rows(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias(name))


def metadata_stats(videos: DataFrame, chunks: DataFrame, frames: DataFrame, audio: DataFrame) -> DataFrame:
    v = videos.agg(
        F.count("*").alias("total_videos"),
        F.count_if("success").alias("successful_videos"),
        (F.coalesce(F.sum(F.when(F.col("success"), F.col("duration"))), F.lit(0.0)) / 3600).alias("total_hours"),
    )
    return _union([_metric_rows(v)] + [
        _metric_rows(_rows(df, name))
        for df, name in ((chunks, "total_chunks"), (frames, "total_frames"), (audio, "total_audio_segments"))
    ])


def type_counts(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities and relations per type, and their totals."""

    def counted(df: DataFrame, column: str, scope: str) -> DataFrame:
        return (
            df.rollup(column).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
            .select(F.lit(scope).alias("scope"), F.when(F.col("g") == 1, "").otherwise(F.col(column)).alias("value"), "n")
        )

    return counted(entities, "entity_type", "entity").unionByName(counted(relations, "relation_type", "relation"))


def graph_rows(graphs: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entity and relation counts of every graph, empty graphs included."""
    e = entities.groupBy("graph_id").agg(F.count("*").alias("entities"))
    r = relations.groupBy("graph_id").agg(F.count("*").alias("relations"))
    return graphs.select("graph_id").distinct().join(e, "graph_id", "left").join(r, "graph_id", "left").select(
        "graph_id", F.coalesce("entities", F.lit(0)).alias("entities"), F.coalesce("relations", F.lit(0)).alias("relations")
    )


def graph_averages(per_graph: DataFrame) -> DataFrame:
    return _metric_rows(per_graph.agg(
        F.count("*").alias("graphs"),
        F.coalesce(F.avg("entities"), F.lit(0.0)).alias("mean_entities"),
        F.coalesce(F.avg("relations"), F.lit(0.0)).alias("mean_relations"),
    ))


def library_stats(videos: DataFrame, frames: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    s = F.col("status")
    v = videos.agg(
        F.count("*").alias("total_videos"), F.count_if(s == "completed").alias("completed_videos"),
        F.count_if(s == "failed").alias("failed_videos"),
        F.count_if(s.isin("pending", "processing")).alias("open_videos"),
        F.coalesce(F.sum("duration"), F.lit(0.0)).alias("total_duration"),
    )
    return _union([_metric_rows(v)] + [
        _metric_rows(_rows(df, name))
        for df, name in ((frames, "total_frames"), (entities, "total_entities"), (relations, "total_relations"))
    ])


def queue_status(videos: DataFrame) -> DataFrame:
    """Videos per state and the time the open ones will take at the mean pace so far."""
    s = F.col("status")
    base = videos.agg(
        F.count_if(s == "pending").alias("pending"), F.count_if(s == "processing").alias("processing"),
        F.count_if(s == "completed").alias("completed"), F.count_if(s == "failed").alias("failed"),
        F.avg(F.when(s == "completed", F.col("processing_time"))).alias("mean_time"),
    )
    queue = F.col("pending") + F.col("processing")
    eta = F.when((queue > 0) & (F.coalesce("mean_time", F.lit(0.0)) > 0), F.col("mean_time") * queue).otherwise(F.lit(0.0))
    return base.select("pending", "processing", "completed", "failed", queue.alias("queue"), eta.alias("eta_seconds"))


def performance_metrics(videos: DataFrame, frames: DataFrame, uptime_hours: Column | float = 1.0, memory_mb: Column | float = 1.0) -> DataFrame:
    s = F.col("status")
    up = F.lit(uptime_hours) if isinstance(uptime_hours, (int, float)) else uptime_hours
    mem = F.lit(memory_mb) if isinstance(memory_mb, (int, float)) else memory_mb
    base = videos.agg(
        F.coalesce(F.sum(F.when(s == "completed", F.col("processing_time"))), F.lit(0.0)).alias("total_time"),
        F.count_if(s == "completed").alias("done"), F.count_if(s == "failed").alias("failed"),
    )
    n_frames = frames.agg(F.count("*")).scalar()

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    return base.select(
        F.col("total_time").alias("total_processing_time"),
        ratio(F.col("total_time"), F.col("done")).alias("mean_processing_time"),
        ratio(F.col("done"), F.col("done") + F.col("failed")).alias("success_rate"),
        ratio(F.col("done"), up).alias("videos_per_hour"),
        ratio(n_frames, mem).alias("frames_per_mb"),
    )


def rolling_average(samples: DataFrame, columns: list[str], order_by: str, tie: str, last_n: int | None = None) -> DataFrame:
    """Means over the newest ``last_n`` samples, or over all of them; nulls do not count."""
    rows = samples.orderBy(F.desc(order_by), F.desc(tie)).limit(last_n) if last_n else samples
    return rows.agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def cluster_status(workers: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row of worker and task counts; every task is counted once."""
    w, t = F.col("status"), F.col("status")
    by_worker = workers.agg(
        F.count("*").alias("total_workers"), F.count_if(w == "available").alias("available_workers"),
        F.count_if(w == "busy").alias("busy_workers"), F.count_if(w == "offline").alias("offline_workers"),
    ).withColumn(
        "utilization", F.coalesce(F.try_divide(F.col("busy_workers") * 100.0, F.col("total_workers")), F.lit(0.0))
    )
    by_task = tasks.agg(
        F.count("*").alias("total_tasks"), F.count_if(t == "pending").alias("pending_tasks"),
        F.count_if(t == "processing").alias("processing_tasks"), F.count_if(t == "completed").alias("completed_tasks"),
        F.count_if(t == "failed").alias("failed_tasks"),
    )
    return _union([_metric_rows(by_worker), _metric_rows(by_task)])


def _rules(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(advice)) for cond, advice in pairs]))


def health(metrics: DataFrame) -> DataFrame:
    """Issues, overall status and advice from one row of metrics per monitored thing.

    Expects ``initialized``, ``failed_models``, ``memory_short``, ``disk_short``, ``failed``, ``total``.
    """
    rate = F.try_divide(F.col("failed").cast("double"), F.col("total").cast("double"))
    high = F.coalesce(rate > 0.5, F.lit(False))
    issues = _rules(
        (~F.col("initialized"), "not initialized"), (F.col("failed_models") > 0, "failed models"),
        (F.col("memory_short"), "low memory"), (F.col("disk_short"), "low disk"), (high, "high failure rate"),
    )
    advice = _rules(
        (~F.col("initialized"), "restart"), (F.col("failed_models") > 0, "check model settings"),
        (F.col("memory_short"), "free or add memory"), (F.col("disk_short"), "free or add disk"),
        (high, "check formats and processing settings"),
    )
    n = F.size("issues")
    return metrics.withColumn("issues", issues).withColumn("advice", advice).withColumn(
        "overall", F.when(n == 0, "healthy").when(n < 3, "degraded").otherwise("unhealthy")
    )


def advanced_advice(usage: DataFrame) -> DataFrame:
    """Advice from resource use, error counts and processing rates, as an array per input row."""
    return usage.withColumn("advice", _rules(
        (F.col("memory_percent") > 80, "high memory use"), (F.col("cpu_percent") > 90, "high cpu use"),
        (F.col("disk_percent") > 90, "low disk space"), (F.col("model_errors") > 10, "high model error rate"),
        (F.col("success_rate") < 0.8, "low success rate"), (F.col("mean_seconds") > 300, "slow processing"),
    ))
