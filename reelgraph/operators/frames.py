"""Cutting videos into chunks and choosing frames, as table expressions.

A video row has ``video_id, duration, fps, total_frames``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from reelgraph.functions import ids, text
from reelgraph.session import cut_lineage


def chunk_windows(videos: DataFrame, seconds: float = 30.0) -> DataFrame:
    """Fixed-length chunks that cover each video; the last one may be shorter."""
    count = F.ceil(F.col("duration") / seconds)
    rows = videos.filter(F.col("duration") > 0).withColumn("chunk_index", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    return rows.withColumn("start_time", F.col("chunk_index") * seconds).withColumn(
        "end_time", F.least((F.col("chunk_index") + 1) * seconds, F.col("duration"))
    ).withColumn("chunk_id", ids.chunk_id(F.col("video_id"), F.col("chunk_index")))


def sample_frames(chunks: DataFrame, per_chunk: int = 5) -> DataFrame:
    """Evenly spaced frames of each chunk, or all of them when the chunk has no more than that."""
    start = F.floor(F.col("start_time") * F.col("fps"))
    end = F.least(F.floor(F.col("end_time") * F.col("fps")), F.col("total_frames"))
    n = F.least(F.lit(per_chunk).cast("long"), F.col("_end") - F.col("_start"))
    rows = chunks.withColumn("_start", start).withColumn("_end", end).withColumn("_n", n).filter(F.col("_n") > 0)
    step = (F.col("_end") - F.col("_start")) / F.col("_n")
    rows = rows.withColumn("frame_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    index = F.when(F.col("_end") - F.col("_start") <= F.col("_n"), F.col("_start") + F.col("frame_no")).otherwise(
        F.floor(F.col("_start") + F.col("frame_no") * step)
    )
    return rows.select(
        ids.frame_id(F.col("chunk_id"), F.col("frame_no")).alias("frame_id"), "chunk_id", "video_id",
        index.alias("frame_index"), (index / F.col("fps")).alias("timestamp"),
    )


def uniform_keyframes(videos: DataFrame, max_keyframes: int = 20) -> DataFrame:
    """Evenly spaced key frames; short videos give every frame."""
    total = F.col("total_frames").cast("long")
    step = F.greatest(F.lit(1).cast("long"), F.expr(f"cast(total_frames as bigint) div {max_keyframes}"))
    few = F.sequence(F.lit(0).cast("long"), total - 1, step)
    many = F.transform(F.sequence(F.lit(0), F.lit(max_keyframes - 1)), lambda i: F.floor(i * (total / F.lit(max_keyframes))))
    index = F.when(total <= max_keyframes, few).otherwise(many)
    return videos.filter(total > 0).select("video_id", "fps", F.posexplode(index).alias("i", "frame_index")).select(
        ids.keyframe_id(F.col("video_id"), "keyframe", F.col("i")).alias("frame_id"), "video_id", "frame_index",
        (F.col("frame_index") / F.col("fps")).alias("timestamp"),
    )


def previous_value(samples: DataFrame, key: str, at: str, value: str, out: str, width: int = 4096) -> DataFrame:
    """Add ``out``: the value of the key's previous sample, null for its first.

    Windows cover (key, bucket of ``width``); the first sample of a bucket takes the last value of the
    key's previous non-empty bucket, found from one row per bucket.
    """
    cut = samples.withColumn("_b", F.floor(F.col(at) / width))
    lasts = cut.groupBy(key, "_b").agg(F.max_by(value, at).alias("_last"))
    prior = lasts.select(key, "_b", F.lag("_last").over(Window.partitionBy(key).orderBy("_b")).alias("_prior"))
    w = Window.partitionBy(key, "_b").orderBy(at)
    cut = cut.withColumn("_lag", F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    return cut.join(prior, [key, "_b"]).withColumn(
        out, F.when(F.col("_first"), F.col("_prior")).otherwise(F.col("_lag"))
    ).drop("_b", "_lag", "_first", "_prior")


def scene_keyframes(
    videos: DataFrame, differences: DataFrame, threshold: float = 30.0, min_seconds: float = 2.0, max_keyframes: int = 20
) -> DataFrame:
    """Frames where the picture changes, at least ``min_seconds`` apart, plus the first and last frame.

    ``differences`` has ``video_id, frame_index, difference`` to the sample before.  Each round accepts
    the next change of every video at once, as a minimum combined before the shuffle, so a very long
    video is never gathered; there are at most ``max_keyframes`` rounds.
    """
    gap = videos.select("video_id", F.floor(F.col("fps") * min_seconds).alias("gap"))
    changes = cut_lineage(
        differences.filter(F.col("difference") > threshold).join(gap, "video_id").select("video_id", "frame_index", "gap")
    )
    last = videos.filter(F.col("total_frames") > 0).select(
        "video_id", F.lit(0).cast("long").alias("frame_index"), F.lit(0).alias("i")
    )
    accepted = last
    for i in range(1, max_keyframes):
        before = last.select("video_id", F.col("frame_index").alias("_at"))
        last = cut_lineage(
            changes.join(before, "video_id").filter(F.col("frame_index") - F.col("_at") > F.col("gap"))
            .groupBy("video_id").agg(F.min("frame_index").cast("long").alias("frame_index")).withColumn("i", F.lit(i))
        )
        if last.isEmpty():
            break
        accepted = accepted.unionByName(last)
    found = accepted.groupBy("video_id").agg(F.count("*").alias("_n"), F.max("frame_index").alias("_max"))
    ends = videos.join(found, "video_id").filter(
        (F.col("_n") < max_keyframes) & (F.col("_max") != F.col("total_frames") - 1)
    ).select("video_id", (F.col("total_frames") - 1).cast("long").alias("frame_index"), F.col("_n").cast("int").alias("i"))
    return accepted.unionByName(ends).join(videos.select("video_id", "fps"), "video_id").select(
        ids.keyframe_id(F.col("video_id"), "scene", F.col("i")).alias("frame_id"), "video_id", "frame_index",
        (F.col("frame_index") / F.col("fps")).alias("timestamp"),
    )


def motion_keyframes(scores: DataFrame, max_keyframes: int = 20) -> DataFrame:
    """The frames with the most motion, in time order; ``scores`` has ``video_id, frame_index, motion, fps``.

    The rank limit runs in each task before the shuffle; ties go to the later frame.
    """
    best = Window.partitionBy("video_id").orderBy(F.desc("motion"), F.desc("frame_index"))
    few = scores.withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") <= max_keyframes)
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("frame_index")) - 1
    return few.withColumn("i", number).select(
        ids.keyframe_id(F.col("video_id"), "motion", F.col("i")).alias("frame_id"), "video_id", "frame_index",
        (F.col("frame_index") / F.col("fps")).alias("timestamp"),
    )


def extract_keyframes(videos: DataFrame, method: str = "uniform", signal: DataFrame | None = None, max_keyframes: int = 20):
    """Key frames by method; an unknown method gives no rows."""
    if method == "uniform":
        return uniform_keyframes(videos, max_keyframes)
    if method == "scene_change" and signal is not None:
        return scene_keyframes(videos, signal, max_keyframes=max_keyframes)
    if method == "motion" and signal is not None:
        return motion_keyframes(signal, max_keyframes)
    return uniform_keyframes(videos, max_keyframes).filter(F.lit(False))


def chunk_descriptions(chunks: DataFrame, frames: DataFrame, audio: DataFrame) -> DataFrame:
    """Offline unified description of each chunk from its first three captions and its transcript."""
    w = Window.partitionBy("chunk_id").orderBy("timestamp", "frame_id")
    captioned = frames.filter(F.coalesce("caption", F.lit("")) != "")
    few = captioned.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 3)
    captions = few.groupBy("chunk_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rn", "caption"))), lambda x: x["caption"]).alias("captions")
    )  # at most three entries
    rows = chunks.join(captions, "chunk_id", "left").join(audio.select("chunk_id", "transcript"), "chunk_id", "left")
    none = F.array().cast("array<string>")
    return rows.select(
        "chunk_id", "video_id",
        text.unified_description(F.coalesce("captions", none), F.coalesce("transcript", F.lit(""))).alias("unified_description"),
    )
