"""Search, time-range and listing queries over the metadata tables.

Text and range predicates sit directly above the scans.  Joins to ``videos`` are plain equi joins:
``videos`` grows with the data, so nothing is broadcast by hand.  Catalyst broadcasts it while its
size allows and adaptive execution splits the frames of a very large video otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reelgraph.functions import clock, text


def list_videos(
    videos: DataFrame, limit: int | None = None, offset: int = 0, success_only: bool = True
) -> DataFrame:
    """Newest first; an offset counts only together with a limit."""
    rows = videos.filter(F.col("success")) if success_only else videos
    rows = rows.orderBy(F.desc("created_at"), "video_id")
    return rows.offset(offset).limit(limit) if limit else rows


def browse_videos(
    videos: DataFrame, status: str | None = None, sort_by: str = "created_at", reverse: bool = True
) -> DataFrame:
    """Library listing by status, with the size in MB."""
    rows = videos.filter(F.col("status") == status) if status else videos
    key = F.col(sort_by).desc_nulls_last() if reverse else F.col(sort_by).asc_nulls_last()
    return rows.withColumn("size_mb", F.col("size_bytes") / F.lit(1048576.0)).orderBy(key, "video_id")


def video_details(
    videos: DataFrame, frames: DataFrame, entity_videos: DataFrame, relation_videos: DataFrame, video_id: str
) -> DataFrame:
    """One video with its frame, entity and relation counts, read as scalar subqueries."""

    def count(rows: DataFrame) -> Column:
        return rows.filter(F.col("video_id") == video_id).agg(F.count("*")).scalar()

    return videos.filter(F.col("video_id") == video_id).select(
        "*", count(frames).alias("frames_total"), count(entity_videos).alias("entities_total"),
        count(relation_videos).alias("relations_total"),
    )


def _of_video(rows: DataFrame, video_id: str | None) -> DataFrame:
    return rows.filter(F.col("video_id") == video_id) if video_id else rows


def _titles(videos: DataFrame, video_id: str | None) -> DataFrame:
    return _of_video(videos, video_id).select("video_id", "filename")


def search_frames(frames: DataFrame, videos: DataFrame, needle: str, video_id: str | None = None, limit: int | None = 50):
    """Frames whose caption contains the text, best confidence first, then earliest."""
    hits = _of_video(frames, video_id).filter(text.contains_ci(F.col("caption"), needle))
    rows = hits.join(_titles(videos, video_id), "video_id")
    return rows if limit is None else rows.orderBy(F.desc("confidence"), "timestamp", "frame_id").limit(limit)


def search_audio(audio: DataFrame, videos: DataFrame, needle: str, video_id: str | None = None, limit: int | None = 50):
    """Audio segments whose transcript contains the text, best confidence first, then earliest."""
    hits = _of_video(audio, video_id).filter(text.contains_ci(F.col("transcript"), needle))
    rows = hits.join(_titles(videos, video_id), "video_id")
    return rows if limit is None else rows.orderBy(F.desc("confidence"), "start_time", "segment_id").limit(limit)


def search_library(
    videos: DataFrame, frames: DataFrame, audio: DataFrame, needle: str | None = None, video_id: str | None = None,
    success_only: bool = True, limit: int = 50,
) -> DataFrame:
    """Matching videos, frames and audio segments as one tagged result."""
    listed = _of_video(videos, video_id) if video_id else list_videos(videos, limit, 0, success_only)
    out = listed.select(
        F.lit("video").alias("kind"), F.col("video_id").alias("item_id"), "video_id", F.col("filename").alias("label"),
        F.lit(0.0).alias("at"),
    )
    if needle:
        out = out.unionByName(
            search_frames(frames, videos, needle, video_id, limit).select(
                F.lit("frame").alias("kind"), F.col("frame_id").alias("item_id"), "video_id",
                F.col("filename").alias("label"), F.col("timestamp").alias("at"),
            )
        ).unionByName(
            search_audio(audio, videos, needle, video_id, limit).select(
                F.lit("audio_segment").alias("kind"), F.col("segment_id").alias("item_id"), "video_id",
                F.col("filename").alias("label"), F.col("start_time").alias("at"),
            )
        )
    return out


def frames_in_range(frames: DataFrame, video_id: str, start: float, end: float) -> DataFrame:
    """Frames of a video between two offsets, ends included."""
    return _of_video(frames, video_id).filter(F.col("timestamp").between(start, end))


def audio_in_range(audio: DataFrame, video_id: str, start: float, end: float) -> DataFrame:
    """Audio segments of a video that touch the closed range."""
    return _of_video(audio, video_id).filter((F.col("start_time") <= end) & (F.col("end_time") >= start))


def entities_in_range(
    entities: DataFrame, appearances: DataFrame, video_id: str, start: float, end: float
) -> DataFrame:
    """Appearances that touch the closed range, with overlap and its share of the range.

    The share of a zero-length range is null.
    """
    length = float(end) - float(start)
    overlap_start = F.greatest(F.col("start_time"), F.lit(float(start)))
    overlap_end = F.least(F.col("end_time"), F.lit(float(end)))
    hits = (
        _of_video(appearances, video_id)
        .filter((F.col("start_time") <= end) & (F.col("end_time") >= start))
        .withColumn("overlap", overlap_end - overlap_start)
        .withColumn("temporal_score", F.try_divide(F.col("overlap"), F.lit(length)))
    )
    return hits.join(entities.select("entity_id", "name", "entity_type", "confidence"), "entity_id")


def content_in_range(
    frames: DataFrame, audio: DataFrame, entities: DataFrame, appearances: DataFrame, video_id: str, start: float,
    end: float, content_types=("frames", "audio", "entities"), compat: bool = False,
) -> DataFrame:
    """Everything of a video in a time range, ordered by time.

    With ``compat`` only frames carry a sort time and the other rows come first.
    """
    parts = []
    if "frames" in content_types:
        parts.append(frames_in_range(frames, video_id, start, end).select(
            F.lit("frame").alias("result_type"), F.col("frame_id").alias("result_id"), "video_id",
            F.col("timestamp").alias("at"), F.lit(1.0).alias("relevance"), F.lit(1.0).alias("temporal_score")))
    if "audio" in content_types:
        parts.append(audio_in_range(audio, video_id, start, end).select(
            F.lit("audio_segment").alias("result_type"), F.col("segment_id").alias("result_id"), "video_id",
            F.col("start_time").alias("at"), F.lit(1.0).alias("relevance"), F.lit(1.0).alias("temporal_score")))
    if "entities" in content_types:
        parts.append(entities_in_range(entities, appearances, video_id, start, end).select(
            F.lit("entity").alias("result_type"), F.col("entity_id").alias("result_id"), "video_id",
            F.col("start_time").alias("at"), F.col("confidence").alias("relevance"), "temporal_score"))
    if not parts:
        raise ValueError("content_types must name at least one of frames, audio, entities")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    key = F.when(F.col("result_type") == "frame", F.col("at")).otherwise(F.lit(0.0)) if compat else F.col("at")
    return out.orderBy(key, "result_type", "result_id")


def video_timeline(
    videos: DataFrame, chunks: DataFrame, frames: DataFrame, audio: DataFrame, video_id: str | None = None
) -> DataFrame:
    """Chunks, frames and audio of known videos on one time axis: a tagged union, one row per item.

    Rows stay flat, so a video of any length is spread over tasks by the final range-partitioned sort.
    """

    def track(rows: DataFrame, kind: str, key: str, at: str, label: Column) -> DataFrame:
        return _of_video(rows, video_id).select(
            "video_id", F.lit(kind).alias("track"), F.col(key).alias("item_id"), F.col(at).alias("at"), label.alias("label")
        )

    items = (
        track(chunks, "chunk", "chunk_id", "start_time", F.col("unified_description"))
        .unionByName(track(frames, "frame", "frame_id", "timestamp", F.col("caption")))
        .unionByName(track(audio, "audio", "segment_id", "start_time", F.col("transcript")))
    )
    known = _of_video(videos, video_id).select("video_id")
    return items.join(known, "video_id", "left_semi").orderBy("video_id", "track", "at", "item_id")


def clips_matching(chunks: DataFrame, videos: DataFrame, query: str, top_k: int = 10) -> DataFrame:
    """Chunks of completed videos whose description holds any word of the query."""
    done = videos.filter(F.col("status") == "completed").select("video_id", "filename")
    hits = chunks.filter(text.any_word_in(F.col("unified_description"), query)).join(done, "video_id")
    return hits.select(
        F.lit("clip").alias("type"), "video_id", F.col("chunk_id").alias("item_id"),
        clock.seconds_to_timestamp(F.col("start_time")).alias("at"), F.lit(0.8).alias("confidence"),
    ).orderBy(F.desc("confidence"), "video_id", "item_id").limit(top_k)


def frames_matching(frames: DataFrame, videos: DataFrame, query: str, top_k: int = 10) -> DataFrame:
    """Frames of completed videos whose caption holds any word of the query, best confidence first."""
    done = videos.filter(F.col("status") == "completed").select("video_id", "filename")
    hits = frames.filter(text.any_word_in(F.col("caption"), query)).join(done, "video_id")
    return hits.select(
        F.lit("frame").alias("type"), "video_id", F.col("frame_id").alias("item_id"),
        clock.seconds_to_timestamp(F.col("timestamp")).alias("at"), "confidence",
    ).orderBy(F.desc("confidence"), "video_id", "item_id").limit(top_k)


def entities_matching(entities: DataFrame, query: str, top_k: int = 10) -> DataFrame:
    """Entities whose name or description holds the whole query, each once."""
    hits = entities.filter(text.contains_ci(F.col("name"), query) | text.contains_ci(F.col("description"), query))
    return hits.select(
        F.lit("entity").alias("type"), F.lit(None).cast("string").alias("video_id"), F.col("entity_id").alias("item_id"),
        F.lit(None).cast("string").alias("at"), "confidence",
    ).orderBy(F.desc("confidence"), "item_id").limit(top_k)


def query_library(
    videos: DataFrame, chunks: DataFrame, frames: DataFrame, entities: DataFrame, query: str, return_type: str = "clips",
    top_k: int = 10,
) -> DataFrame:
    """Clips, frames or entities matching a query by words; an unknown return type gives no rows."""
    if return_type == "frames":
        return frames_matching(frames, videos, query, top_k)
    if return_type == "entities":
        return entities_matching(entities, query, top_k)
    found = clips_matching(chunks, videos, query, top_k)
    return found if return_type == "clips" else found.filter(F.lit(False))


def phrase_relevance(query: str, content: Column) -> Column:
    """How often the first three words of ``content`` occur in the query, counted without overlap."""
    q = query.lower()
    phrase = F.array_join(F.slice(text.words_of(F.lower(content)), 1, 3), " ")
    removed = F.lit(len(q)) - F.length(F.replace(F.lit(q), phrase, F.lit("")))
    return F.when(phrase == "", F.lit(float(len(q) + 1))).otherwise(removed / F.length(phrase))


def hybrid_search(
    videos: DataFrame, frames: DataFrame, audio: DataFrame, vector_hits: DataFrame | None, query: str,
    video_id: str | None = None, top_k: int = 10, text_weight: float = 0.6, vector_weight: float = 0.4,
    compat: bool = False,
) -> DataFrame:
    """Text and vector hits with their weighted scores summed per item.

    ``vector_hits`` holds the 2k nearest rows with their similarity.  Items meet on (type, source id);
    with ``compat`` the vector leg keeps its own entry ids, which never meet those of the text leg.
    """
    wide = top_k * 2

    def leg(rows, kind, key, content):
        return rows.select(
            F.lit(kind).alias("type"), F.col(key).alias("id"),
            (phrase_relevance(query, F.col(content)) * F.lit(text_weight)).alias("text_score"),
            F.lit(0.0).alias("vector_score"),
        )

    legs = leg(search_frames(frames, videos, query, video_id, wide), "frame", "frame_id", "caption").unionByName(
        leg(search_audio(audio, videos, query, video_id, wide), "audio", "segment_id", "transcript")
    )
    if vector_hits is not None:
        legs = legs.unionByName(vector_hits.select(
            F.col("source_type").alias("type"), F.col("entry_id" if compat else "source_id").alias("id"),
            F.lit(0.0).alias("text_score"), (F.col("similarity") * F.lit(vector_weight)).alias("vector_score"),
        ))
    scored = legs.groupBy("type", "id").agg(
        F.max("text_score").alias("text_score"), F.max("vector_score").alias("vector_score")
    )
    total = F.col("text_score") + F.col("vector_score")
    return scored.withColumn("total_score", total).orderBy(F.desc("total_score"), "type", "id").limit(top_k)
