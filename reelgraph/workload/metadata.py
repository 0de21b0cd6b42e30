"""Search, listing, time-range and statistics queries over the metadata tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgraph.operators import knn, media_search as ms, stats
from reelgraph.sources import driver_tables as dt
from reelgraph.workload.registry import query
from reelgraph.workload.scalars import WORDS_SQL
from reelgraph.workload.vectors import COS


@query(
    "frame_caption_search", "JOI1",
    sql="""SELECT frame_id, video_id, filename, timestamp, confidence FROM frames JOIN videos USING (video_id)
           WHERE contains(lower(caption), 'with') ORDER BY confidence DESC, timestamp, frame_id LIMIT 50""",
    views="frames videos",
)
def frame_caption_search(spark, sf_dir):
    hits = ms.search_frames(dt.frames(spark, sf_dir), dt.videos(spark, sf_dir), "With")
    return hits.select("frame_id", "video_id", "filename", "timestamp", "confidence")


@query(
    "frame_caption_matches", "JOI1 FLT12",
    sql="""SELECT frame_id, video_id, filename FROM frames JOIN videos USING (video_id)
           WHERE contains(lower(caption), 'with')""",
    views="frames videos",
)
def frame_caption_matches(spark, sf_dir):
    hits = ms.search_frames(dt.frames(spark, sf_dir), dt.videos(spark, sf_dir), "with", limit=None)
    return hits.select("frame_id", "video_id", "filename")


@query(
    "transcript_search", "JOI2",
    sql="""SELECT segment_id, video_id, filename, start_time, end_time FROM audio_segments JOIN videos USING (video_id)
           WHERE contains(lower(transcript), 'tion') ORDER BY audio_segments.confidence DESC, start_time, segment_id
           LIMIT 50""",
    views="audio_segments videos",
)
def transcript_search(spark, sf_dir):
    hits = ms.search_audio(dt.audio_segments(spark, sf_dir), dt.videos(spark, sf_dir), "tion")
    return hits.select("segment_id", "video_id", "filename", "start_time", "end_time")


@query(
    "list_videos", "FLT9",
    sql="""SELECT video_id, filename, duration, created_at FROM videos WHERE success
           ORDER BY created_at DESC, video_id LIMIT 10 OFFSET 5""",
    views="videos",
)
def list_videos(spark, sf_dir):
    return ms.list_videos(dt.videos(spark, sf_dir), 10, 5).select("video_id", "filename", "duration", "created_at")


@query(
    "browse_videos", "FLT10",
    sql="""SELECT video_id, status, round(size_bytes / 1048576.0::DOUBLE, 6) AS size_mb FROM videos
           WHERE status = 'completed'""",
    views="videos",
)
def browse_videos(spark, sf_dir):
    rows = ms.browse_videos(dt.videos(spark, sf_dir), "completed", "duration")
    return rows.select("video_id", "status", F.round("size_mb", 6).alias("size_mb"))


@query(
    "video_details", "FLT8",
    sql="""SELECT video_id, filename, chunk_count,
             (SELECT count(*) FROM frames f WHERE f.video_id = '7') AS frames_total,
             (SELECT count(*) FROM entity_videos e WHERE e.video_id = 'v7') AS entities_total
           FROM videos WHERE video_id = '7'""",
    views="videos frames entity_videos",
)
def video_details(spark, sf_dir):
    ev = dt.entity_videos(spark, sf_dir).withColumn("video_id", F.expr("substr(video_id, 2)"))
    rows = ms.video_details(dt.videos(spark, sf_dir), dt.frames(spark, sf_dir), ev, ev, "7")
    return rows.select("video_id", "filename", "chunk_count", "frames_total", "entities_total")


@query(
    "video_timeline", "JOI3",
    sql="""SELECT i.* FROM (
             SELECT video_id, 'chunk' AS track, chunk_id AS item_id, start_time AS at, md5(unified_description) AS label FROM chunks
             UNION ALL SELECT video_id, 'frame', frame_id, timestamp, md5(caption) FROM frames
             UNION ALL SELECT video_id, 'audio', segment_id, start_time, md5(transcript) FROM audio_segments) i
           SEMI JOIN videos USING (video_id)""",
    views="chunks frames audio_segments videos",
)
def video_timeline(spark, sf_dir):
    rows = ms.video_timeline(
        dt.videos(spark, sf_dir), dt.chunks(spark, sf_dir), dt.frames(spark, sf_dir), dt.audio_segments(spark, sf_dir)
    )
    return rows.withColumn("label", F.md5("label"))


@query(
    "timerange_frames", "FLT11",
    sql="SELECT frame_id, timestamp FROM frames WHERE video_id = '7' AND timestamp BETWEEN 30 AND 150",
    views="frames",
)
def timerange_frames(spark, sf_dir):
    return ms.frames_in_range(dt.frames(spark, sf_dir), "7", 30.0, 150.0).select("frame_id", "timestamp")


@query(
    "timerange_audio", "JOI4",
    sql="""SELECT segment_id, start_time, end_time FROM audio_segments WHERE video_id = '7'
           AND ((start_time BETWEEN 45 AND 75) OR (end_time BETWEEN 45 AND 75) OR (start_time <= 45 AND end_time >= 75))""",
    views="audio_segments",
)
def timerange_audio(spark, sf_dir):
    rows = ms.audio_in_range(dt.audio_segments(spark, sf_dir), "7", 45.0, 75.0)
    return rows.select("segment_id", "start_time", "end_time")


DAY = "2024-01-05"
DAY_START = 1704412800.0 + 3600.0
DAY_END = DAY_START + 6 * 3600.0


@query(
    "timerange_entities", "JOI5",
    sql=f"""SELECT entity_id, name, round(start_time, 3) AS start_time,
              round(least(end_time, {DAY_END}) - greatest(start_time, {DAY_START}), 3) AS overlap,
              round((least(end_time, {DAY_END}) - greatest(start_time, {DAY_START})) / {DAY_END - DAY_START}, 6) AS temporal_score,
              confidence AS relevance
            FROM appearances JOIN entities USING (entity_id)
            WHERE video_id = '{DAY}' AND NOT (end_time < {DAY_START} OR start_time > {DAY_END})""",
    views="appearances entities",
)
def timerange_entities(spark, sf_dir):
    rows = ms.entities_in_range(dt.entities(spark, sf_dir), dt.appearances(spark, sf_dir), DAY, DAY_START, DAY_END)
    return rows.select(
        "entity_id", "name", F.round("start_time", 3).alias("start_time"), F.round("overlap", 3).alias("overlap"),
        F.round("temporal_score", 6).alias("temporal_score"), F.col("confidence").alias("relevance"),
    )


@query(
    "timerange_union", "SET2",
    sql="""SELECT 'frame' AS result_type, frame_id AS result_id, timestamp AS at, 1.0::DOUBLE AS relevance FROM frames
             WHERE video_id = '5' AND timestamp BETWEEN 20 AND 100
           UNION ALL SELECT 'audio_segment', segment_id, start_time, 1.0 FROM audio_segments
             WHERE video_id = '5' AND start_time <= 100 AND end_time >= 20
           UNION ALL SELECT 'entity', e.entity_id, start_time, e.confidence FROM entities e JOIN (
             SELECT 'C' || conv_id AS entity_id, conv_id::VARCHAR AS video_id, turn * 30.0 AS start_time,
                    turn * 30.0 + 30.0 AS end_time FROM conversations WHERE role = 'user') a USING (entity_id)
             WHERE video_id = '5' AND start_time <= 100 AND end_time >= 20""",
    views="frames audio_segments entities",
)
def timerange_union(spark, sf_dir):
    audio = dt.audio_segments(spark, sf_dir)
    speaking = audio.filter(F.col("speaker") == "user").select(
        F.concat(F.lit("C"), "video_id").alias("entity_id"), "video_id", "start_time", "end_time"
    )
    rows = ms.content_in_range(dt.frames(spark, sf_dir), audio, dt.entities(spark, sf_dir), speaking, "5", 20.0, 100.0)
    return rows.select("result_type", "result_id", "at", "relevance")


@query(
    "search_library", "SET3",
    sql="""SELECT * FROM (SELECT 'video' AS kind, video_id AS item_id, video_id, filename AS label, 0.0::DOUBLE AS at FROM videos
             WHERE success ORDER BY created_at DESC, video_id LIMIT 20)
           UNION ALL SELECT * FROM (SELECT 'frame', frame_id, video_id, filename, timestamp
             FROM frames JOIN videos USING (video_id) WHERE contains(lower(caption), 'the')
             ORDER BY confidence DESC, timestamp, frame_id LIMIT 20)
           UNION ALL SELECT * FROM (SELECT 'audio_segment', segment_id, video_id, filename, start_time
             FROM audio_segments a JOIN videos USING (video_id) WHERE contains(lower(transcript), 'the')
             ORDER BY a.confidence DESC, start_time, segment_id LIMIT 20)""",
    views="frames audio_segments videos",
)
def search_library(spark, sf_dir):
    return ms.search_library(
        dt.videos(spark, sf_dir), dt.frames(spark, sf_dir), dt.audio_segments(spark, sf_dir), "the", limit=20
    )


@query(
    "any_word_clips", "FLT12 TOP6",
    sql="""SELECT 'clip' AS type, video_id, chunk_id AS item_id, 0.8::DOUBLE AS confidence
           FROM chunks JOIN videos USING (video_id)
           WHERE status = 'completed' AND (contains(lower(unified_description), 'schi') OR contains(lower(unified_description), 'tion'))
           ORDER BY video_id, chunk_id LIMIT 25""",
    views="chunks videos",
)
def any_word_clips(spark, sf_dir):
    rows = ms.clips_matching(dt.chunks(spark, sf_dir), dt.videos(spark, sf_dir), "Schi tion", 25)
    return rows.select("type", "video_id", "item_id", "confidence")


@query(
    "any_word_frames", "FLT12 TOP6",
    sql="""SELECT 'frame' AS type, video_id, frame_id AS item_id, confidence FROM frames JOIN videos USING (video_id)
           WHERE status = 'completed' AND (contains(lower(caption), 'schi') OR contains(lower(caption), 'tion'))
           ORDER BY confidence DESC, video_id, frame_id LIMIT 25""",
    views="frames videos",
)
def any_word_frames(spark, sf_dir):
    rows = ms.frames_matching(dt.frames(spark, sf_dir), dt.videos(spark, sf_dir), "schi tion", 25)
    return rows.select("type", "video_id", "item_id", "confidence")


@query(
    "entity_text_matches", "FLT13 TOP6",
    sql="""SELECT 'entity' AS type, entity_id AS item_id, confidence FROM entities
           WHERE contains(lower(name), 'wid') OR contains(lower(description), 'wid')
           ORDER BY confidence DESC, entity_id LIMIT 25""",
    views="entities",
)
def entity_text_matches(spark, sf_dir):
    return ms.entities_matching(dt.entities(spark, sf_dir), "WID", 25).select("type", "item_id", "confidence")


def _phrase(column: str) -> str:
    first = f"array_to_string(({WORDS_SQL.format(f'lower({column})')})[1:3], ' ')"
    return (f"CASE WHEN {first} = '' THEN 9.0 ELSE (8 - length(replace('tion the', {first}, '')))::DOUBLE "
            f"/ length({first}) END * 0.6")


@query(
    "hybrid_search", "JOI16",
    sql=f"""
    WITH tf AS (SELECT * FROM frames JOIN videos USING (video_id) WHERE contains(lower(caption), 'tion the')
                ORDER BY confidence DESC, timestamp, frame_id LIMIT 20),
         ta AS (SELECT a.*, filename FROM audio_segments a JOIN videos USING (video_id)
                WHERE contains(lower(transcript), 'tion the') ORDER BY a.confidence DESC, start_time, segment_id LIMIT 20),
         vs AS (SELECT source_type, source_id, {COS} AS s FROM vectors v,
                  (SELECT vector AS qv FROM vectors WHERE entry_id = '0') q
                WHERE {COS} >= 0 ORDER BY {COS} DESC, entry_id LIMIT 20),
         t AS (SELECT 'frame' AS type, frame_id AS id, {_phrase('caption')} AS ts FROM tf
               UNION ALL SELECT 'audio', segment_id, {_phrase('transcript')} FROM ta)
    SELECT coalesce(t.type, vs.source_type) AS type, coalesce(t.id, vs.source_id) AS id,
           round(coalesce(ts, 0), 6) AS text_score, round(coalesce(s * 0.4, 0), 6) AS vector_score,
           round(coalesce(ts, 0) + coalesce(s * 0.4, 0), 6) AS total_score
    FROM t FULL OUTER JOIN vs ON t.type = vs.source_type AND t.id = vs.source_id
    ORDER BY coalesce(ts, 0) + coalesce(s * 0.4, 0) DESC, type, id LIMIT 10""",
    views="frames videos audio_segments vectors",
)
def hybrid_search(spark, sf_dir):
    v = dt.vectors(spark, sf_dir)
    near = knn.top_k(v, knn.lookup_vector(v, "0"), 20)
    rows = ms.hybrid_search(
        dt.videos(spark, sf_dir), dt.frames(spark, sf_dir), dt.audio_segments(spark, sf_dir), near, "tion the"
    )
    return rows.select("type", "id", *[F.round(c, 6).alias(c) for c in ("text_score", "vector_score", "total_score")])


@query(
    "metadata_stats", "AGG3 AGG4",
    sql="""SELECT 'total_videos' AS metric, count(*)::DOUBLE AS value FROM videos
           UNION ALL SELECT 'successful_videos', count(*) FILTER (success) FROM videos
           UNION ALL SELECT 'total_hours', round(coalesce(sum(duration) FILTER (success), 0) / 3600, 6) FROM videos
           UNION ALL SELECT 'total_chunks', count(*) FROM chunks UNION ALL SELECT 'total_frames', count(*) FROM frames
           UNION ALL SELECT 'total_audio_segments', count(*) FROM audio_segments""",
    views="videos chunks frames audio_segments",
)
def metadata_stats(spark, sf_dir):
    rows = stats.metadata_stats(
        dt.videos(spark, sf_dir), dt.chunks(spark, sf_dir), dt.frames(spark, sf_dir), dt.audio_segments(spark, sf_dir)
    )
    return rows.withColumn("value", F.round("value", 6))


@query(
    "library_stats", "AGG5",
    sql="""SELECT 'total_videos' AS metric, count(*)::DOUBLE AS value FROM videos
           UNION ALL SELECT 'completed_videos', count(*) FILTER (status = 'completed') FROM videos
           UNION ALL SELECT 'failed_videos', count(*) FILTER (status = 'failed') FROM videos
           UNION ALL SELECT 'open_videos', count(*) FILTER (status IN ('pending', 'processing')) FROM videos
           UNION ALL SELECT 'total_duration', sum(duration) FROM videos
           UNION ALL SELECT 'total_frames', count(*) FROM frames UNION ALL SELECT 'total_entities', count(*) FROM entities
           UNION ALL SELECT 'total_relations', count(*) FROM relations""",
    views="videos frames entities relations",
)
def library_stats(spark, sf_dir):
    return stats.library_stats(
        dt.videos(spark, sf_dir), dt.frames(spark, sf_dir), dt.entities(spark, sf_dir), dt.relations(spark, sf_dir)
    )


@query(
    "graph_type_counts", "AGG2",
    sql="""SELECT 'entity' AS scope, entity_type AS value, count(*) AS n FROM entities GROUP BY ALL
           UNION ALL SELECT 'entity', '', count(*) FROM entities
           UNION ALL SELECT 'relation', relation_type, count(*) FROM relations GROUP BY ALL
           UNION ALL SELECT 'relation', '', count(*) FROM relations""",
    views="entities relations",
)
def graph_type_counts(spark, sf_dir):
    return stats.type_counts(dt.entities(spark, sf_dir), dt.relations(spark, sf_dir))


def _by_graph(spark, sf_dir):
    """Entities and relations of one graph per source letter; a graph without relations is kept."""
    e = dt.entities(spark, sf_dir).withColumn("graph_id", F.substring("entity_id", 1, 1))
    r = dt.relations(spark, sf_dir).withColumn("graph_id", F.substring("source_entity", 1, 1))
    return stats.graph_rows(e, e, r)


@query(
    "per_graph_counts", "AGG2",
    sql="""SELECT g.graph_id, g.entities, coalesce(r.relations, 0) AS relations
           FROM (SELECT substr(entity_id, 1, 1) AS graph_id, count(*) AS entities FROM entities GROUP BY 1) g
           LEFT JOIN (SELECT substr(source_entity, 1, 1) AS graph_id, count(*) AS relations FROM relations GROUP BY 1) r
             USING (graph_id)""",
    views="entities relations",
)
def per_graph_counts(spark, sf_dir):
    return _by_graph(spark, sf_dir)


@query(
    "graph_averages", "AGG6",
    sql="""WITH g AS (SELECT substr(entity_id, 1, 1) AS graph_id, count(*) AS n FROM entities GROUP BY 1)
           SELECT 'graphs' AS metric, count(*)::DOUBLE AS value FROM g
           UNION ALL SELECT 'mean_entities', round(avg(n), 6) FROM g
           UNION ALL SELECT 'mean_relations', round((SELECT count(*) FROM relations) / count(*)::DOUBLE, 6) FROM g""",
    views="entities relations",
)
def graph_averages(spark, sf_dir):
    return stats.graph_averages(_by_graph(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(
    "queue_status", "AGG7",
    sql="""SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing,
             count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
             count(*) FILTER (status IN ('pending', 'processing')) AS queue,
             round(avg(processing_time) FILTER (status = 'completed') * count(*) FILTER (status IN ('pending', 'processing')), 6)
               AS eta_seconds
           FROM videos""",
    views="videos",
)
def queue_status(spark, sf_dir):
    return stats.queue_status(dt.videos(spark, sf_dir)).withColumn("eta_seconds", F.round("eta_seconds", 6))


@query(
    "performance_metrics", "AGG8",
    sql="""WITH c AS (SELECT coalesce(sum(processing_time) FILTER (status = 'completed'), 0) AS t,
                        count(*) FILTER (status = 'completed') AS d, count(*) FILTER (status = 'failed') AS f,
                        (SELECT count(*) FROM frames) AS u FROM videos)
           SELECT round(t, 6) AS total_processing_time, round(t / d, 6) AS mean_processing_time,
                  round(d / (d + f)::DOUBLE, 6) AS success_rate, round(d / 2.0, 6)::DOUBLE AS videos_per_hour,
                  round(u / 512.0, 6)::DOUBLE AS frames_per_mb
           FROM c""",
    views="videos frames",
)
def performance_metrics(spark, sf_dir):
    rows = stats.performance_metrics(dt.videos(spark, sf_dir), dt.frames(spark, sf_dir), 2.0, 512.0)
    return rows.select(*[F.round(c, 6).alias(c) for c in rows.columns])
