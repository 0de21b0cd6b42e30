"""Conversation queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reelgraph.models.inference import fixed_text
from reelgraph.operators import conversation as cv
from reelgraph.session import ensure_checkpoint_dir
from reelgraph.sources import answer_store, driver_tables as dt
from reelgraph.workload.registry import query


@query(
    "recent_context", "WIN8",
    sql="""WITH d AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY seq DESC) AS r FROM messages
                      WHERE role IN ('user', 'assistant')),
           j AS (SELECT conversation_id, string_agg(CASE role WHEN 'user' THEN 'User asked: ' ELSE 'Assistant responded about: ' END
                   || content[1:100] || '...', ' | ' ORDER BY seq) AS context FROM d WHERE r <= 5 GROUP BY 1)
           SELECT DISTINCT conversation_id, coalesce(context, 'No previous conversation context.') AS context
           FROM messages LEFT JOIN j USING (conversation_id)""",
    views="messages",
)
def recent_context(spark, sf_dir):
    return cv.recent_context(dt.messages(spark, sf_dir))


@query(
    "conversation_trim", "WIN9",
    sql="""WITH c AS (SELECT *, count(*) OVER (PARTITION BY conversation_id) AS n,
                        row_number() OVER (PARTITION BY conversation_id, role = 'system' ORDER BY seq DESC) AS r FROM messages)
           SELECT conversation_id, seq, role FROM c WHERE n <= 4 OR role = 'system' OR r <= 2""",
    views="messages",
)
def conversation_trim(spark, sf_dir):
    return cv.trim(dt.messages(spark, sf_dir), 4).select("conversation_id", "seq", "role")


@query(
    "chat_history", "CH2",
    sql="""SELECT conversation_id, seq, role, md5(content) AS content FROM (
             SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY seq DESC) AS r FROM messages
             WHERE role IN ('user', 'assistant')) WHERE r <= 6""",
    views="messages",
)
def chat_history(spark, sf_dir):
    return cv.history(dt.messages(spark, sf_dir), 6).select("conversation_id", "seq", "role", F.md5("content").alias("content"))


@query(
    "conversation_list", "CH6 CH1",
    sql="""WITH f AS (SELECT video_id AS conversation_id, count(*) AS frame_count FROM frames GROUP BY 1)
           SELECT conversation_id, count(*) AS message_count, max(timestamp) AS last_updated,
                  coalesce(any_value(frame_count), 0) AS frame_count,
                  CASE WHEN any_value(frame_count) IS NULL THEN 0 ELSE 1 END::BIGINT AS video_count
           FROM messages LEFT JOIN f USING (conversation_id) GROUP BY conversation_id""",
    views="messages frames",
)
def conversation_list(spark, sf_dir):
    active = dt.frames(spark, sf_dir).select(F.col("video_id").alias("conversation_id"), "frame_id", "video_id")
    rows = cv.list_conversations(dt.messages(spark, sf_dir), active)
    return rows.select("conversation_id", "message_count", "last_updated", "frame_count", "video_count")


@query(
    "conversation_finished", "CH7",
    sql="""SELECT conversation_id, count(*) AS message_count, round((max(timestamp) - min(timestamp)) / 3600, 6) AS duration_hours
           FROM messages GROUP BY 1 HAVING count(*) >= 3""",
    views="messages",
)
def conversation_finished(spark, sf_dir):
    return cv.finished(dt.messages(spark, sf_dir)).withColumn("duration_hours", F.round("duration_hours", 6))


@query(
    "frame_reasoning", "CH4 JOI9",
    sql="""WITH r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp, frame_id) AS p FROM frames)
           SELECT video_id, count(*) AS frames, max(timestamp) - min(timestamp) AS temporal_span,
                  md5(string_agg('Frame ID: ' || frame_id || chr(10) || 'Video: ' || video_id || chr(10)
                      || printf('Timestamp: %.2fs', timestamp) || chr(10) || 'Visual Content: ' || caption
                      || CASE WHEN confidence <> 0 THEN chr(10) || printf('Analysis Confidence: %.2f', confidence) ELSE '' END,
                      chr(10) || chr(10) ORDER BY p)) AS prompt
           FROM r WHERE p <= 5 GROUP BY video_id""",
    views="frames",
)
def frame_reasoning(spark, sf_dir):
    return cv.frame_set(dt.frames(spark, sf_dir), first=5).withColumn("prompt", F.md5("prompt"))


@query(
    "distinct_analyses", "CH3",
    sql="SELECT DISTINCT n_chars % 50 AS frame, lang AS prompt FROM documents",
)
def distinct_analyses(spark, sf_dir):
    """Analysis requests with repeats, each kept once before a model would see it."""
    asks = dt.table(spark, sf_dir, "documents").select((F.col("n_chars") % 50).alias("frame_id"), F.col("lang").alias("prompt"))
    return cv.distinct_analyses(asks).select(F.col("frame_id").alias("frame"), "prompt")


@query(
    "frame_answers", "CH3 RET7 UDF2",
    sql="""SELECT frame_id, prompt, confidence >= 0.5 AS reused,
                  CASE WHEN confidence >= 0.5 THEN 'first ' ELSE 'second ' END
                    || length(prompt || CASE WHEN caption IS NULL THEN '' ELSE chr(10) || chr(10) || caption END) AS answer
           FROM frames, (VALUES ('What is shown?'), ('Who is shown?')) p(prompt)""",
    views="frames",
)
def frame_answers(spark, sf_dir):
    """Two questions about every frame; a run before has asked about the confident ones, and only the rest reaches the second model."""
    path = f"{ensure_checkpoint_dir(spark)}/answers-{uuid.uuid4().hex}"
    asked = F.explode(F.array(F.lit("What is shown?"), F.lit("Who is shown?")))
    requests = dt.frames(spark, sf_dir).select("frame_id", "confidence", F.col("caption").alias("content"), asked.alias("prompt"))
    answer_store.ask(requests.where("confidence >= 0.5"), path, fixed_text("describer", lambda q: f"first {len(q)}"), now=0.0)
    rows = answer_store.ask(requests, path, fixed_text("describer", lambda q: f"second {len(q)}"), now=1.0)
    return rows.select("frame_id", "prompt", "reused", "answer")


@query(
    "transcript_log", "JOI15",
    sql="""SELECT video_id, start_time, md5('[' || printf('%02d:%06.3f', floor(start_time / 60)::BIGINT, start_time % 60) || '-'
              || printf('%02d:%06.3f', floor(end_time / 60)::BIGINT, end_time % 60) || '] ' || transcript) AS line FROM audio_segments""",
    views="audio_segments",
)
def transcript_log(spark, sf_dir):
    return cv.transcript_log(dt.audio_segments(spark, sf_dir)).withColumn("line", F.md5("line"))


@query(
    "video_content", "JOI15",
    sql="""WITH t AS (SELECT 'chunk' AS section, chunk_id AS item_id, video_id, start_time, end_time, unified_description AS content FROM chunks
                      UNION ALL SELECT 'transcript', chunk_id, video_id, start_time, end_time, transcript FROM audio_segments WHERE coalesce(transcript, '') <> '')
           SELECT video_id, section, item_id, printf('%02d:%06.3f', floor(start_time / 60)::BIGINT, start_time % 60) AS start_stamp,
                  printf('%02d:%06.3f', floor(end_time / 60)::BIGINT, end_time % 60) AS end_stamp, md5(content) AS content, NULL::DOUBLE AS confidence FROM t
           UNION ALL SELECT video_id, 'entity', entity_id, NULL, NULL,
                  md5(name || ' (' || entity_type || ')' || CASE WHEN description <> '' THEN ': ' || description ELSE '' END), confidence
           FROM (SELECT DISTINCT entity_id, video_id FROM entity_videos) JOIN entities USING (entity_id)""",
    views="chunks audio_segments entities entity_videos",
)
def video_content(spark, sf_dir):
    """Chunks, transcripts and entities of every video."""
    rows = cv.video_content(dt.chunks(spark, sf_dir), dt.audio_segments(spark, sf_dir), dt.entities(spark, sf_dir), dt.entity_videos(spark, sf_dir))
    return rows.withColumn("content", F.md5("content")).drop("start_time", "end_time")


@query(
    "frames_by_id", "JOI9",
    sql="SELECT frame_id, video_id, timestamp FROM frames WHERE frame_id IN ('3', '5', '8', '120')",
    views="frames",
)
def frames_by_id(spark, sf_dir):
    rows = cv.target_frames(dt.frames(spark, sf_dir), ["3", "5", "8", "120"])
    return rows.select("frame_id", "video_id", "timestamp")
