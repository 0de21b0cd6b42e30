"""Ingest of every document as a medium of words, with offline models that SQL can state."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgraph.models.inference import VECTOR, Model, fixed_text
from reelgraph.plans.ingest import Models, TextReel, ingest
from reelgraph.sources import driver_tables as dt
from reelgraph.workload.registry import query


def _measures(_, values):
    return [[float(len(v)), float(v.count("e" if isinstance(v, str) else b"e")), float(v.count(" " if isinstance(v, str) else b" ")), 1.0] for v in values]


MODELS = Models(
    fixed_text("shows", lambda image: "shows " + image.decode()), fixed_text("says", lambda sound: sound.decode()),
    Model("text-measures", lambda: None, _measures, VECTOR), Model("image-measures", lambda: None, _measures, VECTOR),
)


@query(
    "ingest_videos", "UDF9 MNT5 SRC8 UDF4",
    sql=r"""
WITH files AS (
    SELECT 'reels/' || doc_id || '.txt' AS path, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), known AS (
    SELECT substr(md5(path), 1, 16) AS video_id, path, w, len(w) AS n FROM files
), cut AS (
    SELECT video_id, n, i, 30.0::DOUBLE * i AS s, least(30.0::DOUBLE * (i + 1), n::DOUBLE) AS e, list_slice(w, 30 * i + 1, 30 * i + 30) AS part,
           video_id || '_chunk_' || lpad(i::VARCHAR, 4, '0') AS chunk_id
    FROM (SELECT *, unnest(range(0, (n + 29) // 30)) AS i FROM known WHERE n > 0)
), bad AS (
    SELECT DISTINCT video_id FROM cut WHERE contains(array_to_string(part, ' '), 'token = ')
), good AS (
    SELECT *, array_to_string(part, ' ') AS said, len(part) AS m,
           CASE WHEN len(part) <= 5 THEN range(0, len(part)) ELSE list_transform(range(0, 5), lambda j: floor(j * len(part) / 5.0::DOUBLE)::BIGINT) END AS places
    FROM cut ANTI JOIN bad USING (video_id)
), shots AS (
    SELECT video_id, chunk_id, s, unnest(places) AS k, unnest(range(0, len(places))) AS no, part FROM good
), frames AS (
    SELECT video_id, chunk_id, chunk_id || '_frame_' || lpad(no::VARCHAR, 4, '0') AS frame_id, no, s + k AS timestamp, part[k + 1] AS word FROM shots
), shown AS (
    SELECT chunk_id, string_agg('shows ' || word, ' | ' ORDER BY no) AS v, first(word ORDER BY no) AS word FROM frames WHERE no < 3 GROUP BY chunk_id
), chunks AS (
    SELECT good.*, 'Visual: ' || v || ' || Audio: ' || said[1:200] AS d, word FROM good JOIN shown USING (chunk_id)
), sums AS (
    SELECT *, (length(d) + strlen(word)) / 2.0 AS a, (length(d) - length(replace(d, 'e', '')) + length(word) - length(replace(word, 'e', ''))) / 2.0 AS b,
           (length(d) - length(replace(d, ' ', ''))) / 2.0 AS c FROM chunks
), units AS (
    SELECT *, sqrt(a::DOUBLE * a + b::DOUBLE * b + c::DOUBLE * c + 1.0) AS u FROM sums
)
SELECT 'video' AS kind, video_id AS id, video_id, 0.0::DOUBLE AS start_time,
       CASE WHEN n = 0 OR video_id IN (SELECT video_id FROM bad) THEN 0.0::DOUBLE ELSE n::DOUBLE END AS end_time,
       CASE WHEN n = 0 THEN 'ValueError: no frames' WHEN video_id IN (SELECT video_id FROM bad) THEN 'ValueError: protected'
            ELSE ((n + 29) // 30) || ' chunks, ' || (n // 30 * 5 + least(n % 30, 5)) || ' frames' END AS content,
       NULL::DOUBLE AS v0, NULL::DOUBLE AS v1, NULL::DOUBLE AS v2, NULL::DOUBLE AS v3 FROM known
UNION ALL SELECT 'chunk', chunk_id, video_id, s, e, md5(d), NULL, NULL, NULL, NULL FROM chunks
UNION ALL SELECT 'frame', frame_id, video_id, timestamp, NULL, 'shows ' || word, NULL, NULL, NULL, NULL FROM frames
UNION ALL SELECT 'audio', chunk_id || '_audio', video_id, s, e, md5(said), NULL, NULL, NULL, NULL FROM good
UNION ALL SELECT 'vector', 'chunk_' || chunk_id, video_id, s, NULL, 'chunk', (a / u)::FLOAT::DOUBLE, (b / u)::FLOAT::DOUBLE, (c / u)::FLOAT::DOUBLE,
       (1.0 / u)::FLOAT::DOUBLE FROM units
UNION ALL SELECT 'vector', 'frame_' || frame_id, video_id, timestamp, NULL, 'frame', strlen(word)::DOUBLE,
       (length(word) - length(replace(word, 'e', '')))::DOUBLE, 0.0, 1.0 FROM frames
""",
)
def ingest_videos(spark, sf_dir):
    files = dt.table(spark, sf_dir, "documents").select(
        F.format_string("reels/%d.txt", "doc_id").alias("path"), F.lit(None).cast("bigint").alias("size_bytes"),
        F.lit(None).cast("double").alias("modified"), F.coalesce("text", F.lit("")).cast("binary").alias("content"),
    )
    made = ingest(files, TextReel, MODELS, now=0.0)
    nothing = F.lit(None).cast("double")

    def shaped(name, kind, key, start, end, content, *values):
        numbers = [(values[i] if values else nothing).alias(f"v{i}") for i in range(4)]
        return made[name].select(
            F.lit(kind).alias("kind"), F.col(key).alias("id"), "video_id", start.alias("start_time"), end.alias("end_time"), content.alias("content"), *numbers
        )

    counted = F.format_string("%d chunks, %d frames", "chunk_count", "frame_count")
    start, end = F.col("start_time"), F.col("end_time")
    return (
        shaped("videos", "video", "video_id", F.lit(0.0), F.col("duration"), F.when(F.col("success"), counted).otherwise(F.col("error_message")))
        .unionByName(shaped("chunks", "chunk", "chunk_id", start, end, F.md5("unified_description")))
        .unionByName(shaped("frames", "frame", "frame_id", F.col("timestamp"), nothing, F.col("caption")))
        .unionByName(shaped("audio_segments", "audio", "segment_id", start, end, F.md5("transcript")))
        .unionByName(shaped("vectors", "vector", "entry_id", F.col("timestamp"), nothing, F.col("source_type"), *[F.get("vector", F.lit(i)).cast("double") for i in range(4)]))
    )
