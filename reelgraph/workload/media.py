"""Chunking and frame selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgraph.functions import clock
from reelgraph.operators import frames as fr
from reelgraph.sources import driver_tables as dt
from reelgraph.workload.registry import query


def media(spark, sf_dir):
    """The videos with frame rates and odd lengths."""
    k = F.col("video_id").cast("long")
    rows = dt.videos(spark, sf_dir).withColumn("duration", F.col("duration") - (k % 7) * 1.5).withColumn("fps", 24.0 + (k % 3) * 3.0)
    return rows.select("video_id", "duration", "fps", F.floor(F.col("duration") * F.col("fps")).alias("total_frames"))


MEDIA = """m AS (SELECT video_id, d AS duration, fps, floor(d * fps)::BIGINT AS total_frames FROM (
             SELECT video_id, duration - (video_id::BIGINT % 7) * 1.5::DOUBLE AS d, 24.0::DOUBLE + (video_id::BIGINT % 3) * 3.0 AS fps FROM videos))"""
CHUNKS = f"""{MEDIA},
    c AS (SELECT m.*, i AS chunk_index, i * 30.0::DOUBLE AS start_time, least((i + 1) * 30.0::DOUBLE, duration) AS end_time,
                 video_id || '_chunk_' || lpad(i::VARCHAR, 4, '0') AS chunk_id
          FROM m, LATERAL (SELECT unnest(range(0, ceil(duration / 30)::BIGINT)) AS i))"""


@query(
    "chunk_windows", "WIN7",
    sql=f"WITH {CHUNKS} SELECT chunk_id, start_time, end_time FROM c", views="videos",
)
def chunk_windows(spark, sf_dir):
    return fr.chunk_windows(media(spark, sf_dir)).select("chunk_id", "start_time", "end_time")


def _sampling_sql(n: int) -> str:
    return f"""WITH {CHUNKS},
      b AS (SELECT *, floor(start_time * fps)::BIGINT AS s, least(floor(end_time * fps)::BIGINT, total_frames) AS e FROM c),
      x AS (SELECT b.*, j, CASE WHEN e - s <= {n} THEN s + j ELSE floor(s + j * ((e - s) / {n}::DOUBLE))::BIGINT END AS frame_index
            FROM b, LATERAL (SELECT unnest(range(0, least({n}, e - s))) AS j))
      SELECT chunk_id || '_frame_' || lpad(j::VARCHAR, 4, '0') AS frame_id, frame_index, round(frame_index / fps, 6) AS timestamp FROM x"""


@query("frame_sampling", "WIN3", sql=_sampling_sql(5), views="videos")
def frame_sampling(spark, sf_dir):
    rows = fr.sample_frames(fr.chunk_windows(media(spark, sf_dir)), 5)
    return rows.select("frame_id", "frame_index", F.round("timestamp", 6).alias("timestamp"))


@query("frame_sampling_detailed", "WIN3", sql=_sampling_sql(15), views="videos")
def frame_sampling_detailed(spark, sf_dir):
    rows = fr.sample_frames(fr.chunk_windows(media(spark, sf_dir)), 15)
    return rows.select("frame_id", "frame_index", F.round("timestamp", 6).alias("timestamp"))


@query(
    "uniform_keyframes", "WIN4",
    sql=f"""WITH {MEDIA}
            SELECT video_id || '_keyframe_' || lpad(i::VARCHAR, 4, '0') AS frame_id, floor(i * (total_frames / 20.0::DOUBLE))::BIGINT AS frame_index
            FROM m, LATERAL (SELECT unnest(range(0, 20)) AS i)""",
    views="videos",
)
def uniform_keyframes(spark, sf_dir):
    return fr.uniform_keyframes(media(spark, sf_dir)).select("frame_id", "frame_index")


def event_signal(spark, sf_dir):
    """Each user's events as brightness samples: one frame per second since the first of January."""
    at = F.floor(clock.epoch_seconds(F.col("ts")) - 1704067200.0)
    rows = dt.table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("video_id"), at.alias("frame_index")).agg(
        F.max("value").alias("brightness")
    )
    videos = rows.groupBy("video_id").agg((F.max("frame_index") + 1).alias("total_frames")).withColumn("fps", F.lit(30000.0))
    return videos, rows


SIGNAL = """
    s AS (SELECT user_id::VARCHAR AS video_id, floor(epoch_us(ts) / 1e6 - 1704067200.0)::BIGINT AS f, max(value) AS b FROM events GROUP BY ALL),
    v AS (SELECT video_id, max(f) + 1 AS total FROM s GROUP BY 1),
    df AS (SELECT video_id, f, abs(b - lag(b) OVER (PARTITION BY video_id ORDER BY f)) AS d FROM s)"""


@query(
    "scene_keyframes", "WIN5",
    sql=f"""WITH RECURSIVE {SIGNAL},
      ch AS (SELECT video_id, f FROM df WHERE d > 30),
      k AS (SELECT video_id, 0::BIGINT AS f, 0 AS i FROM v
            UNION ALL SELECT video_id, f, i FROM (
              SELECT k.video_id, min(ch.f) AS f, k.i + 1 AS i FROM k JOIN ch ON ch.video_id = k.video_id AND ch.f - k.f > 60000
              WHERE k.i < 19 GROUP BY k.video_id, k.i)),
      g AS (SELECT video_id, count(*) AS n, max(f) AS m FROM k GROUP BY 1)
      SELECT video_id || '_scene_' || lpad(i::VARCHAR, 4, '0') AS frame_id, f AS frame_index FROM k
      UNION ALL SELECT video_id || '_scene_' || lpad(n::VARCHAR, 4, '0'), total - 1 FROM g JOIN v USING (video_id) WHERE n < 20 AND m <> total - 1""",
)
def scene_keyframes(spark, sf_dir):
    videos, samples = event_signal(spark, sf_dir)
    before = fr.previous_value(samples, "video_id", "frame_index", "brightness", "before", width=86400)
    diffs = before.filter(F.col("before").isNotNull()).select(
        "video_id", "frame_index", F.abs(F.col("brightness") - F.col("before")).alias("difference")
    )
    return fr.scene_keyframes(videos, diffs).select("frame_id", "frame_index")


@query(
    "motion_keyframes", "WIN6",
    sql=f"""WITH {SIGNAL},
      r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY b DESC, f DESC) AS rn FROM s),
      t AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY f) - 1 AS i FROM r WHERE rn <= 20)
      SELECT video_id || '_motion_' || lpad(i::VARCHAR, 4, '0') AS frame_id, f AS frame_index FROM t""",
)
def motion_keyframes(spark, sf_dir):
    _, samples = event_signal(spark, sf_dir)
    scores = samples.select("video_id", "frame_index", F.col("brightness").alias("motion"), F.lit(30000.0).alias("fps"))
    return fr.motion_keyframes(scores).select("frame_id", "frame_index")


@query(
    "unified_description", "SCA17",
    sql="""WITH r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY timestamp, frame_id) AS p FROM frames WHERE caption <> ''),
                c AS (SELECT chunk_id, string_agg(caption, ' | ' ORDER BY p) AS v FROM r WHERE p <= 3 GROUP BY 1)
           SELECT chunk_id, video_id, md5(concat_ws(' || ', 'Visual: ' || v, 'Audio: ' || transcript[1:200])) AS unified_description
           FROM audio_segments LEFT JOIN c USING (chunk_id)""",
    views="frames audio_segments",
)
def unified_description(spark, sf_dir):
    audio = dt.audio_segments(spark, sf_dir)
    rows = fr.chunk_descriptions(dt.chunks(spark, sf_dir), dt.frames(spark, sf_dir), audio)
    return rows.withColumn("unified_description", F.md5("unified_description"))
