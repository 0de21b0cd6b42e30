"""Retrieval legs, fusion and ranking.

The query vector is the one stored under key 0; thresholds suit its neighbourhood.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgraph.config import RetrievalSettings
from reelgraph.operators import knn, ranking
from reelgraph.plans import retrieval as R
from reelgraph.sources import driver_tables as dt
from reelgraph.workload.registry import query
from reelgraph.workload.scalars import relevance_sql
from reelgraph.workload.vectors import COS

SETTINGS = RetrievalSettings(similarity_threshold=0.2, confidence_threshold=0.12)
VIEWS = "frames videos audio_segments vectors entities aliases relations"


def _store(spark, sf_dir) -> R.MediaStore:
    return R.MediaStore(*[
        getattr(dt, n)(spark, sf_dir) for n in
        ("videos", "frames", "audio_segments", "vectors", "entities", "aliases", "entity_videos", "relations")
    ])


def _candidates(spark, sf_dir, text_query, strategy):
    store = _store(spark, sf_dir)
    ctx = R.understand(spark, text_query)
    return R.candidates(store, ctx, strategy, SETTINGS, knn.lookup_vector(store.vectors, "0"))


def _legs_sql(q: str, keywords: list[str], bonus: float = 0.0) -> str:
    """CTEs ``t`` (text), ``v`` (visual), ``e`` (entity), each with the columns of a result row."""
    th = SETTINGS.similarity_threshold
    return f"""
    ce AS (SELECT e.*, least(1.0, CASE WHEN contains(lower(name), '{q}') THEN 0.8 ELSE 0.0 END
                + {relevance_sql(q, 'description', keywords)} * 0.5
                + CASE WHEN EXISTS (SELECT 1 FROM aliases a WHERE a.entity_id = e.entity_id AND contains(lower(alias), '{q}'))
                       THEN 0.6 ELSE 0.0 END + {bonus} + confidence * 0.3)::DOUBLE AS s
           FROM entities e WHERE contains(lower(name), '{q}')),
    ne AS (SELECT * FROM ce WHERE s >= {th}),
    cf AS (SELECT f.*, {relevance_sql(q, 'caption', keywords)} AS s FROM (
             SELECT * FROM frames JOIN videos USING (video_id) WHERE contains(lower(caption), '{q}')) f
           ORDER BY s DESC, timestamp, frame_id LIMIT 10),
    ca AS (SELECT f.*, {relevance_sql(q, 'transcript', keywords)} AS s FROM (
             SELECT a.*, filename FROM audio_segments a JOIN videos USING (video_id) WHERE contains(lower(transcript), '{q}')) f
           ORDER BY s DESC, start_time, segment_id LIMIT 10),
    t AS (SELECT 1 AS leg, 'frame' AS result_type, frame_id AS result_id, video_id, timestamp AS at, NULL::DOUBLE AS until,
                 s AS relevance, s AS text_score, 0.0::DOUBLE AS visual_score, 0.0::DOUBLE AS entity_score,
                 'Caption match: ' || caption[1:50] || '...' AS explanation FROM cf WHERE s >= {th}
          UNION ALL SELECT 1, 'audio_segment', segment_id, video_id, start_time, end_time, s, s, 0, 0,
                 'Transcript match: ' || transcript[1:50] || '...' FROM ca WHERE s >= {th}
          UNION ALL SELECT 1, 'entity', entity_id, NULL, NULL, NULL, s, s, 0, 0,
                 'Entity match: ' || name || ' (' || entity_type || ')' FROM ne),
    qv AS (SELECT vector AS qv FROM vectors WHERE entry_id = '0'),
    sim AS (SELECT v.*, {COS} AS s FROM vectors v, qv q),
    vr AS (SELECT *, row_number() OVER (PARTITION BY source_type ORDER BY s DESC, entry_id) AS r FROM sim
           WHERE s >= {th} AND source_type <> 'entity'),
    v AS (SELECT 2 AS leg, source_type || '_embedding' AS result_type, source_id AS result_id, video_id, NULL::DOUBLE AS at,
                 NULL::DOUBLE AS until, s AS relevance, 0.0::DOUBLE AS text_score, s AS visual_score, 0.0::DOUBLE AS entity_score,
                 printf('Similar %s (%.3f)', source_type, s) AS explanation FROM vr WHERE r <= 5),
    nb AS (SELECT source_entity AS entity_id, target_entity AS other_id, relation_id, confidence AS strength FROM relations
           UNION ALL SELECT target_entity, source_entity, relation_id, confidence FROM relations
             WHERE source_entity <> target_entity),
    nr AS (SELECT nb.*, row_number() OVER (PARTITION BY entity_id ORDER BY strength DESC, other_id, relation_id) AS r
           FROM nb WHERE entity_id IN (SELECT entity_id FROM ne)),
    e0 AS (SELECT 3 AS leg, 'entity' AS result_type, entity_id AS result_id, NULL::VARCHAR AS video_id, NULL::DOUBLE AS at,
                 NULL::DOUBLE AS until, s AS relevance, 0.0::DOUBLE AS text_score, 0.0::DOUBLE AS visual_score, s AS entity_score,
                 'Entity: ' || name || ' (' || entity_type || ')' AS explanation FROM ne
          UNION ALL SELECT 3, 'related_entity', o.entity_id, NULL, NULL, NULL, ne.s * strength * 0.8, 0, 0, ne.s * strength * 0.8,
                 'Related to ' || ne.name || ': ' || o.name
          FROM nr JOIN ne USING (entity_id) JOIN entities o ON o.entity_id = nr.other_id
          WHERE r <= 3 AND ne.s * strength * 0.8 >= {th}),
    ev AS (SELECT * FROM sim WHERE source_type = 'entity' AND s >= {th}
             AND (EXISTS (SELECT 1 FROM entities WHERE contains(lower(name), '{q}'))
                  OR EXISTS (SELECT 1 FROM aliases WHERE contains(lower(alias), '{q}'))) ORDER BY s DESC, entry_id LIMIT 5),
    e AS (SELECT * FROM e0 UNION ALL SELECT 3, 'entity_embedding', source_id, video_id, NULL, NULL, s, 0, 0, s,
                 printf('Similar entity (%.3f)', s) FROM ev WHERE source_id NOT IN (SELECT result_id FROM e0)),
    al AS (SELECT * FROM t UNION ALL SELECT * FROM v UNION ALL SELECT * FROM e),
    mg AS (SELECT result_type, result_id, min(video_id) AS video_id, min("at") AS at, min(until) AS until, count(*) AS copies,
                  CASE WHEN count(*) > 1 THEN max(text_score) * 0.4 + max(visual_score) * 0.3 + max(entity_score) * 0.2
                       ELSE max(relevance) END AS relevance,
                  max(text_score) AS text_score, max(visual_score) AS visual_score, max(entity_score) AS entity_score
           FROM al GROUP BY result_type, result_id)"""


def _page_sql(source: str) -> str:
    """Threshold, diversity and rank over ``source``, stated over the whole result."""
    return f"""
    ok AS (SELECT *, count(*) OVER () AS n,
                  row_number() OVER (PARTITION BY coalesce(video_id, result_type || '/' || result_id)
                                     ORDER BY relevance DESC, result_type, result_id) AS rn
           FROM {source} WHERE relevance >= {SETTINGS.confidence_threshold}),
    dv AS (SELECT * FROM ok WHERE n <= 5 OR rn <= 3 ORDER BY relevance DESC, result_type, result_id LIMIT 30),
    rk AS (SELECT *, rank() OVER (ORDER BY relevance DESC) AS rank FROM dv)"""


def _leg(rows):
    return rows.select(
        "result_type", "result_id", "video_id", F.round("relevance", 6).alias("relevance"), "explanation"
    )


LEG_COLUMNS = "result_type, result_id, video_id, round(relevance, 6) AS relevance, explanation"


@query("text_leg", "RET3 SCA11", sql=f"WITH {_legs_sql('red', ['red'])} SELECT {LEG_COLUMNS} FROM t", views=VIEWS)
def text_leg(spark, sf_dir):
    return _leg(_candidates(spark, sf_dir, "red", "text"))


@query("visual_leg", "RET4", sql=f"WITH {_legs_sql('red', ['red'])} SELECT {LEG_COLUMNS} FROM v", views=VIEWS)
def visual_leg(spark, sf_dir):
    return _leg(_candidates(spark, sf_dir, "red", "visual"))


@query("entity_leg", "RET5 JOI10", sql=f"WITH {_legs_sql('red', ['red'])} SELECT {LEG_COLUMNS} FROM e", views=VIEWS)
def entity_leg(spark, sf_dir):
    return _leg(_candidates(spark, sf_dir, "red", "entity"))


@query(
    "merge_duplicates", "AGG18 SET1",
    sql=f"""WITH {_legs_sql('red', ['red'])}
    SELECT result_type, result_id, copies, round(relevance, 6) AS relevance, round(text_score, 6) AS text_score,
           round(visual_score, 6) AS visual_score, round(entity_score, 6) AS entity_score FROM mg""",
    views=VIEWS,
)
def merge_duplicates(spark, sf_dir):
    rows = _candidates(spark, sf_dir, "red", "hybrid")
    scores = ("relevance", "text_score", "visual_score", "entity_score")
    return rows.select("result_type", "result_id", "copies", *[F.round(c, 6).alias(c) for c in scores])


@query(
    "hybrid_retrieval", "RET1 RET2 RET6 TOP9 SET1 AGG18 WIN1 WIN2",
    sql=f"""WITH {_legs_sql('red', ['red'])}, {_page_sql('mg')}
    SELECT result_type, result_id, video_id, round(relevance, 6) AS relevance, rank FROM rk
    ORDER BY rank, result_type, result_id LIMIT 15""",
    views=VIEWS,
)
def hybrid_retrieval(spark, sf_dir):
    store = _store(spark, sf_dir)
    rows = R.retrieve(
        store, "Red", "hybrid", embed=lambda _: knn.lookup_vector(store.vectors, "0"), max_results=15, settings=SETTINGS
    )
    return rows.select("result_type", "result_id", "video_id", F.round("relevance", 6).alias("relevance"), "rank")


@query(
    "hybrid_retrieval_temporal", "TMP1 RET1 SCA13",
    sql=f"""WITH {_legs_sql('end', ['end'])},
    tm AS (SELECT * EXCLUDE (relevance), relevance + CASE WHEN "at" > 120 THEN 0.3 ELSE 0.0 END * 0.1 AS relevance FROM mg),
    {_page_sql('tm')}
    SELECT result_type, result_id, video_id, round(relevance, 6) AS relevance, rank FROM rk
    ORDER BY rank, result_type, result_id LIMIT 15""",
    views=VIEWS,
)
def hybrid_retrieval_temporal(spark, sf_dir):
    store = _store(spark, sf_dir)
    rows = R.retrieve(
        store, "end", "hybrid", embed=lambda _: knn.lookup_vector(store.vectors, "0"), max_results=15, settings=SETTINGS
    )
    return rows.select("result_type", "result_id", "video_id", F.round("relevance", 6).alias("relevance"), "rank")


@query(
    "temporal_scoring", "TMP1",
    sql="""SELECT segment_id AS result_id, round(0.5 + 0.1 * (CASE WHEN start_time BETWEEN 30 AND 120 THEN 0.3 ELSE 0 END
                + CASE WHEN end_time - start_time > 30 THEN 0.2 ELSE 0 END), 6)::DOUBLE AS relevance
           FROM audio_segments
           UNION ALL SELECT frame_id, round(confidence + 0.1 * CASE WHEN timestamp BETWEEN 30 AND 120 THEN 0.3 ELSE 0 END, 6)
           FROM frames""",
    views="audio_segments frames",
)
def temporal_scoring(spark, sf_dir):
    rows = dt.audio_segments(spark, sf_dir).select(
        F.col("segment_id").alias("result_id"), F.col("start_time").alias("at"), F.col("end_time").alias("until"),
        F.lit(0.5).alias("relevance"),
    ).unionByName(dt.frames(spark, sf_dir).select(
        F.col("frame_id").alias("result_id"), F.col("timestamp").alias("at"), F.lit(None).cast("double").alias("until"),
        F.col("confidence").alias("relevance"),
    ))
    return ranking.apply_temporal(rows, "middle", "long").select("result_id", F.round("relevance", 6).alias("relevance"))


def _frames_as_results(spark, sf_dir):
    f = dt.frames(spark, sf_dir)
    return f.select(
        F.lit("frame").alias("result_type"), F.col("frame_id").alias("result_id"), "video_id",
        F.round(F.col("confidence") * 0.5 + F.col("timestamp") / 480.0, 6).alias("relevance"),
    )


FRAMES_SQL = """SELECT 'frame' AS result_type, frame_id AS result_id, video_id,
                       round(confidence * 0.5 + timestamp / 480.0::DOUBLE, 6) AS relevance FROM frames"""


@query(
    "diversity_top3", "WIN2",
    sql=f"""WITH f AS ({FRAMES_SQL}),
            r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY relevance DESC, result_type, result_id) AS rn FROM f)
            SELECT result_id, video_id, relevance FROM r WHERE rn <= 3 ORDER BY relevance DESC, result_type, result_id LIMIT 30""",
    views="frames",
)
def diversity_top3(spark, sf_dir):
    return ranking.diversify(_frames_as_results(spark, sf_dir)).select("result_id", "video_id", "relevance")


@query(
    "competition_rank", "WIN1",
    sql=f"WITH f AS ({FRAMES_SQL}) SELECT result_id, relevance, rank() OVER (ORDER BY relevance DESC) AS rank FROM f",
    views="frames",
)
def competition_rank(spark, sf_dir):
    rows = ranking.competition_rank(_frames_as_results(spark, sf_dir), "relevance")
    return rows.select("result_id", "relevance", "rank")


@query(
    "post_process", "TOP9 WIN1 WIN2",
    sql=f"""WITH f AS ({FRAMES_SQL}),
            ok AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY relevance DESC, result_id) AS rn FROM f
                   WHERE relevance >= 0.6),
            dv AS (SELECT * FROM ok WHERE rn <= 3 ORDER BY relevance DESC, result_id LIMIT 30)
            SELECT result_id, video_id, relevance, rank() OVER (ORDER BY relevance DESC) AS rank FROM dv
            ORDER BY rank, result_id LIMIT 20""",
    views="frames",
)
def post_process(spark, sf_dir):
    rows = ranking.post_process(_frames_as_results(spark, sf_dir), max_results=20)
    return rows.select("result_id", "video_id", "relevance", "rank")
