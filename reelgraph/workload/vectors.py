"""Vector search queries; the query vector is the one stored under key 0."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reelgraph.functions import vectors as V
from reelgraph.operators import knn, vector_index
from reelgraph.session import ensure_checkpoint_dir
from reelgraph.sources import driver_tables as dt
from reelgraph.workload.registry import query

COS = "greatest(-1.0, least(1.0, list_cosine_similarity(v.vector, q.qv)))"
Q0 = "(SELECT vector AS qv FROM vectors WHERE entry_id = '0') q"


def _out(df):
    return df.select("entry_id", F.round("similarity", 6).alias("similarity"))


@query(
    "vector_topk", "TOP1 SCA5 SRC6",
    sql=f"""SELECT entry_id, round({COS}, 6) AS similarity FROM vectors v, {Q0}
            WHERE {COS} >= 0 ORDER BY {COS} DESC, entry_id LIMIT 10""",
    views="vectors",
)
def vector_topk(spark, sf_dir):
    v = dt.vectors(spark, sf_dir)
    return _out(knn.top_k(v, knn.lookup_vector(v, "0"), 10))


@query(
    "vector_topk_filtered", "TOP1 FLT1",
    sql=f"""SELECT entry_id, round({COS}, 6) AS similarity FROM vectors v, {Q0}
            WHERE {COS} >= 0 AND source_type = 'frame' AND (tone IS NULL OR tone = 'even')
            ORDER BY {COS} DESC, entry_id LIMIT 10""",
    views="vectors",
)
def vector_topk_filtered(spark, sf_dir):
    v = dt.vectors(spark, sf_dir)
    return _out(knn.top_k(v, knn.lookup_vector(v, "0"), 10, filters={"source_type": "frame", "tone": "even", "none": "x"}))


@query(
    "vector_threshold", "TOP1 RET4",
    sql=f"""SELECT entry_id, round({COS}, 6) AS similarity FROM vectors v, {Q0} WHERE {COS} >= 0.2""",
    views="vectors",
)
def vector_threshold(spark, sf_dir):
    v = dt.vectors(spark, sf_dir)
    return _out(knn.similar(v, knn.lookup_vector(v, "0"), 0.2))


@query(
    "vector_topk_per_type", "RET4 TOP1",
    sql=f"""SELECT source_type, entry_id, round(s, 6) AS similarity, r AS rank FROM (
              SELECT v.*, {COS} AS s, row_number() OVER (PARTITION BY source_type ORDER BY {COS} DESC, entry_id) AS r
              FROM vectors v, {Q0} WHERE source_type IN ('frame', 'chunk') AND {COS} >= 0.1)
            WHERE r <= 5""",
    views="vectors",
)
def vector_topk_per_type(spark, sf_dir):
    v = dt.vectors(spark, sf_dir)
    hits = knn.top_k_per_type(v, knn.lookup_vector(v, "0"), 5, 0.1, ("frame", "chunk"))
    return hits.select("source_type", "entry_id", F.round("similarity", 6).alias("similarity"),
                       F.col("rank").cast("bigint").alias("rank"))


@query(
    "similar_excluding_video", "TOP3",
    sql=f"""SELECT entry_id, round({COS}, 6) AS similarity FROM vectors v, {Q0}
            WHERE {COS} >= 0.1 AND entry_id <> '0'
              AND video_id <> (SELECT video_id FROM vectors WHERE entry_id = '0')
            ORDER BY {COS} DESC, entry_id LIMIT 10""",
    views="vectors",
)
def similar_excluding_video(spark, sf_dir):
    v = dt.vectors(spark, sf_dir)
    return _out(knn.similar_to_entry(v, "0", 10, 0.1, exclude_same_video=True))


@query(
    "similar_entities", "TOP4",
    sql=f"""SELECT entry_id, round({COS}, 6) AS similarity FROM vectors v, {Q0} WHERE source_type = 'entity'
            ORDER BY {COS} DESC, entry_id LIMIT 10""",
    views="vectors",
)
def similar_entities(spark, sf_dir):
    v = dt.vectors(spark, sf_dir)
    return _out(knn.top_k(v, knn.lookup_vector(v, "0"), 10, threshold=None, filters={"source_type": "entity"}))


@query(
    "batch_similarity_euclidean", "TOP5 SCA6",
    sql=f"""WITH d AS (SELECT entry_id, list_distance(v.vector, q.qv) AS d FROM vectors v, {Q0})
            SELECT entry_id, round(coalesce(1 - d / nullif(max(d) OVER (), 0), 0.0), 6) AS similarity FROM d""",
    views="vectors",
)
def batch_similarity_euclidean(spark, sf_dir):
    v = dt.vectors(spark, sf_dir)
    return _out(knn.batch_similarity(v, knn.lookup_vector(v, "0"), "euclidean"))


@query(
    "image_query", "TOP7 UDF4",
    sql=f"""SELECT entry_id, video_id, round({COS}, 6) AS similarity FROM vectors v, {Q0}
            WHERE source_type = 'frame' AND {COS} > 0.05 ORDER BY {COS} DESC, entry_id LIMIT 10""",
    views="vectors",
)
def image_query(spark, sf_dir):
    """Frames nearest to an image given by its vector."""
    v = dt.vectors(spark, sf_dir)
    hits = knn.similar(v, knn.lookup_vector(v, "0"), None, {"source_type": "frame"}).filter(F.col("similarity") > 0.05)
    return hits.orderBy(F.desc("similarity"), "entry_id").limit(10).select(
        "entry_id", "video_id", F.round("similarity", 6).alias("similarity")
    )


@query(
    "chunk_embedding_mean", "SCA18",
    sql="""WITH p AS (SELECT a.entry_id, a.vector AS t, b.vector[1:32] AS w FROM vectors a
                      JOIN vectors b ON b.entry_id = ((a.entry_id::BIGINT + 1))::VARCHAR),
                f AS (SELECT entry_id, list_transform(range(0, 64), lambda i: (t[i + 1] +
                        (CASE WHEN i * 32.0::DOUBLE / 63 >= 31 THEN w[32]
                              ELSE w[floor(i * 32.0::DOUBLE / 63)::INT + 1] + (i * 32.0::DOUBLE / 63 - floor(i * 32.0::DOUBLE / 63))
                                   * (w[floor(i * 32.0::DOUBLE / 63)::INT + 2] - w[floor(i * 32.0::DOUBLE / 63)::INT + 1]) END)) / 2) AS m
                      FROM p),
                n AS (SELECT *, sqrt(list_sum(list_transform(m, lambda x: x * x))) AS len FROM f)
           SELECT entry_id, round(m[1] / len, 6) AS first, round(m[31] / len, 6) AS middle, round(m[64] / len, 6) AS last,
                  64::BIGINT AS size
           FROM n""",
    views="vectors",
)
def chunk_embedding_mean(spark, sf_dir):
    """Fuse each vector with a half-length visual vector cut from the next entry."""
    v = dt.vectors(spark, sf_dir).select(F.col("entry_id").cast("bigint").alias("k"), "vector")
    visual = v.select((F.col("k") - 1).alias("k"), F.slice("vector", 1, 32).alias("visual"))
    fused = v.join(visual, "k").select(
        F.col("k").cast("string").alias("entry_id"), V.fuse_chunk_embedding(F.col("vector"), F.col("visual")).alias("f")
    )
    return fused.select(
        "entry_id", F.round(F.get("f", F.lit(0)), 6).alias("first"), F.round(F.get("f", F.lit(30)), 6).alias("middle"),
        F.round(F.get("f", F.lit(63)), 6).alias("last"), F.size("f").cast("bigint").alias("size"),
    )


@query(
    "vector_stats", "AGG1",
    sql="""SELECT 'total' AS scope, '' AS value, count(*) AS n FROM vectors
           UNION ALL SELECT 'source_type', source_type, count(*) FROM vectors GROUP BY ALL
           UNION ALL SELECT 'video_id', video_id, count(*) FROM vectors GROUP BY ALL""",
    views="vectors",
)
def vector_stats(spark, sf_dir):
    return knn.vector_stats(dt.vectors(spark, sf_dir))


def _index_path(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/index-{name}-{uuid.uuid4().hex}"


@query(
    "vector_index_topk", "TOP2 SRC5",
    sql=f"""SELECT entry_id, round({COS}, 6) AS similarity FROM vectors v, {Q0}
            WHERE {COS} >= 0 ORDER BY {COS} DESC, entry_id LIMIT 10""",
    views="vectors",
)
def vector_index_topk(spark, sf_dir):
    """All vectors indexed, all cells probed: the exact result."""
    v = dt.vectors(spark, sf_dir)
    path = _index_path(spark, "topk")
    vector_index.build(v, path)
    return _out(vector_index.search(spark, path, knn.lookup_vector(v, "0"), 10))


@query(
    "vector_index_many", "TOP2",
    sql="""WITH s AS (SELECT q.entry_id AS query_id, v.entry_id, greatest(-1.0, least(1.0, list_cosine_similarity(q.vector, v.vector))) AS s
                      FROM vectors q, vectors v WHERE q.entry_id::BIGINT % 100 = 0),
                r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, entry_id) AS rank FROM s)
           SELECT query_id, rank::INT AS rank, entry_id, round(s, 6) AS similarity FROM r WHERE rank <= 10""",
    views="vectors",
)
def vector_index_many(spark, sf_dir):
    """The ten nearest of every hundredth vector, all cells probed."""
    v = dt.vectors(spark, sf_dir)
    path = _index_path(spark, "many")
    cells = vector_index.build(v, path, cells=16)
    asked = v.where(F.col("entry_id").cast("bigint") % 100 == 0).select(F.col("entry_id").alias("query_id"), "vector")
    found = vector_index.search_many(spark, path, asked, 10, probes=cells)
    return found.withColumn("similarity", F.round("similarity", 6))
