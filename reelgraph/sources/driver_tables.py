"""The benchmark tables seen through the data model.

Each function maps whole tables, one output row per source row or group, so the work grows with
the data.  ``CTES`` states the same mappings in SQL for the correctness oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reelgraph.functions import clock, ids


# Declared, not inferred: a read then needs no job of its own to open file footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def audio_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 30-second segment per conversation turn."""
    c = table(spark, sf_dir, "conversations")
    video = F.col("conv_id").cast("string")
    chunk = ids.chunk_id(video, F.col("turn"))
    return c.select(
        ids.segment_id(chunk).alias("segment_id"),
        chunk.alias("chunk_id"),
        video.alias("video_id"),
        (F.col("turn") * 30.0).alias("start_time"),
        (F.col("turn") * 30.0 + 30.0).alias("end_time"),
        F.col("text").alias("transcript"),
        F.lit(0.9).alias("confidence"),
        F.col("role").alias("speaker"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk around each audio segment, described by its transcript."""
    return audio_segments(spark, sf_dir).select(
        "chunk_id", "video_id", "start_time", "end_time", F.col("transcript").alias("unified_description")
    )


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One video per conversation."""
    g = (
        table(spark, sf_dir, "conversations")
        .groupBy("conv_id")
        .agg(F.count("*").alias("chunk_count"), F.sum(F.length("text")).alias("size_bytes"))
    )
    k = F.col("conv_id")
    return g.select(
        k.cast("string").alias("video_id"),
        F.concat(F.lit("video_"), k.cast("string"), F.lit(".mp4")).alias("filename"),
        (F.col("chunk_count") * 30.0).alias("duration"),
        "chunk_count",
        "size_bytes",
        (F.col("size_bytes") / 100.0).alias("processing_time"),
        k.cast("double").alias("created_at"),
        (k % 10 != 0).alias("success"),
        F.when(k % 10 == 0, "failed").when(k % 10 == 1, "pending").when(k % 10 == 2, "processing")
        .otherwise("completed").alias("status"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame per document, ten documents to a video."""
    d = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    at = (F.col("n_chars") % 240).cast("double")
    video = F.expr("doc_id div 10").cast("string")
    return d.join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("frame_id"),
        ids.chunk_id(video, F.floor(at / 30.0)).alias("chunk_id"),
        video.alias("video_id"),
        at.alias("timestamp"),
        F.col("text").alias("caption"),
        F.coalesce(F.col("quality").cast("double"), F.lit(0.5)).alias("confidence"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    kind = F.col("label") % 3
    return e.select(
        F.col("vec_id").cast("string").alias("entry_id"),
        F.col("embedding").alias("vector"),
        F.when(kind == 0, "frame").when(kind == 1, "chunk").otherwise("entity").alias("source_type"),
        F.col("vec_id").cast("string").alias("source_id"),
        F.col("label").cast("string").alias("video_id"),
        F.when(F.col("label") < 8, F.map_from_arrays(F.array(F.lit("tone")), F.array(
            F.when(F.col("label") % 2 == 0, F.lit("even")).otherwise(F.lit("odd")))))
        .otherwise(F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def _key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    def balance(column: str) -> Column:
        return F.round((F.col(column) + 1000) / 11000, 6)

    def shaped(name, prefix, key, label, kind, description, confidence):
        return table(spark, sf_dir, name).select(
            _key(prefix, key).alias("entity_id"),
            F.col(label).alias("name"),
            F.lit(kind).alias("entity_type"),
            description.alias("description"),
            confidence.alias("confidence"),
        )

    parts = [
        shaped("region", "R", "r_regionkey", "r_name", "LOCATION", F.lit("region"), F.lit(0.9)),
        shaped("nation", "N", "n_nationkey", "n_name", "LOCATION", F.lit(""), F.lit(0.8)),
        shaped("supplier", "S", "s_suppkey", "s_name", "PERSON", _key("supplier in nation ", "s_nationkey"),
               balance("s_acctbal")),
        shaped("customer", "C", "c_custkey", "c_name", "PERSON", F.col("c_mktsegment"), balance("c_acctbal")),
        shaped("part", "P", "p_partkey", "p_name", "OBJECT", F.concat_ws(" ", "p_brand", "p_type"),
               F.round(F.lit(0.3) + F.lit(0.014) * F.col("p_size"), 6)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "part")
        .select(_key("P", "p_partkey").alias("entity_id"), F.concat_ws(" ", "p_brand", "p_name").alias("alias"))
        .unionByName(
            table(spark, sf_dir, "nation").select(
                _key("N", "n_nationkey").alias("entity_id"), _key("Country ", "n_nationkey").alias("alias")
            )
        )
    )


def appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers appear in the video of the day for as long as the event's value, in seconds."""
    start = clock.epoch_seconds(F.col("ts"))
    return table(spark, sf_dir, "events").select(
        _key("C", "user_id").alias("entity_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("video_id"),
        start.alias("start_time"),
        (start + F.col("value")).alias("end_time"),
    )


def home_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one video each entity belongs to by its own row."""
    def shaped(name, prefix, key, video):
        return table(spark, sf_dir, name).select(_key(prefix, key).alias("entity_id"), _key("v", video).alias("video_id"))

    out = shaped("region", "R", "r_regionkey", "r_regionkey")
    for args in (
        ("nation", "N", "n_nationkey", "n_regionkey"),
        ("supplier", "S", "s_suppkey", "s_nationkey"),
        ("customer", "C", "c_custkey", "c_nationkey"),
        ("part", "P", "p_partkey", "p_size"),
    ):
        out = out.unionByName(shaped(*args))
    return out


def entity_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Home videos plus the videos an entity appears in."""
    seen = appearances(spark, sf_dir).select("entity_id", "video_id").distinct()
    return home_videos(spark, sf_dir).unionByName(seen)


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    def shaped(df, source, target, kind, description, confidence):
        return df.select(
            ids.relation_id(source, target, F.lit(kind)).alias("relation_id"),
            source.alias("source_entity"),
            target.alias("target_entity"),
            F.lit(kind).alias("relation_type"),
            F.lit(description).alias("description"),
            confidence.alias("confidence"),
        )

    carried = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", "l_partkey")
        .agg(F.round(1 - F.avg("l_discount"), 6).alias("c"))
    )
    out = shaped(table(spark, sf_dir, "nation"), _key("N", "n_nationkey"), _key("R", "n_regionkey"), "PART_OF",
                 "lies in", F.lit(0.9))
    for df, s, t in (
        (table(spark, sf_dir, "supplier"), _key("S", "s_suppkey"), _key("N", "s_nationkey")),
        (table(spark, sf_dir, "customer"), _key("C", "c_custkey"), _key("N", "c_nationkey")),
    ):
        out = out.unionByName(shaped(df, s, t, "LOCATED_IN", "based in", F.lit(0.8)))
    return out.unionByName(
        shaped(carried, _key("S", "l_suppkey"), _key("P", "l_partkey"), "CONTAINS", "carries", F.col("c"))
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("conversation_id"),
        F.col("turn").alias("seq"),
        "role",
        F.col("text").alias("content"),
        (F.col("turn") * 30.0).alias("timestamp"),
    )


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("worker_id"),
        clock.epoch_seconds(F.col("ts")).alias("ts"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "busy")
        .otherwise("available").alias("status"),
        "event_id",
    )


def task_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("task_id"),
        F.col("user_id").cast("string").alias("worker_id"),
        clock.epoch_seconds(F.col("ts")).alias("created_time"),
        F.when(kind == "error", "failed").when(kind == "purchase", "completed").when(kind == "click", "completed")
        .when(kind == "view", "processing").otherwise("pending").alias("status"),
        F.col("value").alias("processing_time"),
    )


CTES: dict[str, str] = {
    "audio_segments": """
        SELECT conv_id::VARCHAR || '_chunk_' || lpad(turn::VARCHAR, 4, '0') || '_audio' AS segment_id,
               conv_id::VARCHAR || '_chunk_' || lpad(turn::VARCHAR, 4, '0') AS chunk_id,
               conv_id::VARCHAR AS video_id, turn * 30.0::DOUBLE AS start_time,
               turn * 30.0::DOUBLE + 30.0::DOUBLE AS end_time, text AS transcript,
               0.9::DOUBLE AS confidence, role AS speaker
        FROM conversations""",
    "chunks": """
        SELECT conv_id::VARCHAR || '_chunk_' || lpad(turn::VARCHAR, 4, '0') AS chunk_id, conv_id::VARCHAR AS video_id,
               turn * 30.0::DOUBLE AS start_time, turn * 30.0::DOUBLE + 30.0::DOUBLE AS end_time,
               text AS unified_description FROM conversations""",
    "videos": """
        SELECT conv_id::VARCHAR AS video_id, 'video_' || conv_id || '.mp4' AS filename,
               count(*) * 30.0::DOUBLE AS duration, count(*) AS chunk_count,
               sum(length(text))::BIGINT AS size_bytes, sum(length(text))::BIGINT / 100.0::DOUBLE AS processing_time,
               conv_id::DOUBLE AS created_at, conv_id % 10 <> 0 AS success,
               CASE conv_id % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'processing'
                    ELSE 'completed' END AS status
        FROM conversations GROUP BY conv_id""",
    "frames": """
        SELECT d.doc_id::VARCHAR AS frame_id,
               (d.doc_id // 10)::VARCHAR || '_chunk_'
                 || lpad(floor((d.n_chars % 240) / 30.0)::BIGINT::VARCHAR, 4, '0') AS chunk_id,
               (d.doc_id // 10)::VARCHAR AS video_id, (d.n_chars % 240)::DOUBLE AS timestamp,
               d.text AS caption, coalesce(l.quality::DOUBLE, 0.5::DOUBLE) AS confidence
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "vectors": """
        SELECT vec_id::VARCHAR AS entry_id, embedding::DOUBLE[] AS vector,
               CASE label % 3 WHEN 0 THEN 'frame' WHEN 1 THEN 'chunk' ELSE 'entity' END AS source_type,
               vec_id::VARCHAR AS source_id, label::VARCHAR AS video_id,
               CASE WHEN label < 8 THEN CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END END AS tone
        FROM embeddings""",
    "entities": """
        SELECT 'R' || r_regionkey AS entity_id, r_name AS name, 'LOCATION' AS entity_type, 'region' AS description,
               0.9::DOUBLE AS confidence FROM region
        UNION ALL SELECT 'N' || n_nationkey, n_name, 'LOCATION', '', 0.8::DOUBLE FROM nation
        UNION ALL SELECT 'S' || s_suppkey, s_name, 'PERSON', 'supplier in nation ' || s_nationkey,
               round((s_acctbal + 1000) / 11000, 6) FROM supplier
        UNION ALL SELECT 'C' || c_custkey, c_name, 'PERSON', c_mktsegment,
               round((c_acctbal + 1000) / 11000, 6) FROM customer
        UNION ALL SELECT 'P' || p_partkey, p_name, 'OBJECT', p_brand || ' ' || p_type,
               round(0.3::DOUBLE + 0.014::DOUBLE * p_size, 6) FROM part""",
    "aliases": """
        SELECT 'P' || p_partkey AS entity_id, p_brand || ' ' || p_name AS alias FROM part
        UNION ALL SELECT 'N' || n_nationkey, 'Country ' || n_nationkey FROM nation""",
    "appearances": """
        SELECT 'C' || user_id AS entity_id, strftime(ts, '%Y-%m-%d') AS video_id,
               epoch_us(ts) / 1e6 AS start_time, epoch_us(ts) / 1e6 + value AS end_time
        FROM events""",
    "entity_videos": """
        SELECT 'R' || r_regionkey AS entity_id, 'v' || r_regionkey AS video_id FROM region
        UNION ALL SELECT 'N' || n_nationkey, 'v' || n_regionkey FROM nation
        UNION ALL SELECT 'S' || s_suppkey, 'v' || s_nationkey FROM supplier
        UNION ALL SELECT 'C' || c_custkey, 'v' || c_nationkey FROM customer
        UNION ALL SELECT 'P' || p_partkey, 'v' || p_size FROM part
        UNION ALL SELECT DISTINCT 'C' || user_id, strftime(ts, '%Y-%m-%d') FROM events""",
    "relations": """
        SELECT substr(md5(s || '_' || k || '_' || t), 1, 16) AS relation_id, s AS source_entity, t AS target_entity,
               k AS relation_type, d AS description, c AS confidence
        FROM (SELECT 'N' || n_nationkey AS s, 'R' || n_regionkey AS t, 'PART_OF' AS k, 'lies in' AS d,
                     0.9::DOUBLE AS c FROM nation
              UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'LOCATED_IN', 'based in', 0.8::DOUBLE FROM supplier
              UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'LOCATED_IN', 'based in', 0.8::DOUBLE FROM customer
              UNION ALL SELECT 'S' || l_suppkey, 'P' || l_partkey, 'CONTAINS', 'carries', round(1 - avg(l_discount), 6)
                        FROM lineitem GROUP BY l_suppkey, l_partkey)""",
    "messages": """
        SELECT conv_id::VARCHAR AS conversation_id, turn AS seq, role, text AS content,
               turn * 30.0::DOUBLE AS timestamp FROM conversations""",
    "heartbeats": """
        SELECT user_id::VARCHAR AS worker_id, epoch_us(ts) / 1e6 AS ts,
               CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'busy' ELSE 'available' END AS status,
               event_id FROM events""",
    "task_results": """
        SELECT event_id::VARCHAR AS task_id, user_id::VARCHAR AS worker_id, epoch_us(ts) / 1e6 AS created_time,
               CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'completed'
                    WHEN 'view' THEN 'processing' ELSE 'pending' END AS status,
               value AS processing_time FROM events""",
}


def with_views(sql: str, *names: str) -> str:
    """Prefix an oracle statement with the views it uses."""
    if not names:
        return sql.strip()
    views = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views},\n{body[len('WITH RECURSIVE '):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {views},\n{body[len('WITH '):]}"
    return f"WITH {views}\n{body}"
