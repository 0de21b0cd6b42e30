"""Upserts, deletes, retention, sync and model calls over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reelgraph.functions import ids
from reelgraph.models import inference as mi
from reelgraph.operators import ranking
from reelgraph.session import ensure_checkpoint_dir
from reelgraph.sources import delta_store, driver_tables as dt, graph_commits, store
from reelgraph.workload.registry import query

F_SHAPE = "frame_id string, video_id string, timestamp double, caption string"
V_SHAPE = "entry_id string, video_id string, source_type string"


@query(
    "upsert_latest", "SRC3 SRC6",
    sql="""SELECT o_custkey, o_orderkey, o_totalprice FROM (
             SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""",
)
def upsert_latest(spark, sf_dir):
    """Orders as versions of their customer's row: the last write wins."""
    rows = store.latest_by_key(dt.table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey")
    return rows.select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "insert_if_absent", "SRC15 SRC12",
    sql="""SELECT conv_id::VARCHAR AS video_id, 'old' AS origin FROM conversations WHERE role = 'system' GROUP BY 1
           UNION ALL SELECT DISTINCT conv_id::VARCHAR, 'new' FROM conversations
           WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')""",
)
def insert_if_absent(spark, sf_dir):
    """Conversations with a system message are already stored; the others come in from another store."""
    c = dt.table(spark, sf_dir, "conversations")
    key = F.col("conv_id").cast("string").alias("video_id")
    have = c.filter("role = 'system'").select(key).distinct().withColumn("origin", F.lit("old"))
    return store.insert_absent(have, c.select(key).distinct().withColumn("origin", F.lit("new")), "video_id")


@query(
    "store_sync", "SRC15",
    sql="""SELECT 'videos' AS kind, video_id AS item_id FROM videos
           UNION ALL SELECT 'chunks', chunk_id FROM chunks SEMI JOIN videos USING (video_id)
           UNION ALL SELECT 'frames', frame_id FROM frames SEMI JOIN videos USING (video_id)
           UNION ALL SELECT 'audio_segments', segment_id FROM audio_segments SEMI JOIN videos USING (video_id)
           UNION ALL SELECT 'vectors', entry_id FROM vectors""",
    views="videos chunks frames audio_segments vectors",
)
def store_sync(spark, sf_dir):
    """A store of the successful videos takes over the rest from a store of all of them."""
    v, x = dt.videos(spark, sf_dir), dt.vectors(spark, sf_dir)
    good = v.filter("success")
    children = {"chunks": dt.chunks(spark, sf_dir), "frames": dt.frames(spark, sf_dir), "audio_segments": dt.audio_segments(spark, sf_dir)}
    own = {n: rows.join(good.select("video_id"), "video_id", "left_semi") for n, rows in children.items()}
    out = store.sync(
        {"videos": good, "vectors": x.filter("source_type = 'frame'"), **own}, {"videos": v, "vectors": x, **children}
    )
    parts = [("chunks", "chunk_id"), ("frames", "frame_id"), ("audio_segments", "segment_id"), ("vectors", "entry_id")]
    all_rows = out["videos"].select(F.lit("videos").alias("kind"), F.col("video_id").alias("item_id"))
    for n, k in parts:
        all_rows = all_rows.unionByName(out[n].select(F.lit(n).alias("kind"), F.col(k).alias("item_id")))
    return all_rows


@query(
    "delete_cascade", "MNT1",
    sql="""SELECT 'videos' AS kind, video_id AS item_id FROM videos WHERE video_id <> '7'
           UNION ALL SELECT 'chunks', chunk_id FROM chunks WHERE video_id <> '7'
           UNION ALL SELECT 'frames', frame_id FROM frames WHERE video_id <> '7'
           UNION ALL SELECT 'audio_segments', segment_id FROM audio_segments WHERE video_id <> '7'
           UNION ALL SELECT 'vectors', entry_id FROM vectors WHERE video_id <> '7'""",
    views="videos chunks frames audio_segments vectors",
)
def delete_cascade(spark, sf_dir):
    parts = {
        "videos": ("video_id", dt.videos), "chunks": ("chunk_id", dt.chunks), "frames": ("frame_id", dt.frames),
        "audio_segments": ("segment_id", dt.audio_segments), "vectors": ("entry_id", dt.vectors),
    }
    left = store.delete_video({n: make(spark, sf_dir) for n, (_, make) in parts.items()}, "7")
    out = None
    for n, (key, _) in parts.items():
        rows = left[n].select(F.lit(n).alias("kind"), F.col(key).alias("item_id"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "store_changes", "MNT1 SRC3 SRC5 SRC7",
    sql="""SELECT 'frames' AS kind, frame_id AS item_id, CASE WHEN timestamp >= 200 THEN 'changed' ELSE md5(caption) END AS content
           FROM frames WHERE video_id <> '7' OR timestamp >= 200
           UNION ALL SELECT 'vectors', entry_id, source_type FROM vectors WHERE video_id <> '7' AND source_type <> 'chunk'""",
    views="frames vectors",
)
def store_changes(spark, sf_dir):
    """A stored base, then a removed video, replaced frames and vectors removed by their kind, merged as they are read."""
    path = f"{ensure_checkpoint_dir(spark)}/changes-{uuid.uuid4().hex}"
    keys = {"frames": "frame_id", "vectors": "entry_id"}
    f = dt.frames(spark, sf_dir).select("frame_id", "video_id", "timestamp", "caption")
    v = dt.vectors(spark, sf_dir).select("entry_id", "video_id", "source_type")
    delta_store.Change(spark, path, keys).append("frames", f).append("vectors", v).commit()
    seven = spark.createDataFrame([("7",)], "video_id string").coalesce(1)
    delta_store.Change(spark, path, keys).delete("frames", seven, "video_id").delete("vectors", seven, "video_id").commit()
    late = f.where("timestamp >= 200").withColumn("caption", F.lit("changed"))
    chunk = spark.createDataFrame([("chunk",)], "source_type string").coalesce(1)
    delta_store.Change(spark, path, keys).upsert("frames", late).delete("vectors", chunk, "source_type").commit()
    now = delta_store.load(spark, path, {"frames": F_SHAPE, "vectors": V_SHAPE})
    content = F.when(F.col("caption") == "changed", F.col("caption")).otherwise(F.md5("caption"))
    frames = now["frames"].select(F.lit("frames").alias("kind"), F.col("frame_id").alias("item_id"), content.alias("content"))
    return frames.unionByName(now["vectors"].select(F.lit("vectors").alias("kind"), F.col("entry_id").alias("item_id"), F.col("source_type").alias("content")))


@query(
    "retention", "MNT2",
    sql="SELECT video_id, success FROM videos WHERE NOT (created_at < 50 AND NOT success)", views="videos",
)
def retention(spark, sf_dir):
    return store.expire_failed(dt.videos(spark, sf_dir), 50.0).select("video_id", "success")


@query(
    "retention_nulls", "MNT2",
    sql="""SELECT video_id FROM videos
           WHERE NOT coalesce(CASE WHEN chunk_count % 2 = 1 THEN created_at END < 50 AND NOT CASE WHEN chunk_count % 3 > 0 THEN success END, false)""",
    views="videos",
)
def retention_nulls(spark, sf_dir):
    """Retention where times and outcomes are missing by a rule."""
    videos = dt.videos(spark, sf_dir).withColumns({
        "created_at": F.when(F.col("chunk_count") % 2 == 1, F.col("created_at")),
        "success": F.when(F.col("chunk_count") % 3 > 0, F.col("success")),
    })
    return store.expire_failed(videos, 50.0).select("video_id")


@query(
    "rank_with_nulls", "WIN1",
    sql="""SELECT p_partkey, rank() OVER (ORDER BY score DESC NULLS LAST) AS rank
           FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN p_size / 50.0::DOUBLE END AS score FROM part)""",
)
def rank_with_nulls(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = part.select("p_partkey", F.when(F.col("p_partkey") % 5 > 0, F.col("p_size") / F.lit(50.0)).alias("score"))
    return ranking.competition_rank(rows, "score").select("p_partkey", F.col("rank").cast("long").alias("rank"))


@query(
    "orphan_embeddings", "JOI8 MNT2",
    sql="""SELECT entry_id, video_id FROM vectors WHERE video_id NOT IN (SELECT video_id FROM videos WHERE success)""",
    views="vectors videos",
)
def orphan_embeddings(spark, sf_dir):
    return store.orphaned_vectors(dt.vectors(spark, sf_dir), dt.videos(spark, sf_dir).filter("success")).select("entry_id", "video_id")


@query(
    "touch_unused", "MNT3",
    sql="SELECT video_id, CASE WHEN created_at = 0 THEN 99.0 ELSE created_at END::DOUBLE AS last_accessed FROM videos", views="videos",
)
def touch_unused(spark, sf_dir):
    rows = dt.videos(spark, sf_dir).withColumn("last_accessed", F.col("created_at"))
    return store.touch_unused(rows, 99.0).select("video_id", "last_accessed")


@query(
    "register_videos", "MNT5 SRC17",
    sql="""WITH o AS (SELECT substr(md5(url), 1, 16) AS video_id, url || CASE page_id % 3 WHEN 0 THEN '.mp4' WHEN 1 THEN '.MOV' ELSE '.txt' END AS path FROM pages),
                f AS (SELECT video_id, max(path) AS path FROM o GROUP BY 1),
                k AS (SELECT DISTINCT substr(md5(url), 1, 16) AS video_id FROM pages WHERE page_id % 4 = 0)
           SELECT video_id, path, k.video_id IS NOT NULL OR regexp_matches(lower(path), '[.](mp4|avi|mov|mkv|webm)$') AS accepted,
                  CASE WHEN k.video_id IS NOT NULL THEN 'known' WHEN regexp_matches(lower(path), '[.](mp4|avi|mov|mkv|webm)$') THEN 'pending'
                       ELSE 'rejected' END AS status
           FROM f LEFT JOIN k USING (video_id)""",
)
def register_videos(spark, sf_dir):
    """Web addresses offered as media files of three formats; every fourth is known already."""
    from reelgraph.config import ProcessingSettings

    p = dt.table(spark, sf_dir, "pages")
    k = F.col("page_id")
    end = F.when(k % 3 == 0, ".mp4").when(k % 3 == 1, ".MOV").otherwise(".txt")
    offered = p.select(ids.short_hash(F.col("url")).alias("video_id"), F.concat("url", end).alias("path"))
    known = p.filter(k % 4 == 0).select(ids.short_hash(F.col("url")).alias("video_id")).distinct()
    rows = store.register_videos(known, offered, ProcessingSettings().supported_formats, 0.0)
    return rows.select("video_id", "path", "accepted", "status")


def nested_videos(spark, sf_dir):
    """Every conversation turn as a nested processed video of one chunk, with its transcript and frames."""
    f = dt.frames(spark, sf_dir).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct(
        "frame_id", "timestamp", F.col("timestamp").cast("int").alias("frame_index"), "caption", "confidence",
        F.lit(None).cast("string").alias("image_path"), F.lit(None).cast("array<float>").alias("embedding"),
    ))).alias("frames"))  # the mapping gives a video ten frames, so a chunk has at most ten
    a = dt.audio_segments(spark, sf_dir).join(f, "chunk_id", "left")
    chunk = F.struct(
        "chunk_id", "start_time", "end_time", F.col("transcript").alias("unified_description"),
        F.lit(None).cast("array<float>").alias("chunk_embedding"), "frames",
        F.when(F.col("speaker") != "system", F.struct(
            "segment_id", "start_time", "end_time", "transcript", "confidence", F.lit("").alias("audio_path")
        )).alias("audio_segment"),
    )
    return a.select(
        F.col("chunk_id").alias("video_id"), F.col("chunk_id").alias("video_path"), F.col("chunk_id").alias("filename"),
        F.lit(30.0).alias("duration"), F.lit(30.0).alias("fps"), F.lit("224x224").alias("resolution"),
        F.length("transcript").cast("bigint").alias("size_bytes"), F.lit(1.0).alias("processing_time"), F.lit(True).alias("success"),
        F.lit(None).cast("string").alias("error_message"), F.array(chunk).alias("chunks"),
    )


@query(
    "shred_videos", "SRC4 SRC8 SRC18",
    sql="""WITH f AS (SELECT chunk_id, count(*) AS n FROM frames SEMI JOIN audio_segments USING (chunk_id) GROUP BY 1)
           SELECT 'video' AS kind, chunk_id AS item_id, 1::BIGINT AS n FROM audio_segments
           UNION ALL SELECT 'chunk', chunk_id, coalesce(n, 0) FROM audio_segments LEFT JOIN f USING (chunk_id)
           UNION ALL SELECT 'frame', frame_id, 0 FROM frames SEMI JOIN audio_segments USING (chunk_id)
           UNION ALL SELECT 'audio', segment_id, length(transcript) FROM audio_segments WHERE speaker <> 'system'""",
    views="frames audio_segments",
)
def shred_videos(spark, sf_dir):
    """Nested videos through their wire format and into the four tables."""
    t = store.shred(store.from_wire(store.to_wire(nested_videos(spark, sf_dir))), 0.0)

    def rows(df, kind, key, n):
        return df.select(F.lit(kind).alias("kind"), F.col(key).alias("item_id"), n.cast("bigint").alias("n"))

    return (
        rows(t["videos"], "video", "video_id", F.col("chunk_count"))
        .unionByName(rows(t["chunks"], "chunk", "chunk_id", F.col("frame_count")))
        .unionByName(rows(t["frames"], "frame", "frame_id", F.lit(0)))
        .unionByName(rows(t["audio_segments"], "audio", "segment_id", F.length("transcript")))
    )


@query(
    "entity_vectors", "SRC9",
    sql="""SELECT 'entity_' || entity_id AS entry_id, entity_id AS source_id, coalesce(v, '') AS video_id, name
           FROM entities LEFT JOIN (SELECT entity_id, min(video_id) AS v FROM entity_videos GROUP BY 1) USING (entity_id)""",
    views="entities entity_videos",
)
def entity_vectors(spark, sf_dir):
    """Vector rows of all entities, each with the smallest of its source videos."""
    e = dt.entities(spark, sf_dir).withColumn("embedding", F.array(F.col("confidence").cast("float")))
    rows = store.entity_vectors(e, dt.entity_videos(spark, sf_dir), 0.0)
    return rows.select("entry_id", "source_id", "video_id", F.element_at("metadata", "name").alias("name"))


@query(
    "entity_embeddings", "GR9 UDF1",
    sql="SELECT entity_id, 64 AS size, 1.0::DOUBLE AS norm FROM entities", views="entities",
)
def entity_embeddings(spark, sf_dir):
    """Entity texts through the offline text embedder: vector length and norm."""
    e = dt.entities(spark, sf_dir)
    text = F.concat("entity_type", F.lit(": "), F.concat_ws(" | ", "name", "description"))
    rows = mi.embed_missing(e.withColumn("text", text).withColumn("embedding", F.lit(None).cast("array<float>")), mi.hashing_embedder())
    norm = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return rows.select("entity_id", F.size("embedding").alias("size"), F.round(norm, 4).alias("norm"))


@query(
    "model_status", "UDF8",
    sql="""SELECT event_type AS model, count(*) AS calls, count(*) FILTER (value >= 100) AS errors, round(avg(value), 6) AS mean_seconds,
                  max(user_id)::DOUBLE AS memory_mb, count(*) FILTER (value < 100) > 0 AS healthy FROM events GROUP BY 1""",
)
def model_status(spark, sf_dir):
    calls = dt.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("model"), (F.col("value") < 100).alias("success"), F.col("value").alias("seconds"),
        F.col("user_id").cast("double").alias("memory_mb"),
    )
    return mi.model_status(calls).withColumn("mean_seconds", F.round("mean_seconds", 6))


@query(
    "caption_frames", "UDF3",
    sql="""SELECT doc_id, CASE WHEN n_chars % 5 = 0 THEN '' ELSE lang || ' frame of ' || length(text) END AS caption, 0.8::DOUBLE AS confidence FROM documents""",
)
def caption_frames(spark, sf_dir):
    """Captions from an offline model that refuses some inputs."""
    rows = dt.table(spark, sf_dir, "documents").select(
        "doc_id", F.concat_ws("|", "lang", F.length("text"), F.when(F.col("n_chars") % 5 == 0, "bad").otherwise("ok")).alias("image")
    )

    def describe(image):
        lang, n, ok = image.split("|")
        if ok == "bad":
            raise ValueError("cannot read image")
        return f"{lang} frame of {n}"

    return mi.caption_frames(rows, mi.fixed_text("describe", describe)).select("doc_id", "caption", "confidence")


@query(
    "transcribe_segments", "UDF5 SRC19",
    sql="""SELECT conv_id, turn, trim('heard ' || text) AS transcript, 0.9::DOUBLE AS confidence FROM conversations WHERE role <> 'system'""",
)
def transcribe_segments(spark, sf_dir):
    """Transcripts of every spoken turn; turns without audio have no segment."""
    rows = dt.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") != "system", F.col("text")).alias("audio")
    )
    return mi.transcribe(rows, mi.fixed_text("heard", lambda s: f" heard {s} ")).select("conv_id", "turn", "transcript", "confidence")


@query(
    "graph_commits", "SRC7 GR10 SRC14",
    sql="""WITH places AS (SELECT entity_id, name FROM entities WHERE entity_type = 'LOCATION'),
                people AS (SELECT entity_id, name FROM entities WHERE entity_type = 'PERSON'),
                linked AS (SELECT relation_id, source_entity FROM relations WHERE relation_type <> 'CONTAINS')
           SELECT 'saved' AS state, 'a' AS graph_id, 'entity' AS kind, entity_id AS id, name AS content FROM places
           UNION ALL SELECT 'saved', 'b', 'entity', entity_id, name FROM people
           UNION ALL SELECT 'saved', 'a', 'relation', relation_id, source_entity FROM linked
           UNION ALL SELECT 'replaced', 'a', 'entity', entity_id, name FROM people
           UNION ALL SELECT 'replaced', 'b', 'entity', entity_id, name FROM people
           UNION ALL SELECT 'deleted', 'a', 'entity', entity_id, name FROM people
           UNION ALL SELECT 'restored', 'a', 'entity', entity_id, name FROM places
           UNION ALL SELECT 'restored', 'b', 'entity', entity_id, name FROM people
           UNION ALL SELECT 'restored', 'a', 'relation', relation_id, source_entity FROM linked""",
    views="entities relations",
)
def graph_commits_states(spark, sf_dir):
    """Graph a is saved, replaced by other entities without relations, b deleted, and the first state restored."""
    path = f"{ensure_checkpoint_dir(spark)}/graphs-{uuid.uuid4().hex}"
    named, none = F.col("graph_id"), F.lit(None).cast("double")
    entities, relations = dt.entities(spark, sf_dir), dt.relations(spark, sf_dir).where("relation_type <> 'CONTAINS'")

    def of(kind, graph):
        rows = entities.where(F.col("entity_type") == kind)
        return rows.select(F.lit(graph).alias("graph_id"), "entity_id", "name", "entity_type", "description", "confidence")

    links = relations.select(F.lit("a").alias("graph_id"), "*", none.alias("start_time"), none.alias("end_time"))
    first = graph_commits.save({"entities": of("LOCATION", "a").unionByName(of("PERSON", "b")), "relations": links}, path)
    graph_commits.save({"entities": of("PERSON", "a"), "relations": links.limit(0)}, path)
    graph_commits.delete(spark, path, "b")
    graph_commits.rollback(spark, path, first)
    out = None
    for commit, state in enumerate(("saved", "replaced", "deleted", "restored"), 1):
        tables = graph_commits.load(spark, path, commit=commit)
        for name, kind, key, content in (("entities", "entity", "entity_id", "name"), ("relations", "relation", "relation_id", "source_entity")):
            part = tables[name].select(F.lit(state).alias("state"), named, F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(content).alias("content"))
            out = part if out is None else out.unionByName(part)
    return out
