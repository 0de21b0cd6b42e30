"""The metadata, vector and graph tables: creation, shredding, upserts, deletes, sync."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from reelgraph.schema import GRAPH_TABLES, METADATA_TABLES
from reelgraph.sources import graph_commits


def create_tables(spark: SparkSession, database: str = "default", buckets: int | None = None, location: str | None = None) -> None:
    """Create the metadata tables where they do not exist.

    With ``buckets`` every table is bucketed and sorted by video, so that joins and lookups by video
    need no shuffle and skip files by their statistics; this takes the place of secondary indexes.
    """
    for name, schema in METADATA_TABLES.items():
        cluster = f" CLUSTERED BY (video_id) SORTED BY (video_id) INTO {buckets} BUCKETS" if buckets else ""
        place = f" LOCATION '{location}/{name}'" if location else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({schema}) USING parquet{cluster}{place}")


def shred(processed: DataFrame, now: float) -> dict[str, DataFrame]:
    """The four metadata tables of nested processed videos; nothing is shuffled."""
    chunk_rows = processed.select("video_id", F.explode("chunks").alias("c"))
    frame_rows = chunk_rows.select("video_id", F.col("c.chunk_id").alias("chunk_id"), F.explode("c.frames").alias("f"))
    at = F.lit(float(now))
    n_frames = F.aggregate("chunks", F.lit(0), lambda n, c: n + F.size(F.coalesce(c["frames"], F.array())))
    return {
        "videos": processed.select(
            "video_id", "video_path", "filename", "duration", "fps", "resolution", "size_bytes", "processing_time",
            F.size(F.coalesce("chunks", F.array())).alias("chunk_count"), F.coalesce(n_frames, F.lit(0)).alias("frame_count"),
            at.alias("created_at"), at.alias("updated_at"), "success", "error_message",
        ),
        "chunks": chunk_rows.select(
            "c.chunk_id", "video_id", "c.start_time", "c.end_time", F.size(F.coalesce("c.frames", F.array())).alias("frame_count"),
            F.coalesce("c.unified_description", F.lit("")).alias("unified_description"),
            F.col("c.audio_segment").isNotNull().alias("has_audio"), at.alias("created_at"),
        ),
        "frames": frame_rows.select(
            "f.frame_id", "chunk_id", "video_id", "f.timestamp", "f.frame_index", F.coalesce("f.caption", F.lit("")).alias("caption"),
            "f.confidence", F.coalesce("f.image_path", F.lit("")).alias("image_path"), at.alias("created_at"),
        ),
        "audio_segments": chunk_rows.filter(F.col("c.audio_segment").isNotNull()).select(
            "c.audio_segment.segment_id", F.col("c.chunk_id").alias("chunk_id"), "video_id", "c.audio_segment.start_time",
            "c.audio_segment.end_time", F.coalesce("c.audio_segment.transcript", F.lit("")).alias("transcript"),
            "c.audio_segment.confidence", F.coalesce("c.audio_segment.audio_path", F.lit("")).alias("audio_path"),
            at.alias("created_at"),
        ),
    }


def media_vectors(processed: DataFrame, now: float) -> DataFrame:
    """Vector rows of the chunks and frames of successful videos that have one."""
    c = processed.filter("success").select("video_id", F.explode("chunks").alias("c"))
    chunk = c.filter(F.col("c.chunk_embedding").isNotNull()).select(
        F.concat(F.lit("chunk_"), "c.chunk_id").alias("entry_id"), F.col("c.chunk_embedding").alias("vector"),
        F.create_map(
            F.lit("start_time"), F.col("c.start_time").cast("string"), F.lit("end_time"), F.col("c.end_time").cast("string"),
            F.lit("description"), F.coalesce("c.unified_description", F.lit("")),
        ).alias("metadata"),
        F.lit("chunk").alias("source_type"), F.col("c.chunk_id").alias("source_id"), "video_id",
        F.col("c.start_time").alias("timestamp"), F.lit(float(now)).alias("created_at"),
    )
    f = c.select("video_id", F.col("c.chunk_id").alias("chunk_id"), F.explode("c.frames").alias("f"))
    frame = f.filter(F.col("f.embedding").isNotNull()).select(
        F.concat(F.lit("frame_"), "f.frame_id").alias("entry_id"), F.col("f.embedding").alias("vector"),
        F.create_map(
            F.lit("chunk_id"), F.col("chunk_id"), F.lit("caption"), F.coalesce("f.caption", F.lit("")),
        ).alias("metadata"),
        F.lit("frame").alias("source_type"), F.col("f.frame_id").alias("source_id"), "video_id", F.col("f.timestamp").alias("timestamp"),
        F.lit(float(now)).alias("created_at"),
    )
    return chunk.unionByName(frame)


def entity_vectors(entities: DataFrame, entity_videos: DataFrame, now: float) -> DataFrame:
    """Vector rows of entities with an ``embedding``; the video is the smallest of its source videos."""
    home = entity_videos.groupBy("entity_id").agg(F.min("video_id").alias("video_id"))
    return entities.filter(F.col("embedding").isNotNull()).join(home, "entity_id", "left").select(
        F.concat(F.lit("entity_"), "entity_id").alias("entry_id"), F.col("embedding").alias("vector"),
        F.create_map(F.lit("name"), F.col("name"), F.lit("entity_type"), F.col("entity_type")).alias("metadata"),
        F.lit("entity").alias("source_type"), F.col("entity_id").alias("source_id"),
        F.coalesce("video_id", F.lit("")).alias("video_id"), F.lit(None).cast("double").alias("timestamp"),
        F.lit(float(now)).alias("created_at"),
    )


def latest_by_key(rows: DataFrame, key: str, *version: str) -> DataFrame:
    """The last version of every key; each task ships at most one row per key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(v) for v in version])
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def upsert(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` replace the target's rows of the same key; within ``rows`` keys are unique."""
    return target.join(rows.select(key), key, "left_anti").unionByName(rows)


def insert_absent(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The target plus the rows whose key it does not hold yet."""
    return target.unionByName(rows.join(target.select(key), key, "left_anti"))


def delete_by_key(target: DataFrame, key: str, value: str) -> DataFrame:
    return target.filter(~F.col(key).eqNullSafe(value))


def delete_video(tables: dict[str, DataFrame], video_id: str) -> dict[str, DataFrame]:
    """Every table, metadata and vectors alike, without the video."""
    return {name: df.filter(F.coalesce("video_id", F.lit("")) != video_id) for name, df in tables.items()}


def expire_failed(videos: DataFrame, cutoff: float) -> DataFrame:
    """Videos without the failed ones created before the cutoff."""
    expired = (F.col("created_at") < cutoff) & ~F.col("success")
    return videos.filter(~F.coalesce(expired, F.lit(False)))  # unknown times and outcomes are kept


def orphaned_vectors(vectors: DataFrame, videos: DataFrame) -> DataFrame:
    """Vectors of videos that do not exist, those without a video among them."""
    return vectors.join(videos.select("video_id"), "video_id", "left_anti")


def kept_vectors(vectors: DataFrame, videos: DataFrame) -> DataFrame:
    return vectors.join(videos.select("video_id"), "video_id", "left_semi")


def sync(target: dict[str, DataFrame], source: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Another store's rows added to this one: absent videos with their child rows, absent vectors,
    graphs that do not exist here.  Child rows of known videos are not copied."""
    out = dict(target)
    new_videos = source["videos"].join(target["videos"].select("video_id"), "video_id", "left_anti")
    out["videos"] = target["videos"].unionByName(new_videos)
    for name in ("chunks", "frames", "audio_segments"):
        if name in source:
            out[name] = target[name].unionByName(source[name].join(new_videos.select("video_id"), "video_id", "left_semi"))
    if "vectors" in source:
        out["vectors"] = insert_absent(target["vectors"], source["vectors"], "entry_id")
    if "entities" in source:
        known = target["entities"].select("graph_id").distinct()
        for name in GRAPH_TABLES:
            if name in source:
                out[name] = target[name].unionByName(source[name].join(known, "graph_id", "left_anti"))
    return out


def touch_unused(videos: DataFrame, now: float) -> DataFrame:
    """Set the last access of never used videos to now."""
    return videos.withColumn("last_accessed", F.when(F.col("last_accessed") == 0, F.lit(float(now))).otherwise(F.col("last_accessed")))


def register_videos(known: DataFrame, offered: DataFrame, formats: tuple[str, ...], now: float) -> DataFrame:
    """Outcome of offering media files: new ones become pending once, known ones count as accepted,
    files of other formats are rejected.

    ``offered`` has ``video_id, path``; the result adds ``accepted`` and ``status``.
    """
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    first = latest_by_key(offered.withColumn("_o", F.col("path")), "video_id", "_o").drop("_o")
    have = known.select("video_id", F.lit(True).alias("_known"))
    ok = suffix.isin(*formats)
    return first.join(have, "video_id", "left").select(
        "video_id", "path", (ok | F.coalesce("_known", F.lit(False))).alias("accepted"),
        F.when(F.col("_known"), "known").when(ok, "pending").otherwise("rejected").alias("status"),
        F.lit(float(now)).alias("added_time"),
    )


def delete_graph(spark: SparkSession, path: str, *graph_ids: str) -> None:
    """Remove stored graphs, all their tables, by one commit."""
    graph_commits.delete(spark, path, *graph_ids)


def save_graph(tables: dict[str, DataFrame], path: str) -> None:
    """Replace the graphs given by one commit, also where a table has become empty; see ``graph_commits``."""
    graph_commits.save(tables, path)


def load_graph(spark: SparkSession, path: str, graph_id: str | None = None) -> dict[str, DataFrame]:
    """Graph tables as of the newest commit; one graph reads its own partitions only."""
    return graph_commits.load(spark, path, graph_id)


def list_graphs(entities: DataFrame) -> DataFrame:
    return entities.select("graph_id").distinct()


def save_graph_json(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def load_graph_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in GRAPH_TABLES.items()}


def to_wire(processed: DataFrame) -> DataFrame:
    """Nested videos as one JSON text per row."""
    return processed.select("video_id", F.to_json(F.struct(*processed.columns)).alias("payload"))


def from_wire(messages: DataFrame) -> DataFrame:
    from reelgraph.schema import PROCESSED_VIDEO

    return messages.select(F.from_json("payload", PROCESSED_VIDEO).alias("v")).select("v.*")


