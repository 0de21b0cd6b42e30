"""One object over the tables of a media library, for interactive use.

Every method returns a lazy DataFrame or, where it changes something, a new ``Library``; nothing is
modified in place and nothing is held in memory.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from reelgraph.config import Settings
from reelgraph.operators import graph_algorithms as ga, graph_search as gs, knn, media_search as ms, stats
from reelgraph.plans import retrieval
from reelgraph.schema import GRAPH_TABLES, METADATA_KEYS, METADATA_TABLES, VECTORS
from reelgraph.sources import delta_store, exchange, store

STORED = {**METADATA_TABLES, "vectors": VECTORS, **GRAPH_TABLES}
KEYS = {**METADATA_KEYS, "vectors": "entry_id", "relations": "relation_id"} | dict.fromkeys(
    ("entities", "aliases", "entity_videos", "entity_chunks", "appearances"), "entity_id"
) | {"relation_videos": "relation_id"}


def _shaped(rows: DataFrame, ddl: str) -> DataFrame:
    """The columns of a stored table, null where ``rows`` lacks one."""
    have = set(rows.columns)
    return rows.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(ddl).fields
    ])


@dataclass(frozen=True)
class Library:
    """``tables`` maps table names (metadata, ``vectors``, graph tables) to DataFrames."""

    tables: dict[str, DataFrame]
    settings: Settings = Settings()
    embed: retrieval.Embed | None = None
    cache: retrieval.ResponseCache = field(default_factory=retrieval.ResponseCache)

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> "Library":
        """The last published version of a stored library; missing tables are empty."""
        published = exchange.names_in(spark, f"{path}/published")
        if published:
            path = f"{path}/versions/{published[-1]}"
        tables = {
            name: spark.read.schema(ddl).parquet(f"{path}/{name}") if exchange.exists(spark, f"{path}/{name}")
            else spark.createDataFrame([], ddl)
            for name, ddl in STORED.items()
        }
        return cls(tables, **options)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def with_tables(self, **changed: DataFrame) -> "Library":
        return Library({**self.tables, **changed}, self.settings, self.embed)

    @property
    def videos(self) -> DataFrame:
        """Videos with their state as one word."""
        v = self["videos"]
        return v if "status" in v.columns else v.withColumn("status", F.when(F.col("success"), "completed").otherwise("failed"))

    def _store(self) -> retrieval.MediaStore:
        return retrieval.MediaStore(
            self.videos, self["frames"], self["audio_segments"], self["vectors"], self["entities"], self["aliases"],
            self["entity_videos"], self["relations"],
        )

    # -- queries -------------------------------------------------------------------------------
    def retrieve(self, query: str, strategy: str = "hybrid", video_id: str | None = None, max_results: int = 10) -> DataFrame:
        """Ranked results; a repeated question is answered from the cache."""
        ctx = retrieval.understand(self.videos.sparkSession, query, video_id, max_results)
        key = retrieval.cache_key(ctx, strategy)
        known = self.cache.get(key)
        if known is not None:
            return known
        rows = retrieval.retrieve(
            self._store(), query, strategy, self.embed, video_id, max_results, self.settings.retrieval
        )
        return self.cache.put(key, rows)

    def search(self, text: str | None = None, video_id: str | None = None, limit: int = 50) -> DataFrame:
        return ms.search_library(self.videos, self["frames"], self["audio_segments"], text, video_id, limit=limit)

    def query(self, text: str, return_type: str = "clips", top_k: int = 10) -> DataFrame:
        return ms.query_library(self.videos, self["chunks"], self["frames"], self["entities"], text, return_type, top_k)

    def hybrid(self, text: str, vector: Sequence[float] | None = None, video_id: str | None = None, top_k: int = 10) -> DataFrame:
        filters = {"video_id": video_id} if video_id else None
        near = None if vector is None else knn.top_k(self["vectors"], vector, top_k * 2, filters=filters)
        return ms.hybrid_search(self.videos, self["frames"], self["audio_segments"], near, text, video_id, top_k)

    def near_vector(self, vector: Sequence[float], k: int = 10, threshold: float = 0.0, **filters: str) -> DataFrame:
        return knn.top_k(self["vectors"], vector, k, threshold, filters)

    def similar_to(self, entry_id: str, k: int = 10, threshold: float = 0.7, exclude_same_video: bool = False) -> DataFrame:
        return knn.similar_to_entry(self["vectors"], entry_id, k, threshold, exclude_same_video)

    def time_range(self, video_id: str, start: float, end: float, content_types=("frames", "audio", "entities")) -> DataFrame:
        return ms.content_in_range(
            self["frames"], self["audio_segments"], self["entities"], self["appearances"], video_id, start, end, content_types
        )

    def timeline(self, video_id: str) -> DataFrame:
        return ms.video_timeline(self.videos, self["chunks"], self["frames"], self["audio_segments"], video_id)

    def entity(self, name: str, entity_type: str | None = None, include_related: bool = True, max_results: int = 10) -> DataFrame:
        return gs.entity_segments(
            self["entities"], self["entity_videos"], self["appearances"], self["relations"], name, entity_type, include_related,
            max_results,
        )

    def neighbourhood(self, entity_id: str, depth: int = 2) -> DataFrame:
        return ga.neighbourhood(self["entities"], self["relations"], entity_id, depth)

    def seen_together(self, entity_id: str) -> DataFrame:
        return ga.co_occurrences(self["appearances"], entity_id, self.settings.graph.co_occurrence_window)

    def statistics(self) -> DataFrame:
        return stats.metadata_stats(self.videos, self["chunks"], self["frames"], self["audio_segments"])

    # -- changes -------------------------------------------------------------------------------
    def add(self, processed: DataFrame, now: float) -> "Library":
        """Take in nested processed videos; a video seen before is replaced with its chunks, frames and audio."""
        new = store.shred(processed, now)
        ids = new["videos"].select("video_id")
        out = {n: self[n].join(ids, "video_id", "left_anti").unionByName(rows, allowMissingColumns=True) for n, rows in new.items()}
        out["vectors"] = store.upsert(self["vectors"], store.media_vectors(processed, now), "entry_id")
        return self.with_tables(**out)

    def remove(self, video_id: str) -> "Library":
        """Without one video; graphs stay."""
        parts = {n: self[n] for n in (*METADATA_TABLES, "vectors")}
        return self.with_tables(**store.delete_video(parts, video_id))

    def tidy(self, cutoff: float) -> "Library":
        """Without failed videos from before the cutoff, their chunks, frames and audio, and vectors of videos that do not exist."""
        videos = store.expire_failed(self["videos"], cutoff)
        gone = self["videos"].join(videos.select("video_id"), "video_id", "left_anti").select("video_id")
        parts = {n: self[n].join(gone, "video_id", "left_anti") for n in ("chunks", "frames", "audio_segments")}
        return self.with_tables(videos=videos, vectors=store.kept_vectors(self["vectors"], videos), **parts)

    def prune_graph(self) -> "Library":
        e, r = ga.clean_up(self["entities"], self["relations"], self.settings.graph.cleanup_threshold)
        return self.with_tables(entities=e, relations=r)

    def merge(self, other: "Library") -> "Library":
        """With the videos, vectors and graphs of another library that this one does not have."""
        return self.with_tables(**store.sync(self.tables, other.tables))

    def save(self, path: str) -> None:
        """Write a new version beside the others, then publish it by one small file.

        The tables may be read from the same path; a save that ends half-way leaves the version before in force.
        """
        spark = self["videos"].sparkSession
        published = exchange.names_in(spark, f"{path}/published")
        version = f"{int(published[-1].split('-')[0]) + 1 if published else 1:010d}-{uuid.uuid4().hex[:8]}"
        for name, df in self.tables.items():
            df.write.parquet(f"{path}/versions/{version}/{name}")
        exchange.write_text(spark, f"{path}/published/{version}", version)

    # -- durable changes -----------------------------------------------------------------------
    @classmethod
    def open_changes(cls, spark: SparkSession, path: str, commit: int | None = None, **options) -> "Library":
        """The newest commit of a library kept as base and changes, or an older one."""
        return cls(delta_store.load(spark, path, STORED, commit), **options)

    def save_changes(self, path: str) -> int:
        """Make this the base of ``path``, by one commit; later changes write only what they change."""
        change = delta_store.Change(self["videos"].sparkSession, path, KEYS)
        for name in STORED:
            change.replace(name, self[name])
        return change.commit()

    @staticmethod
    def add_stored(spark: SparkSession, path: str, processed: DataFrame, now: float) -> int:
        """Take in nested processed videos as in ``add``: writes their rows and ids, whatever the size of the store."""
        new, change = store.shred(processed, now), delta_store.Change(spark, path, KEYS)
        ids = new["videos"].select("video_id")
        for name, rows in new.items():
            shaped = _shaped(rows, STORED[name])
            change.delete(name, ids, "video_id").append(name, shaped)
        change.upsert("vectors", _shaped(store.media_vectors(processed, now), STORED["vectors"]))
        return change.commit()

    @staticmethod
    def remove_stored(spark: SparkSession, path: str, *video_ids: str) -> int:
        """Remove videos from every table that names them, graphs' included: writes the ids alone."""
        ids = spark.createDataFrame([(v,) for v in video_ids], "video_id string").coalesce(1)
        change = delta_store.Change(spark, path, KEYS)
        for name, ddl in STORED.items():
            if "video_id" in T.StructType.fromDDL(ddl).names:
                change.delete(name, ids, "video_id")
        return change.commit()

    @staticmethod
    def compact_stored(spark: SparkSession, path: str, share: float = 0.1) -> int | None:
        return delta_store.compact(spark, path, STORED, KEYS, share)

    def export(self, path: str, compress: bool = True) -> None:
        exchange.export_library(self.tables, path, compress=compress)

    def backup(self, folder: str) -> str:
        return exchange.backup(self.tables, folder)
