"""Retrieval: understand a query, run its legs, fuse, score, rank.

Understanding runs once, over one row.  The ids of named entities are written once, so that their relations are
cut by them at the scan.  The rest is one Catalyst plan, and nothing of it is read until the caller acts.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from reelgraph.config import RetrievalSettings
from reelgraph.functions import text
from reelgraph.operators import graph_search as gs, knn, media_search as ms, ranking

Embed = Callable[[str], Sequence[float] | None]
STRATEGIES = ("text", "visual", "entity", "hybrid")


@dataclass(frozen=True)
class MediaStore:
    """The tables a retrieval reads."""

    videos: DataFrame
    frames: DataFrame
    audio: DataFrame
    vectors: DataFrame
    entities: DataFrame
    aliases: DataFrame
    entity_videos: DataFrame
    relations: DataFrame


@dataclass(frozen=True)
class QueryContext:
    original: str
    processed: str
    query_type: str
    keywords: tuple[str, ...]
    time_preference: str | None = None
    duration_preference: str | None = None
    video_id: str | None = None
    include_entities: bool = True
    max_results: int = 10

    @property
    def may_name_entities(self) -> bool:
        """Whether the query has a word long enough to name an entity."""
        return self.include_entities and any(len(w) > 2 for w in self.processed.lower().split())


def understand(
    spark: SparkSession, query: str, video_id: str | None = None, max_results: int = 10,
    include_entities: bool = True, include_temporal: bool = True,
) -> QueryContext:
    """Normalise the query and derive its keywords, class and time constraints."""
    clean = text.normalize_text(F.col("q"))
    keywords = text.extract_keywords(F.col("p"), 10)
    row = (
        spark.range(1).select(F.lit(query).alias("q")).select(clean.alias("p")).withColumn("k", keywords)
        .select("p", "k", text.query_type(F.col("p"), text.keyword_count(F.col("p"), 10)).alias("t"),
                text.time_preference(F.col("p")).alias("time"), text.duration_preference(F.col("p")).alias("length"))
        .first()
    )
    return QueryContext(
        query, row["p"], row["t"], tuple(row["k"]), row["time"] if include_temporal else None,
        row["length"] if include_temporal else None, video_id, include_entities, max_results,
    )


def _result(leg: int, kind, result_id, video_id, at, until, score, explanation, content, role: str):
    zero = F.lit(0.0)
    null_d, null_s = F.lit(None).cast("double"), F.lit(None).cast("string")
    return [
        F.lit(leg).alias("leg"), (F.lit(kind) if isinstance(kind, str) else kind).alias("result_type"),
        result_id.alias("result_id"), (null_s if video_id is None else video_id).alias("video_id"),
        (null_d if at is None else at).alias("at"), (null_d if until is None else until).alias("until"),
        score.alias("relevance"),
        *[(score if role == r else zero).alias(f"{r}_score") for r in ("text", "visual", "entity")],
        explanation.alias("explanation"), (null_s if content is None else content).alias("content"),
    ]


def _scored_entities(store: MediaStore, ctx: QueryContext, s: RetrievalSettings) -> DataFrame:
    """Entities whose name holds the whole query, scored, at or above the similarity threshold."""
    hits = gs.query_entities(store.entities, store.entity_videos, None, ctx.processed, ctx.video_id)
    owners = store.aliases.filter(text.contains_ci(F.col("alias"), ctx.processed)).select(
        "entity_id", F.lit(True).alias("alias_hit")
    ).distinct()
    score = text.entity_relevance(
        ctx.processed, ctx.keywords, ctx.query_type, F.col("name"), F.col("description"),
        F.coalesce("alias_hit", F.lit(False)), F.col("confidence"),
    )
    return hits.join(owners, "entity_id", "left").withColumn("score", score).filter(
        F.col("score") >= s.similarity_threshold
    )


def _named_rows(named: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """Result rows of named entities for the text leg, the entity leg, or both from one pass."""
    label = {"text": "Entity match: ", "entity": "Entity: "}
    shapes = [
        F.struct(*_result(
            {"text": 1, "entity": 3}[role], "entity", F.col("entity_id"), None, None, None, F.col("score"),
            F.concat(F.lit(label[role]), "name", F.lit(" ("), "entity_type", F.lit(")")), F.col("description"), role,
        ))
        for role in roles
    ]
    return named.select(F.inline(F.array(*shapes)))


def text_leg(store: MediaStore, ctx: QueryContext, s: RetrievalSettings, with_entities: bool = True, compat: bool = False) -> DataFrame:
    """Captions, transcripts and entity names that hold the query.

    All hits are scored and the best kept; ``compat`` keeps the hits of highest confidence instead and scores those.
    """
    before = s.top_k_text if compat else None

    def scored(rows: DataFrame, column: str) -> DataFrame:
        return rows.withColumn("score", text.text_relevance(ctx.processed, F.col(column), ctx.keywords)).filter(
            F.col("score") >= s.similarity_threshold
        )

    def quote(label: str, column: str):
        return F.concat(F.lit(label), F.substring(column, 1, 50), F.lit("..."))

    f = scored(ms.search_frames(store.frames, store.videos, ctx.processed, ctx.video_id, before), "caption")
    a = scored(ms.search_audio(store.audio, store.videos, ctx.processed, ctx.video_id, before), "transcript")
    if not compat:
        f = f.orderBy(F.desc("score"), "timestamp", "frame_id").limit(s.top_k_text)
        a = a.orderBy(F.desc("score"), "start_time", "segment_id").limit(s.top_k_text)
    out = f.select(*_result(
        1, "frame", F.col("frame_id"), F.col("video_id"), F.col("timestamp"), None, F.col("score"),
        quote("Caption match: ", "caption"), F.col("caption"), "text",
    )).unionByName(a.select(*_result(
        1, "audio_segment", F.col("segment_id"), F.col("video_id"), F.col("start_time"), F.col("end_time"), F.col("score"),
        quote("Transcript match: ", "transcript"), F.col("transcript"), "text",
    )))
    if ctx.may_name_entities and with_entities:
        out = out.unionByName(_named_rows(_scored_entities(store, ctx, s), ("text",)))
    return out


def visual_leg(store: MediaStore, ctx: QueryContext, s: RetrievalSettings, query_vector) -> DataFrame:
    """Frames and chunks nearest to the query vector: one scan, k per type."""
    vectors = store.vectors
    if ctx.video_id:
        vectors = vectors.filter(F.col("video_id") == ctx.video_id)
    hits = knn.top_k_per_type(vectors, query_vector, s.top_k_visual, s.similarity_threshold, ("frame", "chunk"))
    score = F.col("similarity")
    label = F.format_string("Similar %s (%.3f)", F.col("source_type"), score)
    return hits.select(*_result(
        2, F.concat("source_type", F.lit("_embedding")), F.col("source_id"), F.col("video_id"), None, None, score, label,
        None, "visual",
    ))


def entity_leg(
    store: MediaStore, ctx: QueryContext, s: RetrievalSettings, query_vector, top_related: int = 3,
    roles: tuple[str, ...] = ("entity",), drop_known: bool = True,
) -> DataFrame:
    """Named entities, their strongest relations, and entity vectors near the query.

    Vectors of entities found by name or relation are dropped here, or, without ``drop_known``, by
    ``ranking.drop_known_vectors`` after merging, which reads the leg once only.
    """
    named = _scored_entities(store, ctx, s)
    out = _named_rows(named, roles)
    parents = named.select("entity_id", F.col("score").alias("parent_score"), F.col("name").alias("parent"))
    related = (
        gs.related_entities(store.relations, store.entities, parents, top_related)
        .withColumn("score", F.col("parent_score") * F.col("strength") * 0.8)
        .filter(F.col("score") >= s.similarity_threshold)
    )
    out = out.unionByName(related.select(*_result(
        3, "related_entity", F.col("other_id"), None, None, None, F.col("score"),
        F.concat(F.lit("Related to "), "parent", F.lit(": "), "other_name"), F.col("other_description"), "entity",
    )))
    if ctx.may_name_entities and query_vector is not None:
        mentioned = gs.mentioned_entities(store.entities, store.aliases, ctx.processed)
        any_mention = mentioned.limit(1).agg(F.count("*")).scalar()
        vectors = store.vectors.filter((F.col("source_type") == "entity") & (any_mention > 0))
        hits = knn.top_k(vectors, query_vector, s.top_k_visual, s.similarity_threshold)
        fresh = hits
        if drop_known:
            fresh = hits.join(out.select(F.col("result_id").alias("source_id")), "source_id", "left_anti")
        label = F.format_string("Similar entity (%.3f)", F.col("similarity"))
        out = out.unionByName(fresh.select(*_result(
            3, "entity_embedding", F.col("source_id"), F.col("video_id"), None, None, F.col("similarity"), label, None, "entity"
        )))
    return out


def hybrid_rows(store: MediaStore, ctx: QueryContext, s: RetrievalSettings, query_vector) -> DataFrame:
    """The three legs one under the other, before merging; named entities are read once for two legs."""
    out = text_leg(store, ctx, s, with_entities=False)
    if query_vector is not None:
        out = out.unionByName(visual_leg(store, ctx, s, query_vector))
    roles = ("text", "entity") if ctx.may_name_entities else ("entity",)
    return out.unionByName(entity_leg(store, ctx, s, query_vector, roles=roles, drop_known=False))


def candidates(
    store: MediaStore, ctx: QueryContext, strategy: str, s: RetrievalSettings, query_vector=None
) -> DataFrame:
    """Scored results of a strategy before the threshold and the final ranking."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}, use one of {', '.join(STRATEGIES)}")
    if strategy == "text":
        rows = ranking.single_leg(text_leg(store, ctx, s), ctx.keywords)
    elif strategy == "visual":
        rows = ranking.single_leg(visual_leg(store, ctx, s, query_vector), ctx.keywords)
    elif strategy == "entity":
        rows = ranking.single_leg(entity_leg(store, ctx, s, query_vector), ctx.keywords)
    else:
        merged = ranking.merge_duplicates(hybrid_rows(store, ctx, s, query_vector), s, ctx.keywords)
        rows = ranking.drop_known_vectors(merged)
    tp = ctx.time_preference if strategy == "hybrid" else None
    dp = ctx.duration_preference if strategy == "hybrid" else None
    return ranking.apply_temporal(rows, tp, dp, s.temporal_weight)


def retrieve(
    store: MediaStore, query: str, strategy: str = "hybrid", embed: Embed | None = None, video_id: str | None = None,
    max_results: int | None = None, settings: RetrievalSettings = RetrievalSettings(), include_entities: bool = True,
    include_temporal: bool = True, judge: Callable[[list[str]], list[int]] | None = None,
) -> DataFrame:
    """Ranked results of one query; ``judge``, if given, says which of the first rows are relevant."""
    spark = store.videos.sparkSession
    ctx = understand(spark, query, video_id, max_results or 10, include_entities, include_temporal)
    vector = embed(ctx.processed) if embed is not None else None
    return ranking.post_process(candidates(store, ctx, strategy, settings, vector), settings, ctx.max_results, judge)


@dataclass
class ResponseCache:
    """Persisted answers by query: they expire, and a full cache drops its oldest quarter."""

    settings: RetrievalSettings = RetrievalSettings()
    clock: Callable[[], float] = time.time
    entries: dict[str, tuple[float, DataFrame]] = field(default_factory=dict)

    def get(self, key: str) -> DataFrame | None:
        found = self.entries.get(key)
        if found is None:
            return None
        if self.clock() - found[0] > self.settings.cache_ttl_seconds:
            self._drop(key)
            return None
        return found[1]

    def put(self, key: str, answer: DataFrame) -> DataFrame:
        if len(self.entries) >= self.settings.cache_size:
            oldest = sorted(self.entries, key=lambda k: self.entries[k][0])
            for k in oldest[: max(1, self.settings.cache_size // 4)]:
                self._drop(k)
        self.entries[key] = (self.clock(), answer.persist())
        return answer

    def clear(self) -> None:
        for key in list(self.entries):
            self._drop(key)

    def stats(self) -> dict[str, int]:
        return {"entries": len(self.entries), "capacity": self.settings.cache_size}

    def _drop(self, key: str) -> None:
        self.entries.pop(key)[1].unpersist()


def cache_key(ctx: QueryContext, strategy: str) -> str:
    import hashlib

    parts = (ctx.processed, strategy, ctx.video_id or "", str(ctx.max_results), ctx.query_type)
    return hashlib.md5("|".join(parts).encode()).hexdigest()[:16]


__all__ = ["MediaStore", "QueryContext", "ResponseCache", "retrieve", "understand", "cache_key"]
