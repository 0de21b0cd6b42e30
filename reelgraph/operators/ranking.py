"""Fusing, scoring and ranking of retrieval results.

A result row has ``result_type, result_id, video_id, at, until, relevance, text_score, visual_score,
entity_score, explanation, content`` and ``leg``, the number of the leg it came from.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window, functions as F

from reelgraph.config import RetrievalSettings
from reelgraph.functions import text
from reelgraph.session import cut_lineage

KEY = ["result_type", "result_id"]


def merge_duplicates(results: DataFrame, settings: RetrievalSettings = RetrievalSettings(), keywords=()) -> DataFrame:
    """One row per (type, id).  A row that occurs once keeps its relevance; a repeated one takes the
    weighted sum of its best text, visual and entity scores.

    Every output is a fixed-size aggregate, so a result named by very many rows costs no more memory
    than any other.  ``explanation`` is the first one; ``explanations_of`` lists them all.
    """
    s = settings
    first = F.struct("leg", -F.col("relevance"), "explanation")
    merged = results.groupBy(*KEY).agg(
        F.count("*").alias("copies"),
        F.max("relevance").alias("own"),
        *[F.max(c).alias(c) for c in ("text_score", "visual_score", "entity_score")],
        *[F.min(c).alias(c) for c in ("video_id", "at", "until", "content")],
        F.min_by("explanation", first).alias("explanation"),
        *[F.max(text.contains_ci(F.col("explanation"), k)).alias(f"_kw{i}") for i, k in enumerate(keywords)],
    )
    blended = (
        F.col("text_score") * s.text_weight + F.col("visual_score") * s.visual_weight + F.col("entity_score") * s.entity_weight
    )
    hit = [
        F.when(F.col(f"_kw{i}") | F.coalesce(text.contains_ci(F.col("content"), k), F.lit(False)), F.lit(k))
        for i, k in enumerate(keywords)
    ]
    matched = F.array_compact(F.array(*hit)) if hit else F.array().cast("array<string>")
    return merged.select(
        *KEY, "video_id", "at", "until",
        F.when(F.col("copies") > 1, blended).otherwise(F.col("own")).alias("relevance"),
        "text_score", "visual_score", "entity_score", "explanation", "copies", matched.alias("keywords_matched"),
    )


def drop_known_vectors(merged: DataFrame) -> DataFrame:
    """Merged results without the vector hits of entities that are there by name or relation.

    Merged rows are unique per type and id, so an id has a handful of rows at most.
    """
    known = F.max(F.col("result_type").isin("entity", "related_entity")).over(Window.partitionBy("result_id"))
    rows = merged.withColumn("_known", known)
    return rows.filter(~((F.col("result_type") == "entity_embedding") & F.col("_known"))).drop("_known")


def explanations_of(results: DataFrame, page: DataFrame) -> DataFrame:
    """Every distinct explanation of the results on a page, one row each."""
    return results.join(page.select(*KEY), KEY, "left_semi").select(*KEY, "explanation").distinct()


def single_leg(results: DataFrame, keywords=()) -> DataFrame:
    """The rows of one leg in the shape ``merge_duplicates`` gives, without merging anything."""
    hit = [
        F.when(text.contains_ci(F.col("explanation"), k) | F.coalesce(text.contains_ci(F.col("content"), k), F.lit(False)),
               F.lit(k)) for k in keywords
    ]
    matched = F.array_compact(F.array(*hit)) if hit else F.array().cast("array<string>")
    return results.select(
        *KEY, "video_id", "at", "until", "relevance", "text_score", "visual_score", "entity_score", "explanation",
        F.lit(1).cast("bigint").alias("copies"), matched.alias("keywords_matched"),
    )


def temporal_score(at: Column, until: Column, time_preference: str | None, duration_preference: str | None) -> Column:
    """0.3 for a hit in the preferred part of the video plus 0.2 for the preferred length."""
    zero = F.lit(0.0)
    place = {"early": at < 30, "late": at > 120, "middle": at.between(30, 120)}.get(time_preference)
    length = {"short": (until - at) < 10, "long": (until - at) > 30}.get(duration_preference)
    score = zero
    for test, worth in ((place, 0.3), (length, 0.2)):
        if test is not None:
            score = score + F.when(F.coalesce(test, F.lit(False)), F.lit(worth)).otherwise(zero)
    return score


def apply_temporal(results: DataFrame, time_preference, duration_preference, weight: float = 0.1) -> DataFrame:
    """Add the temporal score, weighted, to the relevance."""
    scored = results.withColumn(
        "temporal_score", temporal_score(F.col("at"), F.col("until"), time_preference, duration_preference)
    )
    return scored.withColumn("relevance", F.col("relevance") + F.col("temporal_score") * weight)


def diversify(results: DataFrame, per_video: int = 3, min_rows: int = 5, cap: int = 30) -> DataFrame:
    """At most ``per_video`` rows of a video and ``cap`` rows in all, best first; rows without a video
    are never held back, and up to ``min_rows`` rows pass unchanged.

    Both limits reach the tasks before any shuffle.  Each video ships at most ``min_rows + 1`` rows per
    task, which is enough to tell whether more than ``min_rows`` exist; the page of the best
    ``cap * ceil((min_rows + 1) / per_video)`` of those holds every row that can be kept, because in any
    prefix a video has no more than that factor of surplus rows per kept row.
    """
    per_task = max(per_video, min_rows + 1)
    page_rows = cap * -(-per_task // per_video)
    best = [F.desc("relevance"), F.asc("result_type"), F.asc("result_id")]
    group = F.coalesce("video_id", F.concat_ws("\u0001", F.lit(""), "result_type", "result_id"))
    ranked = results.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*best)))
    page = ranked.filter(F.col("_rn") <= per_task).orderBy(*best).limit(page_rows)
    counted = page.withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(0))))
    kept = counted.filter((F.col("_n") <= min_rows) | (F.col("_rn") <= per_video))
    return kept.orderBy(*best).limit(cap).drop("_rn", "_n")


def rank_page(page: DataFrame) -> DataFrame:
    """Competition rank on one bounded page: one more than the rows with strictly higher relevance."""
    over = Window.partitionBy(F.lit(0)).orderBy(F.desc("relevance"))
    return page.withColumn("rank", F.rank().over(over).cast("bigint"))


def competition_rank(rows: DataFrame, score: str, ranges: int | None = None) -> DataFrame:
    """Competition rank over any number of rows and scores of any range; null scores rank last.

    Equal scores are counted first, map-side.  Distinct scores are dealt to ``ranges`` tasks by splitters sampled from the scores
    themselves, so they fill all tasks however close together they lie.  Each range is ranked by itself and shifted by the number of
    rows in the ranges before it.  The dealt scores are written once, because a second sample could draw other splitters.
    """
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best_first = F.desc_nulls_last("_score")
    distinct = rows.groupBy(F.col(score).alias("_score")).agg(F.count("*").alias("_n"))
    dealt = cut_lineage(distinct.repartitionByRange(ranges, best_first).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row per range
    above = dealt.groupBy("_range").agg(F.sum("_n").alias("_t")).select("_range", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_above"))
    inside = Window.partitionBy("_range").orderBy(best_first).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(F.broadcast(above), "_range")
    ranks = placed.select("_score", (F.col("_above") + F.col("_before") + 1).alias("rank"))
    return rows.join(ranks, F.col(score).eqNullSafe(F.col("_score"))).drop("_score")


def post_process(
    results: DataFrame, settings: RetrievalSettings = RetrievalSettings(), max_results: int | None = None, judge=None,
) -> DataFrame:
    """Threshold, order, diversify, judge where one is given, rank, cut.

    The page holds twice the final number of rows, or ``max_results`` if that is more.
    """
    kept = results.filter(F.col("relevance") >= settings.confidence_threshold)
    page = diversify(kept, settings.per_video_limit, settings.diversity_min_rows, max(settings.top_k_final * 2, max_results or 0))
    if judge is not None:
        page = judge_page(page, judge, settings.confidence_threshold)
    ranked = rank_page(page)
    return ranked.orderBy("rank", "result_type", "result_id").limit(max_results) if max_results else ranked


def judge_page(page: DataFrame, judge, threshold: float = 0.6, use_judge: bool = True, shown: int = 10) -> DataFrame:
    """Keep the rows of a bounded page that ``judge`` calls relevant.

    ``judge`` gets the descriptions of the first ``shown`` rows and returns a 0/1 list; rows beyond the
    list stay.  If it fails, rows at or above the relevance threshold stay.
    """
    if not use_judge:
        return page
    top = page.orderBy(F.desc("relevance"), "result_type", "result_id").limit(shown).collect()
    try:
        marks = list(judge([f"{r['result_type']} {r['result_id']}: {r['explanation']}" for r in top]))
    except Exception as e:
        warnings.warn(f"the judge failed, rows are kept by their relevance: {e!r}", stacklevel=2)
        return page.filter(F.col("relevance") >= threshold)
    dropped = [(r["result_type"], r["result_id"]) for r, mark in zip(top, marks) if mark != 1]
    for kind, key in dropped:
        page = page.filter(~((F.col("result_type") == kind) & (F.col("result_id") == key)))
    return page
