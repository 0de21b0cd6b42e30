"""Merging entities and relations: within a video, into a growing graph, and across graphs.

Set-valued attributes are kept one element per row.  A name carried by a third of all mentions is
then a plain partial aggregate plus distinct child rows; no row and no task ever holds the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reelgraph.operators.folding import fold_affine, running_sum


def name_key() -> Column:
    return F.lower("name")


def _group(within: tuple[str, ...]) -> list:
    return [*within, "entity_type", name_key().alias("name_key")]


def merge_mentions(mentions: DataFrame, order: str = "seq", within: tuple[str, ...] = ()) -> DataFrame:
    """One entity per (type, lower-case name): identity of the first mention, mean confidence.

    Mentions are ``seq, entity_id, name, entity_type, description, confidence, video_id``; ``within``
    adds grouping columns, such as the video.
    """
    return mentions.groupBy(*_group(within)).agg(
        F.min_by("entity_id", order).alias("entity_id"),
        F.min_by("name", order).alias("name"),
        F.avg("confidence").alias("confidence"),
        F.count("*").alias("mentions"),
    )


def mention_aliases(mentions: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Names of entities mentioned more than once; a single mention adds none."""
    keys = [*within, "entity_type", "name_key"]
    named = mentions.groupBy(*_group(within), "name").agg(F.count("*").alias("n"))
    many = named.groupBy(*keys).agg(F.sum("n").alias("n")).filter(F.col("n") > 1)
    return named.drop("n").join(many.drop("n"), keys, "left_semi").select(*keys, F.col("name").alias("alias"))


def mention_children(mentions: DataFrame, column: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Distinct values of one source column (videos, chunks) per merged entity."""
    return mentions.select(*_group(within), column).distinct()


def mention_descriptions(mentions: DataFrame, order: str = "seq", within: tuple[str, ...] = ()) -> DataFrame:
    """The non-empty descriptions of each merged entity; read in ``order`` and joined with a spaced
    pipe they are its description."""
    return mentions.filter(F.coalesce("description", F.lit("")) != "").select(*_group(within), order, "description")


def merge_relations(mentions: DataFrame, order: str = "seq") -> DataFrame:
    """One relation per (source, type, target): identity of the first, mean confidence."""
    return mentions.groupBy("source_entity", "relation_type", "target_entity").agg(
        F.min_by("relation_id", order).alias("relation_id"),
        F.avg("confidence").alias("confidence"),
        F.count("*").alias("mentions"),
    )


def fold_confidence(versions: DataFrame, chunks: DataFrame, key: str = "entity_id", span: int = 1024) -> DataFrame:
    """Confidence of each entity after merging its versions one by one in ``seq`` order.

    ``versions`` has one row per (key, seq) with a ``confidence``; ``chunks`` lists the source chunks of
    each version.  A merge weighs the new version by its n chunks and the old state by the size of the
    union minus n; with an empty union it changes nothing.
    """
    distinct = chunks.select(key, "seq", "chunk_id").distinct()
    here = F.row_number().over(Window.partitionBy(key, "chunk_id").orderBy("seq")) == 1
    # One grouping gives each version its chunks, those of them not seen before, and its confidence.
    parts = distinct.select(key, "seq", F.lit(None).cast("double").alias("confidence"), F.lit(1).alias("n"), here.cast("int").alias("fresh"))
    given = versions.select(key, "seq", F.col("confidence").cast("double").alias("confidence"), F.lit(0).alias("n"), F.lit(0).alias("fresh"), F.lit(1).alias("given"))
    base = parts.withColumn("given", F.lit(0)).unionByName(given).groupBy(key, "seq").agg(
        F.max("confidence").alias("confidence"), F.sum("n").alias("n"), F.sum("fresh").alias("fresh"), F.max("given").alias("_given")
    ).filter(F.col("_given") == 1).drop("_given")
    base = running_sum(base, [key], "seq", "fresh", "union")
    first = versions.groupBy(key).agg(F.min("seq").alias("_first"))
    steps = base.join(first, key)
    n, u = F.col("n"), F.col("union")
    start = F.col("seq") == F.col("_first")
    a = F.when(start, F.lit(0.0)).when(u == 0, F.lit(1.0)).otherwise(F.try_divide((u - n).cast("double"), u))
    b = F.when(start, F.col("confidence")).when(u == 0, F.lit(0.0)).otherwise(
        F.try_divide(F.col("confidence") * n, u.cast("double"))
    )
    top = versions.agg(F.max("seq")).first()[0] or 0
    return fold_affine(steps, [key], "seq", a, b, "confidence", span, top)


def fold_descriptions(versions: DataFrame, key: str = "entity_id") -> DataFrame:
    """The descriptions that a one-by-one merge keeps, by ``seq``; joined with a spaced pipe they are
    the merged description.

    Empty ones are skipped, and so are repeats of the first one until a different one has come, because
    only then does the merged text differ from a repeat.
    """
    some = versions.filter(F.coalesce("description", F.lit("")) != "").select(key, "seq", "description")
    first = some.groupBy(key).agg(F.min_by("description", "seq").alias("_d"), F.min("seq").alias("_f"))
    tagged = some.join(first, key)
    turn = tagged.filter(F.col("description") != F.col("_d")).groupBy(key).agg(F.min("seq").alias("_g"))
    kept = tagged.join(turn, key, "left").filter((F.col("seq") == F.col("_f")) | (F.col("seq") >= F.col("_g")))
    return kept.select(key, "seq", "description")


def fold_aliases(versions: DataFrame, aliases: DataFrame, key: str = "entity_id") -> DataFrame:
    """Aliases after the merges: all given ones, plus the names of every version but the first."""
    first = versions.groupBy(key).agg(F.min("seq").alias("_f"))
    later = versions.join(first, key).filter(F.col("seq") > F.col("_f")).select(key, F.col("name").alias("alias"))
    return aliases.select(key, "alias").unionByName(later).distinct()


def fold_entities(versions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Entities of several graphs merged in ``seq`` order: identity of the first version."""
    head = versions.groupBy("entity_id").agg(
        F.min_by("name", "seq").alias("name"), F.min_by("entity_type", "seq").alias("entity_type"),
        F.count("*").alias("versions"),
    )
    return head.join(fold_confidence(versions, chunks), "entity_id")


def fold_relations(versions: DataFrame) -> DataFrame:
    """Relations of several graphs merged by id: endpoints of the first, highest confidence."""
    return versions.groupBy("relation_id").agg(
        *[F.min_by(c, "seq").alias(c) for c in ("source_entity", "target_entity", "relation_type")],
        F.max("confidence").alias("confidence"), F.count("*").alias("versions"),
    )


def video_index(entity_videos: DataFrame) -> DataFrame:
    """The video-to-entities mapping, derived when asked for."""
    return entity_videos.select("video_id", "entity_id").distinct()
