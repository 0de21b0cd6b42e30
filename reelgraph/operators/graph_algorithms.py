"""Graph analytics on vertex and edge tables.

Iterations cut their lineage through the checkpoint folder.  Messages are combined before they are
shuffled, and edges join to one row per vertex, so adaptive execution can split a hub's edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reelgraph.operators.graph_search import neighbours
from reelgraph.session import cut_lineage


def vertices_of(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entity ids plus relation endpoints that have no entity."""
    ends = relations.select(F.inline(F.array(
        F.struct(F.col("source_entity").alias("entity_id")), F.struct(F.col("target_entity").alias("entity_id"))
    )))
    return entities.select("entity_id").unionByName(ends).distinct()


def degree_stats(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Vertices, undirected edges, density and mean degree, one row.

    Reciprocal relations share edge slots, so a pair has as many undirected edges as its busier direction.
    """
    forward = (F.col("source_entity") <= F.col("target_entity")).cast("int")
    pairs = relations.groupBy(
        F.least("source_entity", "target_entity").alias("u"), F.greatest("source_entity", "target_entity").alias("v")
    ).agg(F.sum(forward).alias("f"), F.count("*").alias("n"))
    m = pairs.agg(F.coalesce(F.sum(F.greatest(F.col("f"), F.col("n") - F.col("f"))), F.lit(0)).alias("m"))
    n = vertices_of(entities, relations).agg(F.count("*").alias("n"))
    both = n.select("n", m.scalar().alias("m"))
    zero = F.lit(0.0)
    two_m = F.col("m") * 2.0
    return both.select(
        F.col("n").alias("vertices"), F.col("m").alias("edges"),
        F.coalesce(F.try_divide(two_m, F.col("n") * (F.col("n") - 1)), zero).alias("density"),
        F.coalesce(F.try_divide(two_m, F.col("n")), zero).alias("mean_degree"),
    )


def connected_components(vertices: DataFrame, relations: DataFrame, max_rounds: int = 60) -> DataFrame:
    """The smallest vertex id of every vertex's undirected component.

    Edges between trees shrink round by round: each tree links to the smallest tree next to it, links are followed to their end, and
    edges inside a tree fall away.  Every tree with an edge joins another, so at least half of them are gone after a round, and links of
    any length collapse in one.  The only circles are pairs that chose each other, of which the smaller one becomes the root.
    """
    edges = cut_lineage(
        relations.filter(F.col("source_entity") != F.col("target_entity"))
        .select(F.least("source_entity", "target_entity").alias("u"), F.greatest("source_entity", "target_entity").alias("v"))
        .distinct()
    )
    trees = None  # (node, root) of every vertex that has an edge
    for _ in range(max_rounds):
        both = edges.select(F.inline(F.array(
            F.struct(F.col("u").alias("node"), F.col("v").alias("near")),
            F.struct(F.col("v").alias("node"), F.col("u").alias("near")),
        )))
        chosen = cut_lineage(both.groupBy("node").agg(F.min("near").alias("root")))
        if chosen.isEmpty():
            break
        back = chosen.select(F.col("node").alias("root"), F.col("root").alias("next"))
        root = F.when((F.col("next") == F.col("node")) & (F.col("node") < F.col("root")), F.col("node")).otherwise(F.col("root"))
        parent = cut_lineage(chosen.join(back, "root").select("node", root.alias("root")))
        # Follow the links to their ends; every hop doubles the distance covered.
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("next"))
            hopped = cut_lineage(parent.join(up, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            parent = hopped.select("node", "root")
            if hopped.filter("moved").isEmpty():
                break
        if trees is None:
            trees = parent
        else:
            higher = parent.select(F.col("node").alias("root"), F.col("root").alias("next"))
            trees = cut_lineage(trees.join(higher, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        left = parent.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        right = parent.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        edges = (
            edges.join(left, "u").join(right, "v").filter(F.col("ru") != F.col("rv"))
            .select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        )
        edges = cut_lineage(edges)
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    if trees is None:
        return vertices.select("entity_id", F.col("entity_id").alias("component"))
    # Ends of relations count, whether or not they are given as vertices.
    least = trees.groupBy("root").agg(F.min("node").alias("component"))
    labels = trees.join(least, "root").select(F.col("node").alias("entity_id"), "component")
    return vertices.select("entity_id").join(labels, "entity_id", "left").select("entity_id", F.coalesce("component", "entity_id").alias("component"))


def component_stats(components: DataFrame) -> DataFrame:
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    return sizes.agg(
        F.count("*").alias("components"), F.coalesce(F.max("size"), F.lit(0)).alias("largest_component")
    )


def bounded_search(relations: DataFrame, center: str, max_depth: int = 2) -> DataFrame:
    """Vertices within ``max_depth`` undirected hops, with depth and the smallest shortest path.

    The frontier keeps one row per new vertex, so it never exceeds the vertex count.
    """
    spark = relations.sparkSession
    links = neighbours(relations).select("entity_id", "other_id").filter(F.col("entity_id") != F.col("other_id"))
    start = spark.range(1).select(
        F.lit(center).alias("entity_id"), F.lit(0).alias("depth"), F.array(F.lit(center)).alias("path")
    )
    seen = frontier = start
    for depth in range(1, max_depth + 1):
        reached = (
            links.join(frontier.select("entity_id", "path"), "entity_id")
            .select(F.col("other_id").alias("entity_id"), F.concat("path", F.array("other_id")).alias("path"))
            .groupBy("entity_id").agg(F.min("path").alias("path"))
        )
        frontier = reached.join(seen.select("entity_id"), "entity_id", "left_anti").select(
            "entity_id", F.lit(depth).alias("depth"), "path"
        )
        if depth > 1:
            frontier = cut_lineage(frontier)
        seen = seen.unionByName(frontier)
    return seen.filter(F.col("depth") > 0)


def neighbourhood(entities: DataFrame, relations: DataFrame, center: str, max_depth: int = 2) -> DataFrame:
    """Known entities by ring: ring 1 holds direct neighbours, ring d all within d hops.

    Empty when the centre is no entity.
    """
    known = entities.select("entity_id", "name")
    exists = entities.filter(F.col("entity_id") == center).limit(1).agg(F.count("*")).scalar()
    near = bounded_search(relations, center, max_depth).join(known, "entity_id")
    rings = near.select("entity_id", "name", "path", F.explode(F.sequence(F.col("depth"), F.lit(max_depth))).alias("ring"))
    return rings.filter(exists > 0).select("ring", "entity_id", "name")


def shortest_paths(entities: DataFrame, relations: DataFrame, center: str, max_depth: int = 2):
    """One shortest path to every vertex within ``max_depth`` hops."""
    near = bounded_search(relations, center, max_depth)
    return near.select("entity_id", F.col("depth").alias("path_length"), F.array_join("path", ">").alias("path"))


def direct_relations(relations: DataFrame, center: str) -> DataFrame:
    return relations.filter((F.col("source_entity") == center) | (F.col("target_entity") == center))


def clean_up(entities: DataFrame, relations: DataFrame, threshold: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Drop weak entities with their relations, then weak relations."""
    weak = entities.filter(F.col("confidence") < threshold).select("entity_id")
    kept = relations.filter(F.col("confidence") >= threshold)
    for end in ("source_entity", "target_entity"):
        kept = kept.join(weak.withColumnRenamed("entity_id", end), end, "left_anti")
    return entities.filter(F.col("confidence") >= threshold), kept


def timeline(appearances: DataFrame, entity_id: str) -> DataFrame:
    """Appearances of one entity by video and start, with duration and readable offsets."""
    from reelgraph.functions.clock import seconds_to_timestamp

    return (
        appearances.filter(F.col("entity_id") == entity_id)
        .select(
            "video_id", "start_time", "end_time", (F.col("end_time") - F.col("start_time")).alias("duration"),
            seconds_to_timestamp(F.col("start_time"), True).alias("start_stamp"),
            seconds_to_timestamp(F.col("end_time"), True).alias("end_stamp"),
        )
        .orderBy("video_id", "start_time", "end_time")
    )


def co_occurrence_pairs(appearances: DataFrame, entity_id: str, window: float = 30.0) -> DataFrame:
    """Overlaps of one entity's appearances with those of others in the same video.

    A pair counts when the starts or the ends lie within ``window`` and the overlap is not empty.  Both
    tests are band joins: times are cut into buckets of the window's width and the entity's rows look
    into their own bucket and the two beside it, first by start, then by end for pairs whose starts are
    apart.  Equal appearances are counted once with their number, so copies cost nothing.
    """
    width = max(float(window), 1e-3)
    keys = ["entity_id", "video_id", "start_time", "end_time"]
    own = appearances.filter(F.col("entity_id") == entity_id)
    mine = own.groupBy("video_id", F.col("start_time").alias("s"), F.col("end_time").alias("e")).agg(F.count("*").alias("k"))
    # Only the entity's videos are counted: what it never meets is dropped before the first shuffle by all four keys.
    met = appearances.filter(F.col("entity_id") != entity_id).join(own.select("video_id").distinct(), "video_id", "left_semi")
    others = met.groupBy(*keys).agg(F.count("*").alias("n"))

    def banded(column: str, own: str) -> DataFrame:
        left = mine.withColumn("_b", F.explode(F.array(*[F.floor(F.col(own) / width) + i for i in (-1, 0, 1)])))
        return others.withColumn("_b", F.floor(F.col(column) / width)).join(left, ["video_id", "_b"]).filter(
            F.abs(F.col(column) - F.col(own)) <= window
        )

    by_start = banded("start_time", "s")
    by_end = banded("end_time", "e").filter(F.abs(F.col("start_time") - F.col("s")) > window)
    pairs = by_start.unionByName(by_end)
    overlap = F.least("end_time", "e") - F.greatest("start_time", "s")
    gap = F.least(F.abs(F.col("start_time") - F.col("s")), F.abs(F.col("end_time") - F.col("e")))
    return (
        pairs.withColumn("overlap", overlap).withColumn("time_difference", gap).withColumn("copies", F.col("n") * F.col("k"))
        .filter(F.col("overlap") > 0)
        .select("entity_id", "video_id", "start_time", "end_time", "s", "e", "overlap", "time_difference", "copies")
    )


def co_occurrences(appearances: DataFrame, entity_id: str, window: float = 30.0) -> DataFrame:
    """Entities seen together with one entity, longest shared time first."""
    return (
        co_occurrence_pairs(appearances, entity_id, window)
        .groupBy("entity_id")
        .agg(
            F.sum("copies").alias("overlaps"), F.sum(F.col("overlap") * F.col("copies")).alias("total_overlap"),
            F.min("time_difference").alias("min_time_difference"),
        )
        .orderBy(F.desc("total_overlap"), "entity_id")
    )


def summary_metrics(entities: DataFrame, relations: DataFrame, appearances: DataFrame) -> DataFrame:
    """Mean confidences and the time span of all appearances, one metric per row."""
    from reelgraph.operators.stats import _metric_rows

    e = entities.agg(F.count("*").alias("entities"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_entity_confidence"))
    r = relations.agg(F.count("*").alias("relations"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_relation_confidence"))
    low = F.least(F.min("start_time"), F.min("end_time"))
    high = F.greatest(F.max("start_time"), F.max("end_time"))
    t = appearances.agg(low.alias("earliest"), high.alias("latest"), (high - low).alias("total_duration"))
    return _metric_rows(e).unionByName(_metric_rows(r)).unionByName(_metric_rows(t))


def top_entities(entities: DataFrame, entity_videos: DataFrame, k: int = 10) -> DataFrame:
    """The most confident entities with their video counts and shortened descriptions."""
    from reelgraph.functions.text import shorten

    best = entities.orderBy(F.desc("confidence"), "entity_id").limit(k)
    counts = entity_videos.join(F.broadcast(best.select("entity_id")), "entity_id", "left_semi").groupBy("entity_id").agg(
        F.countDistinct("video_id").alias("video_count")
    )  # the broadcast side has k rows
    return best.join(counts, "entity_id", "left").select(
        "entity_id", "name", "entity_type", "confidence", F.coalesce("video_count", F.lit(0)).alias("video_count"),
        shorten(F.col("description")).alias("description"),
    )


def top_relations(entities: DataFrame, relations: DataFrame, k: int = 10) -> DataFrame:
    """The most confident relations with endpoint names, ``Unknown`` where an endpoint is missing."""
    from reelgraph.functions.text import shorten

    best = relations.orderBy(F.desc("confidence"), "relation_id").limit(k)
    ends = best.select(F.inline(F.array(
        F.struct(F.col("source_entity").alias("entity_id")), F.struct(F.col("target_entity").alias("entity_id"))
    ))).distinct()  # at most 2k rows
    names = entities.join(F.broadcast(ends), "entity_id", "left_semi").select("entity_id", "name")
    source = names.select(F.col("entity_id").alias("source_entity"), F.col("name").alias("source"))
    target = names.select(F.col("entity_id").alias("target_entity"), F.col("name").alias("target"))
    return best.join(source, "source_entity", "left").join(target, "target_entity", "left").select(
        "relation_id", F.coalesce("source", F.lit("Unknown")).alias("source"), "relation_type",
        F.coalesce("target", F.lit("Unknown")).alias("target"), "confidence",
        shorten(F.col("description")).alias("description"),
    )
