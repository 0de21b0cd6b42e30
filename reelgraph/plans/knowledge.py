"""Building a knowledge graph: extract, merge within videos, merge across videos, link."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from reelgraph.operators import extraction, linking, resolution as rs
from reelgraph.operators.folding import dense_index
from reelgraph.session import cut_lineage


@dataclass(frozen=True)
class GraphTables:
    """A graph as narrow tables, one row per element of every set-valued attribute."""

    entities: DataFrame  # entity_id, name, entity_type, confidence
    descriptions: DataFrame  # entity_id, seq, description
    aliases: DataFrame  # entity_id, alias
    entity_videos: DataFrame  # entity_id, video_id
    entity_chunks: DataFrame  # entity_id, chunk_id
    appearances: DataFrame  # entity_id, video_id, start_time, end_time
    relations: DataFrame  # relation_id, source_entity, target_entity, relation_type, confidence
    relation_videos: DataFrame  # relation_id, video_id


def graph_from_responses(responses: DataFrame) -> GraphTables:
    """The graph of all videos whose chunks carry an extractor's ``response``.

    Mentions merge per video by (type, lower-case name); the per-video entities then merge by id, video
    after video, in a fixed order of the videos.
    """
    parsed = cut_lineage(extraction.parse_responses(responses))  # every table below reads it
    m = extraction.entity_mentions(parsed).withColumn("seq", F.concat_ws("#", "chunk_id", F.format_string("%06d", "place")))
    group = ["video_id", "entity_type", "name_key"]
    heads = cut_lineage(rs.merge_mentions(m, within=("video_id",)))
    turns = cut_lineage(dense_index(heads, "video_id", "seq"))
    key = heads.select(*group, "entity_id").join(turns, "video_id")

    def owned(children: DataFrame) -> DataFrame:
        return children.join(key, group)

    versions = heads.join(turns, "video_id").groupBy("entity_id", "seq").agg(
        F.min("name").alias("name"), F.min("entity_type").alias("entity_type"), F.avg("confidence").alias("confidence")
    )
    by_chunk = owned(rs.mention_children(m, "chunk_id", ("video_id",))).select("entity_id", "seq", "chunk_id").distinct()
    names = owned(rs.mention_aliases(m, ("video_id",))).select("entity_id", "alias")
    described = owned(rs.mention_descriptions(m.withColumnRenamed("seq", "at"), "at", ("video_id",)))
    times = m.select("video_id", "entity_type", rs.name_key().alias("name_key"), "start_time", "end_time")

    r = extraction.relation_mentions(parsed).withColumn("at", F.concat_ws("#", "chunk_id", F.format_string("%06d", "place")))
    per_video = r.groupBy("video_id", "relation_id").agg(
        *[F.min(c).alias(c) for c in ("source_entity", "target_entity", "relation_type")], F.avg("confidence").alias("confidence")
    ).join(turns, "video_id")
    return GraphTables(
        entities=rs.fold_entities(versions, by_chunk).drop("versions"),
        descriptions=described.select("entity_id", F.struct("seq", "at").alias("seq"), "description"),
        aliases=rs.fold_aliases(versions, names),
        entity_videos=key.select("entity_id", "video_id").distinct(),
        entity_chunks=by_chunk.select("entity_id", "chunk_id").distinct(),
        appearances=owned(times).select("entity_id", "video_id", "start_time", "end_time"),
        relations=rs.fold_relations(per_video).drop("versions"),
        relation_videos=r.select("relation_id", "video_id").distinct(),
    )


def description_text(descriptions: DataFrame) -> DataFrame:
    """Entity descriptions as token rows joined to one text per entity, each token once.

    Linking compares token sets, so repeats are dropped before anything is gathered: what one row holds
    is bounded by the vocabulary of the descriptions, not by the number of mentions.
    """
    from reelgraph.functions.text import token_set

    tokens = descriptions.select("entity_id", F.explode(token_set(F.col("description"))).alias("token")).distinct()
    return tokens.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_list("token")), " ").alias("description"))


def link_graph(graph: GraphTables, threshold: float = 0.8) -> tuple[GraphTables, DataFrame]:
    """Merge similar entities of different videos; returns the new graph and the merges made."""
    described = graph.entities.join(description_text(graph.descriptions), "entity_id", "left").fillna("", ["description"])
    pairs = linking.link_candidates(described, graph.aliases, graph.entity_videos, threshold)
    merges = linking.greedy_merges(pairs)
    targets = linking.final_targets(merges)
    confidence = linking.merged_confidence(graph.entities, graph.entity_chunks, merges)
    lost_names = graph.entities.join(targets.select("entity_id"), "entity_id", "left_semi").select("entity_id", F.col("name").alias("alias"))

    def moved(rows: DataFrame) -> DataFrame:
        return linking.redirect(rows, targets)

    linked = GraphTables(
        entities=graph.entities.drop("confidence").join(confidence, "entity_id"),
        descriptions=moved(graph.descriptions),
        aliases=moved(graph.aliases.select("entity_id", "alias").unionByName(lost_names)).distinct(),
        entity_videos=moved(graph.entity_videos).distinct(),
        entity_chunks=moved(graph.entity_chunks).distinct(),
        appearances=moved(graph.appearances),
        relations=linking.redirect_relations(graph.relations, targets),
        relation_videos=graph.relation_videos,
    )
    return linked, merges


def build_graph(responses: DataFrame, link: bool = True, threshold: float = 0.8) -> GraphTables:
    """Extract, merge and, if there is more than one video, link."""
    graph = graph_from_responses(responses)
    if link and responses.select("video_id").distinct().limit(2).count() > 1:
        graph, _ = link_graph(graph, threshold)
    return graph


def entity_texts(graph: GraphTables) -> DataFrame:
    """What gets embedded per entity: ``TYPE: name | description | up to three aliases``."""
    from pyspark.sql import Window

    w = Window.partitionBy("entity_id").orderBy("alias")
    few = graph.aliases.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= 3)
    three = few.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_list("alias")), " | ").alias("named"))
    first = graph.descriptions.groupBy("entity_id").agg(F.min_by("description", "seq").alias("description"))
    rows = graph.entities.join(first, "entity_id", "left").join(three, "entity_id", "left")
    return rows.select(
        "entity_id", F.concat("entity_type", F.lit(": "), F.concat_ws(" | ", "name", "description", "named")).alias("text")
    )
