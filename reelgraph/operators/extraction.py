"""Entities and relations from model responses, parsed inside the row that holds the response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reelgraph.functions import ids
from reelgraph.functions.hof import bind
from reelgraph.schema import ENTITY_TYPES, RELATION_TYPES

RESPONSE = (
    "entities array<struct<name:string,type:string,description:string,confidence:string>>, "
    "relations array<struct<source:string,target:string,type:string,description:string,confidence:string>>"
)


def chunk_text(captions: Column, transcript: Column, summary: Column) -> Column:
    """What a chunk says, as given to the extractor: the non-empty parts joined by a double pipe."""
    parts = F.concat(captions, F.array(transcript, summary))
    return F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), " || ")


def strip_fence(response: Column) -> Column:
    body = F.trim(response)
    body = F.when(body.startswith("```json"), F.substr(body, F.lit(8))).otherwise(body)
    return F.when(body.endswith("```"), F.substr(body, F.lit(1), F.length(body) - 3)).otherwise(body)


def _number(value: Column, default: float) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(default))


def parse_responses(responses: DataFrame, default_confidence: float = 0.7) -> DataFrame:
    """Parse ``response`` of each chunk into ``entities`` and ``relations`` arrays.

    A broken response gives empty arrays.  Entities without a name or of an unknown type are dropped, a
    missing type is OBJECT.  Relation ends are names of entities of the same response, the last entity
    of a name counting; relations with an unresolved end or an unknown type are dropped, a missing type
    is ASSOCIATED_WITH.
    """
    def entities_of(raw: Column) -> Column:
        shaped = F.transform(
            raw["entities"],
            lambda e: F.struct(
                F.trim(e["name"]).alias("name"), F.upper(F.coalesce(e["type"], F.lit("OBJECT"))).alias("entity_type"),
                F.coalesce(e["description"], F.lit("")).alias("description"),
                _number(e["confidence"], default_confidence).alias("confidence"),
            ),
        )
        kept = F.filter(shaped, lambda e: (F.coalesce(e["name"], F.lit("")) != "") & e["entity_type"].isin(*ENTITY_TYPES))
        return F.transform(
            kept,
            lambda e: F.struct(
                ids.entity_id(e["name"], e["entity_type"]).alias("entity_id"), e["name"].alias("name"),
                e["entity_type"].alias("entity_type"), e["description"].alias("description"), e["confidence"].alias("confidence"),
            ),
        )

    def relations_of(raw: Column, entities: Column) -> Column:
        def end(name: Column) -> Column:
            return F.try_element_at(F.filter(entities, lambda e: e["name"] == F.trim(name)), F.lit(-1))["entity_id"]

        shaped = F.transform(
            raw["relations"],
            lambda r: F.struct(
                end(r["source"]).alias("source_entity"), end(r["target"]).alias("target_entity"),
                F.upper(F.coalesce(r["type"], F.lit("ASSOCIATED_WITH"))).alias("relation_type"),
                F.coalesce(r["description"], F.lit("")).alias("description"),
                _number(r["confidence"], default_confidence).alias("confidence"),
            ),
        )
        return F.filter(
            shaped,
            lambda r: r["source_entity"].isNotNull() & r["target_entity"].isNotNull() & r["relation_type"].isin(*RELATION_TYPES),
        )

    no_entities = F.array().cast(
        "array<struct<entity_id:string,name:string,entity_type:string,description:string,confidence:double>>"
    )
    no_relations = F.array().cast(
        "array<struct<source_entity:string,target_entity:string,relation_type:string,description:string,confidence:double>>"
    )
    # Bound step by step, so that the JSON and the entity ids are worked out once per response.
    parsed = bind(
        F.from_json(strip_fence(F.col("response")), RESPONSE),
        lambda raw: bind(
            F.coalesce(entities_of(raw), no_entities),
            lambda e: F.struct(e.alias("entities"), F.coalesce(relations_of(raw, e), no_relations).alias("relations")),
        ),
    )
    return responses.withColumn("_p", parsed).select(
        *[c for c in responses.columns if c != "response"], F.col("_p.entities").alias("entities"), F.col("_p.relations").alias("relations")
    )


def entity_mentions(parsed: DataFrame) -> DataFrame:
    """One row per extracted entity, with its chunk and the time it covers."""
    return parsed.select(
        "chunk_id", "video_id", "start_time", "end_time", F.posexplode("entities").alias("place", "e")
    ).select("chunk_id", "video_id", "start_time", "end_time", "place", "e.*")


def relation_mentions(parsed: DataFrame) -> DataFrame:
    """One row per extracted relation, timed by its chunk."""
    rows = parsed.select(
        "chunk_id", "video_id", "start_time", "end_time", F.posexplode("relations").alias("place", "r")
    ).select("chunk_id", "video_id", "start_time", "end_time", "place", "r.*")
    return rows.withColumn(
        "relation_id", ids.relation_id(F.col("source_entity"), F.col("target_entity"), F.col("relation_type"))
    )
