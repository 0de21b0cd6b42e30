"""Graph files for other tools, written as ordered text lines by all tasks.

Each export is a table of (section, key, line).  Sorted by section and key the lines form one valid
document, so a graph of any size is written in parallel: the part files, read in name order, are the
document.  No task and no driver ever holds the whole graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FORMATS = ("cytoscape", "gephi", "graphml", "rows")


def _counted(entities: DataFrame, entity_videos: DataFrame) -> DataFrame:
    n = entity_videos.groupBy("entity_id").agg(F.countDistinct("video_id").alias("video_count"))
    return entities.join(n, "entity_id", "left").withColumn("video_count", F.coalesce("video_count", F.lit(0)))


def _fixed(entities: DataFrame, lines: list[tuple[int, str]]) -> DataFrame:
    spark = entities.sparkSession
    return spark.createDataFrame([(s, "", t) for s, t in lines], "section int, key string, line string")


def _escape(value: Column) -> Column:
    out = F.coalesce(value.cast("string"), F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def cytoscape_elements(entities: DataFrame, entity_videos: DataFrame, relations: DataFrame) -> DataFrame:
    """One Cytoscape element per row: ``section`` 1 holds nodes, 3 edges."""
    nodes = _counted(entities, entity_videos).select(
        F.lit(1).alias("section"), F.col("entity_id").alias("key"),
        F.to_json(F.struct(F.struct(
            F.col("entity_id").alias("id"), F.col("name").alias("label"), F.col("entity_type").alias("type"), "description",
            "confidence", "video_count",
        ).alias("data"))).alias("line"),
    )
    edges = relations.select(
        F.lit(3).alias("section"), F.col("relation_id").alias("key"),
        F.to_json(F.struct(F.struct(
            F.col("relation_id").alias("id"), F.col("source_entity").alias("source"), F.col("target_entity").alias("target"),
            F.col("relation_type").alias("label"), "description", "confidence",
        ).alias("data"))).alias("line"),
    )
    return nodes.unionByName(edges)


def cytoscape_lines(entities: DataFrame, entity_videos: DataFrame, relations: DataFrame) -> DataFrame:
    elements = cytoscape_elements(entities, entity_videos, relations)
    first_node = entities.agg(F.min("entity_id")).scalar()
    first_edge = relations.agg(F.min("relation_id")).scalar()
    opens = F.when(F.col("section") == 1, F.col("key") == first_node).otherwise(F.col("key") == first_edge)
    body = elements.withColumn("line", F.concat(F.when(opens, F.lit("")).otherwise(F.lit(",")), "line"))
    return body.unionByName(_fixed(entities, [(0, '{"nodes":['), (2, '],"edges":['), (4, "]}")]))


def gephi_lines(entities: DataFrame, entity_videos: DataFrame, relations: DataFrame) -> DataFrame:
    """GEXF 1.2 with type, description and confidence as node attributes."""
    def attribute(number: int, value: str) -> Column:
        return F.concat(F.lit(f'<attvalue for="{number}" value="'), _escape(F.col(value)), F.lit('"/>'))

    nodes = entities.select(
        F.lit(1).alias("section"), F.col("entity_id").alias("key"),
        F.concat(
            F.lit('<node id="'), _escape(F.col("entity_id")), F.lit('" label="'), _escape(F.col("name")),
            F.lit('"><attvalues>'), attribute(0, "entity_type"), attribute(1, "description"), attribute(2, "confidence"),
            F.lit("</attvalues></node>"),
        ).alias("line"),
    )
    edges = relations.select(
        F.lit(3).alias("section"), F.col("relation_id").alias("key"),
        F.concat(
            F.lit('<edge id="'), _escape(F.col("relation_id")), F.lit('" source="'), _escape(F.col("source_entity")),
            F.lit('" target="'), _escape(F.col("target_entity")), F.lit('" label="'), _escape(F.col("relation_type")), F.lit('"/>'),
        ).alias("line"),
    )
    head = (
        '<?xml version="1.0" encoding="utf-8"?><gexf version="1.2"><graph mode="static" defaultedgetype="directed">'
        '<attributes class="node"><attribute id="0" title="type" type="string"/>'
        '<attribute id="1" title="description" type="string"/><attribute id="2" title="confidence" type="float"/>'
        "</attributes><nodes>"
    )
    return nodes.unionByName(edges).unionByName(
        _fixed(entities, [(0, head), (2, "</nodes><edges>"), (4, "</edges></graph></gexf>")])
    )


def graphml_lines(entities: DataFrame, entity_videos: DataFrame, relations: DataFrame) -> DataFrame:
    def data(key: str, value: str) -> Column:
        return F.concat(F.lit(f'<data key="{key}">'), _escape(F.col(value)), F.lit("</data>"))

    nodes = entities.select(
        F.lit(1).alias("section"), F.col("entity_id").alias("key"),
        F.concat(
            F.lit('<node id="'), _escape(F.col("entity_id")), F.lit('">'), data("name", "name"), data("type", "entity_type"),
            data("description", "description"), data("confidence", "confidence"), F.lit("</node>"),
        ).alias("line"),
    )
    edges = relations.select(
        F.lit(3).alias("section"), F.col("relation_id").alias("key"),
        F.concat(
            F.lit('<edge id="'), _escape(F.col("relation_id")), F.lit('" source="'), _escape(F.col("source_entity")),
            F.lit('" target="'), _escape(F.col("target_entity")), F.lit('">'), data("label", "relation_type"),
            data("weight", "confidence"), F.lit("</edge>"),
        ).alias("line"),
    )
    keys = "".join(
        f'<key id="{k}" for="{who}" attr.name="{k}" attr.type="{kind}"/>'
        for k, who, kind in (
            ("name", "node", "string"), ("type", "node", "string"), ("description", "node", "string"),
            ("confidence", "node", "double"), ("label", "edge", "string"), ("weight", "edge", "double"),
        )
    )
    head = (
        '<?xml version="1.0" encoding="utf-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">'
        f'{keys}<graph edgedefault="directed">'
    )
    return nodes.unionByName(edges).unionByName(_fixed(entities, [(0, head), (4, "</graph></graphml>")]))


def export_graph(
    entities: DataFrame, entity_videos: DataFrame, relations: DataFrame, path: str, fmt: str = "cytoscape", parts: int | None = None
) -> str | None:
    """Write the graph to a folder; an unknown format writes nothing and gives None."""
    makers = {"cytoscape": cytoscape_lines, "gephi": gephi_lines, "graphml": graphml_lines}
    if fmt == "rows":
        entities.write.mode("overwrite").parquet(f"{path}/entities")
        relations.write.mode("overwrite").parquet(f"{path}/relations")
        return path
    if fmt not in makers:
        return None
    lines = makers[fmt](entities, entity_videos, relations)
    order = ["section", "key"]
    ranged = lines.repartitionByRange(parts, *order) if parts else lines.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)
    return path
