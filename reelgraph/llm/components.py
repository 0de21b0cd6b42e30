"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgraph.llm.common import staged


def _starred(edges: DataFrame, small: bool) -> DataFrame:
    """One star step on (u > v) edges: neighbours move to the smallest member of a node's neighbourhood."""
    sides = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = sides.join(least, "u")
    if small:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of ``links`` that is not the smallest of its component.

    The component is the smallest node reachable.  A hub's links are one row each, so no group is gathered in a task; every round is
    written to the shared folder.  The number of rounds grows with the logarithm of the number of nodes.
    """
    edges = staged(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    mark = _mark(edges)
    while True:
        edges = staged(_starred(_starred(edges, False), True))
        now = _mark(edges)
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = now


def _mark(edges: DataFrame) -> tuple:
    """Count and checksum of the links: equal before and after a round when nothing moves any more."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], row["s"]
