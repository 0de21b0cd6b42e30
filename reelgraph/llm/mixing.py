"""Mixing sources to target weights by capped water-filling, and a seeded sample of whole and fractional repetitions.

A source's target is its weight's part of the total, at most ``max_epochs`` times its size.  Sources above that are clamped there and
what they leave is shared again by weight among the others, until none is above.  A document of a source with target / size = 2.3 is
taken twice, and once more if its source's seeded order reaches it before 0.3 of the source is used up.

The order within a source is that of a keyed hash of the document's id.  Its running sums go in two levels: sums by (source, slice of the
hash range), then rows in the one slice in which a source's fraction ends.  So a source that holds a third of all rows is never in one
task, and the taken size differs from the target by less than one document of the source (repeated rows of one id count as one).

Nulls and edges: a null text has size 0; documents without words are taken as often as the others of their source.  The null
source is a source of its own, after all others in the order.  An empty table gives an empty result; sources of size 0 get target 0.  Repeated rows with one id stand
together in the order and are taken alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelgraph.llm.common import WORD, staged

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
SLICES = 4_096


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], max_epochs: float) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    One row per source.  Each round clamps the sources whose share is above their cap; the total to be shared is the size of all.
    """
    # the place of a source in the order, without one task for all: first characters, then the sources that share them
    spread = sources.withColumn("part", F.substring(F.coalesce("source", F.lit("")), 1, 4))
    parts = spread.groupBy("part", F.col("source").isNull().alias("last")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("last", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", "last", before.alias("before"))
    inside = Window.partitionBy("part", "last").orderBy("source")
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    table = (
        spread.withColumn("last", F.col("source").isNull()).join(parts, ["part", "last"])
        .withColumn("place", F.col("before") + F.row_number().over(inside) - 1)
        .select(
            "source", "source_size", F.element_at(kinds, (F.col("place") % len(weights) + 1).cast("int")).alias("weight"),
            (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"), F.lit(False).alias("clamped"),
        )
    )
    table = staged(table)
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        free = F.when(~F.col("clamped"), F.col("weight"))
        row = table.agg(F.sum(F.when(F.col("clamped"), F.col("cap"))).alias("used"), F.sum(free).alias("weight")).first()
        if not row["weight"]:
            break
        level = (total - (row["used"] or 0.0)) / row["weight"]
        above = (F.col("weight") * level) > F.col("cap")
        if not table.where(~F.col("clamped") & above).limit(1).count():
            break
        table = table.withColumn("clamped", F.col("clamped") | above)
    target = F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("weight") * level)
    return table.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: str = SEED, size: str | None = None) -> DataFrame:
    """The rows of ``docs`` as a struct ``row``, with size, source_size, target and copies (how often the mix takes the row).

    ``size`` names the column that the weights share; by default it is the number of words of ``text``.
    """
    count = n_words("text") if size is None else F.coalesce(F.col(size).cast("long"), F.lit(0))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "source", count.alias("size"), key.alias("order"))
    # ids, sources and sizes only: the texts don't travel
    thin = staged(docs.select("doc_id", "source", count.alias("size"), key.alias("order"), F.substring(key, 1, 3).alias("slice")))
    slices = thin.groupBy("source", "slice").agg(F.sum("size").alias("n"))
    goal = targets(slices.groupBy("source").agg(F.sum("n").alias("source_size")), weights, max_epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.select("*", F.floor(rate).alias("whole"), ((rate - F.floor(rate)) * F.col("source_size")).alias("more"))
    # the slice in which a source's fraction ends, and there the last document whose taking comes closer to it
    run = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ahead = slices.withColumn("ahead", F.coalesce(F.sum("n").over(run), F.lit(0))).alias("s")
    ends = (
        ahead.join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")))
        .where("ahead < more and ahead + n >= more").select("s.source", "slice", "ahead", "more")
    )
    within = Window.partitionBy("t.source").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = (
        thin.alias("t").join(ends.alias("e"), F.col("t.source").eqNullSafe(F.col("e.source")) & (F.col("t.slice") == F.col("e.slice")))
        .withColumn("half", F.col("ahead") + F.sum("size").over(within) - F.col("size") / 2)
        .groupBy("t.source", "e.slice").agg(F.max(F.when(F.col("half") <= F.col("more"), F.col("order"))).alias("last"))
        .select("source", F.coalesce("last", "slice").alias("cut"))
    )
    goal = staged(
        goal.alias("g").join(cuts.alias("c"), F.col("g.source").eqNullSafe(F.col("c.source")), "left")
        .select("g.source", "source_size", "target", "whole", "cut")
    )
    again = F.coalesce(F.col("order") <= F.col("cut"), F.lit(False)).cast("long")
    return rows.alias("r").join(goal.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source"))).select(
        "row", "size", "source_size", "target", (F.col("whole") + again).alias("copies")
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """The mixed rows themselves, each as often as the mix takes it."""
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
