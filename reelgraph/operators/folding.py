"""Order-dependent aggregates that stay bounded for very large groups.

A group is cut into segments of its sequence number.  Each segment is reduced on its own and the
segment results are combined in a second, far smaller step, so no task holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def running_sum(rows: DataFrame, keys: list[str], seq: str, value: str, out: str, span: int = 4096) -> DataFrame:
    """Add ``out``: the sum of ``value`` over this and all earlier rows of the key, by ``seq``.

    ``seq`` is a non-negative integer, unique within its key.
    """
    cut = rows.withColumn("_seg", F.floor(F.col(seq) / span))
    totals = cut.groupBy(*keys, "_seg").agg(F.sum(value).alias("_t"))
    before = totals.select(
        *keys, "_seg",
        F.coalesce(
            F.sum("_t").over(Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    inside = F.sum(value).over(
        Window.partitionBy(*keys, "_seg").orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        cut.withColumn("_inside", inside).join(before, [*keys, "_seg"])
        .withColumn(out, F.col("_inside") + F.col("_before")).drop("_seg", "_inside", "_before")
    )


def fold_affine(
    rows: DataFrame, keys: list[str], seq: str, a: Column, b: Column, out: str, span: int = 1024,
    top: int | None = None,
) -> DataFrame:
    """Per key, run x <- a * x + b through the rows in ``seq`` order, from x = 0.

    Affine steps compose, so a segment of at most ``span`` rows becomes one step; levels repeat until
    one segment is left.  ``seq`` is a non-negative integer, unique within its key; ``top`` is its
    largest value, read from the rows when not given.
    """
    steps = rows.select(*keys, F.col(seq).cast("long").alias("_s"), a.cast("double").alias("_a"), b.cast("double").alias("_b"))
    if top is None:
        top = rows.agg(F.max(seq)).first()[0] or 0
    while True:
        level = steps.groupBy(*keys, F.floor(F.col("_s") / span).alias("_seg")).agg(
            F.array_sort(F.collect_list(F.struct("_s", "_a", "_b"))).alias("_steps")  # at most span entries
        )
        folded = F.aggregate(
            "_steps", F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")),
            lambda acc, x: F.struct((x["_a"] * acc["a"]).alias("a"), (x["_a"] * acc["b"] + x["_b"]).alias("b")),
        )
        steps = level.withColumn("_f", folded).select(
            *keys, F.col("_seg").alias("_s"), F.col("_f.a").alias("_a"), F.col("_f.b").alias("_b")
        )
        top //= span
        if top == 0:
            return steps.select(*keys, F.col("_b").alias(out))


def gap_to_next(rows: DataFrame, key: str, at: str, out: str, width: float) -> DataFrame:
    """Add ``out``: the time from each row to the key's next row, null for its last.

    Rows are windowed inside (key, time bucket); the last row of a bucket looks up the first time of
    the key's next non-empty bucket, found from one row per bucket.
    """
    cut = rows.withColumn("_bucket", F.floor(F.col(at) / width))
    firsts = cut.groupBy(key, "_bucket").agg(F.min(at).alias("_first"))
    following = firsts.select(
        key, "_bucket", F.lead("_first").over(Window.partitionBy(key).orderBy("_bucket")).alias("_next")
    )
    inside = F.lead(at).over(Window.partitionBy(key, "_bucket").orderBy(at))
    return (
        cut.withColumn("_lead", inside).join(following, [key, "_bucket"])
        .withColumn(out, F.coalesce("_lead", "_next") - F.col(at)).drop("_bucket", "_lead", "_next")
    )


def dense_index(rows: DataFrame, column: str, out: str) -> DataFrame:
    """The distinct values of ``column`` numbered from 0 in a fixed order, without a global sort.

    Values are numbered inside 4096 hash buckets; a bucket is shifted by the sizes of those before it.
    """
    values = rows.select(column).distinct().withColumn("_h", F.md5(F.col(column).cast("string")))
    values = values.withColumn("_b", F.substring("_h", 1, 3))
    sizes = values.groupBy("_b").agg(F.count("*").alias("_n"))  # at most 4096 rows
    before = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("_h", column))
    numbered = values.withColumn("_i", inside).join(F.broadcast(shifts), "_b")
    return numbered.select(column, (F.col("_shift") + F.col("_i") - 1).alias(out))
