"""Shards in the order of a Hilbert curve through several metadata dimensions, in DataFrame functions only.

Each dimension is cut at its quantiles into 2**bits ranges of about equal numbers of rows, strings by the rank of whole values; the
curve's index of the resulting cell is computed with Skilling's transform, as a fold over the bits.  Rows are sorted by (index, text, id) over all tasks and the
order is cut into runs of equal numbers of rows, one per shard.  Neighbours on the curve are neighbours in every dimension, so the files of
a shard span a small range of each and readers can skip them by any of the dimensions.  Equal texts are placed where the one with the
smallest id belongs; they stand together, and at most one group is cut at the end of each run.

The rank of a row in the whole order is its place in its task plus the number of rows in the tasks before: no task sees all rows, and a
cell with a third of all rows is spread over many tasks because the sort key ends with the id.

Nulls and edges: a null text has no bytes, size 1 and crc32 0; null metadata comes before every value; null ids come first.  Repeated
rows each come back.  With fewer rows than shards the last shards are empty.  Columns other than the dimensions are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelgraph.llm.common import staged

BITS = 5
SHARDS = 16


def ordinal(column: str, kind: str) -> Column:
    """An order-keeping number for a dimension, of strings an order-keeping key.  Null comes before every value."""
    if kind == "string":
        return F.coalesce(F.concat(F.lit("v"), F.col(column)), F.lit("null"))
    if kind == "date":
        number = F.unix_date(column).cast("double")
    else:
        number = F.col(column).cast("double")
    return F.coalesce(number, F.lit(-1.7e308))


def hilbert_index(axes: Sequence[Column], bits: int) -> Column:
    """Index on the curve of a cell with coordinates below 2**bits; needs bits * len(axes) < 63."""
    n = len(axes)
    if bits * n > 62:
        raise ValueError("too many bits for one long")

    def pick(x: Column, i: Column) -> Column:
        return F.get(x, i)

    def put(x: Column, low: Column, at: Column, value: Column) -> Column:
        return F.transform(x, lambda v, j: F.when(j == at, value).when(j == 0, low).otherwise(v))

    def unwind(x: Column, step: Column) -> Column:
        # step counts (bit, axis) from the highest bit down
        i = step % n
        q = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(bits - 1) - F.floor(step / n)).cast("int"))
        first, own = pick(x, F.lit(0)), pick(x, i)
        swap = first.bitwiseXOR(own).bitwiseAND(q - 1)
        is_set = own.bitwiseAND(q) != 0
        low = F.when(is_set, first.bitwiseXOR(q - 1)).otherwise(first.bitwiseXOR(swap))
        value = F.when(i == 0, low).when(is_set, own).otherwise(own.bitwiseXOR(swap))
        return put(x, low, i, value)

    start = F.array(*[a.cast("long") for a in axes])
    turned = F.aggregate(F.sequence(F.lit(0), F.lit((bits - 1) * n - 1)), start, unwind) if bits > 1 else start
    # Gray code: each axis with all before it
    gray = F.aggregate(
        F.slice(turned, 2, n), F.slice(turned, 1, 1),
        lambda done, v: F.concat(done, F.array(F.element_at(done, -1).bitwiseXOR(v))),
    ) if n > 1 else turned
    last = F.element_at(gray, -1)
    parity = F.lit(0).cast("long")
    for b in range(1, bits):
        q = 1 << b
        parity = parity.bitwiseXOR(F.when(last.bitwiseAND(F.lit(q)) != 0, F.lit(q - 1)).otherwise(F.lit(0)))
    index = F.lit(0).cast("long")
    for b in reversed(range(bits)):
        for i in range(n):
            bit = F.shiftright(F.get(gray, F.lit(i)).bitwiseXOR(parity), b).bitwiseAND(F.lit(1))
            index = index * 2 + bit
    return index


def cuts(table: DataFrame, columns: Sequence[str], bits: int) -> list[list[float]]:
    """The inner quantiles of each column: 2**bits - 1 numbers each, whatever the table's size."""
    points = F.array(*[F.lit(i / (1 << bits)) for i in range(1, 1 << bits)])
    row = table.agg(*[F.percentile_approx(c, points, 10_000).alias(c) for c in columns]).first()
    return [sorted(set(row[c] or [])) for c in columns]


def _range_of(column: str, edges: Sequence[float]) -> Column:
    if not edges:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(c) for c in edges]), lambda c: c < F.col(column)))


def string_ranges(table: DataFrame, column: str, bits: int) -> DataFrame:
    """(value, range) of every distinct value: ranges of about equal numbers of rows in the order of whole values.

    A value's range follows from the number of rows before it: its running count in its task plus the rows of the tasks before.  A value
    with a third of all rows is one row here, after partial counts.
    """
    tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = table.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    dealt = staged(counted.repartitionByRange(tasks, "value").select("*", F.spark_partition_id().alias("task")))
    sums = dealt.groupBy("task").agg(F.sum("n").alias("rows"))  # one row per task
    so_far = Window.rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "task", F.coalesce(F.sum("rows").over(so_far.orderBy("task")), F.lit(0)).alias("start"),
        F.sum("rows").over(Window.partitionBy()).alias("total"),
    )
    within = F.coalesce(F.sum("n").over(so_far.partitionBy("task").orderBy("value")), F.lit(0))
    before = F.col("start") + F.col("within")
    return staged(
        dealt.withColumn("within", within).join(F.broadcast(starts), "task")
        .select("value", F.floor(before * (1 << bits) / F.col("total")).cast("int").alias("range"))
    )


def curve_order(docs: DataFrame, dimensions: Sequence[str] = ("lang", "source", "size"), bits: int = BITS) -> DataFrame:
    """(doc_id, size, text_crc32, text_key, curve, rank) of all rows; rank counts from 0 in the order of the curve.

    A dimension ``size`` is the text's size; others are columns of ``docs``.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kinds = dict(docs.dtypes)
    size = (F.octet_length(text) + 1).cast("long")
    names = [f"d{i}" for i in range(len(dimensions))]
    values = [size.cast("double") if d == "size" else ordinal(d, kinds[d]) for d in dimensions]
    thin = staged(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("text_key"), *[v.alias(n) for v, n in zip(values, names, strict=True)],
    ))
    words = [n for n, d in zip(names, dimensions, strict=True) if d != "size" and kinds[d] == "string"]
    numbers = [n for n in names if n not in words]
    edges = dict(zip(numbers, cuts(thin, numbers, bits), strict=True)) if numbers else {}
    ranged = thin
    for n in words:  # joined by whole values; the planner broadcasts a written table of few values by its size
        found = string_ranges(thin, n, bits)
        ranged = ranged.join(found.select(F.col("value").alias(n), F.col("range").alias(f"{n}_range")), n)
    axes = [F.col(f"{n}_range") if n in words else _range_of(n, edges[n]) for n in names]
    cells = ranged.select("doc_id", "text_key", F.array(*axes).alias("cell"))
    place = hilbert_index([F.get("cell", F.lit(i)) for i in range(len(names))], bits)
    curve = cells.groupBy("text_key").agg(F.min(F.struct("doc_id", "cell")).alias("m")).select("text_key", F.col("m.cell").alias("cell"))
    curve = curve.select("text_key", place.alias("curve"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ("curve", "text_key", "doc_id")
    ordered = staged(
        thin.select("doc_id", "size", "text_crc32", "text_key").join(curve, "text_key")
        .repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
        .select("*", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    )
    counts = ordered.groupBy("task").agg(F.count("*").alias("n"))  # one row per task
    before = F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("task", before.alias("start"))
    return ordered.join(F.broadcast(starts), "task").select(
        "doc_id", "size", "text_crc32", "text_key", "curve", (F.col("start") + F.col("at")).alias("rank")
    )


def shards(docs: DataFrame, n: int = SHARDS, dimensions: Sequence[str] = ("lang", "source", "size"), bits: int = BITS) -> DataFrame:
    """Cut the curve's order into ``n`` runs whose numbers of rows differ by one at most; adds shard and slot."""
    ordered = curve_order(docs, dimensions, bits)
    total = docs.count()
    base, more = divmod(total, n)
    rank, long_part = F.col("rank"), more * (base + 1)
    late = F.floor((rank - long_part) / max(base, 1)) + more
    shard = F.when(rank < long_part, F.floor(rank / (base + 1))).otherwise(late).cast("int")
    start = F.col("shard") * base + F.least("shard", F.lit(more))
    return ordered.withColumn("shard", shard).withColumn("slot", (rank - start).cast("long"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write whole rows as one sorted folder ``__shard=n`` per shard; repeated rows of one id go where the first of them goes."""
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), text.alias("key"))
    spots = placed.groupBy(F.col("doc_id").alias("spot_id"), "text_key").agg(F.min(F.struct("shard", "slot")).alias("to"))
    whole = rows.join(spots, F.col("id").eqNullSafe(F.col("spot_id")) & (F.col("key") == F.col("text_key")))
    whole = whole.select("row.*", F.col("to.shard").alias("__shard"), F.col("to.slot").alias("__slot"))
    whole.repartitionByRange("__shard", "__slot").sortWithinPartitions("__shard", "__slot").drop("__slot").write.partitionBy("__shard").parquet(path)
