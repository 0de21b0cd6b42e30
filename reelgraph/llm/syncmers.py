"""Document fingerprints of closed syncmers, in DataFrame functions only.

A text's units are its words, longer ones in parts of ``UNIT`` characters.  Of each run of ``K`` units the unit with the smallest
hash is looked for; the run is an anchor if that unit is its first or its last.  Whether a run is an anchor depends on the run alone, not
on what stands around it, so a change in one place leaves all anchors elsewhere.  The fingerprint is the anchors' hashes in the order of
the text, each once; the likeness of two fingerprints is the number of common anchors divided by the number of anchors of the
larger one.  A text with fewer than ``K`` units is its own only anchor, a text in which no run qualifies has the run of least hash, and only
a blank text has none.

``with_next`` adds to each document the text of the next one in the order of doc_id.  Texts are dealt once, by slices of the range of
ids; the first document of a slice also goes to the slice before it, so nothing needs all ids in one task.

Nulls and edges: a null text counts as empty.  Equal texts have equal fingerprints and likeness 1, also two blank ones; a blank and
another text have likeness 0.  A null doc_id comes first; rows with the same doc_id follow each other by their texts' hashes.  A single
document is followed by itself.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelgraph.llm.common import documents

K = 7
UNIT = 8
MAX_SLICES = 65_536


def unit_hashes(text: str) -> Column:
    return F.transform(F.regexp_extract_all(F.col(text), F.lit(rf"[^\x20\x09-\x0D]{{1,{UNIT}}}"), F.lit(0)), lambda unit: F.xxhash64(unit))


def anchors(text: str, hashes: str, k: int = K) -> Column:
    """Distinct anchors, as ints, from a column of ``unit_hashes``."""
    runs = f"sequence(0, size({hashes}) - {k})"
    named = f"i -> hash(slice({hashes}, i + 1, {k}))"
    closed = f"i -> array_min(slice({hashes}, i + 1, {k})) IN ({hashes}[i], {hashes}[i + {k - 1}])"
    chosen = f"""CASE WHEN exists({runs}, {closed}) THEN array_distinct(transform(filter({runs}, {closed}), {named}))
                 ELSE array(array_min(transform({runs}, {named}))) END"""
    return F.expr(f"CASE WHEN size({hashes}) >= {k} THEN {chosen} WHEN size({hashes}) > 0 THEN array(hash({text})) ELSE cast(array() AS array<int>) END")


def as_string(found: str) -> Column:
    return F.array_join(F.transform(found, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    return F.expr(f"""CASE WHEN {a} = {b} THEN 1D WHEN size({a}) = 0 OR size({b}) = 0 THEN 0D
                      ELSE size(array_intersect({a}, {b})) / greatest(size({a}), size({b})) END""")


def _slice_of(doc_id: str, bounds: list[int]) -> Column:
    """How many bounds are at most the id, by bisection; -1 for a null id."""
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    padded = F.array(*[F.lit(b) for b in bounds])
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, step: F.when((at + step <= len(bounds)) & (F.try_element_at(padded, at + step) <= F.col(doc_id)), at + step).otherwise(at),
    )
    return F.when(F.col(doc_id).isNull(), -1).otherwise(found if bounds else F.lit(0)).cast("int")


def with_next(docs: DataFrame) -> tuple[DataFrame, Window]:
    """(doc_id, text, next_text, guard) and the window that orders it; rows with ``guard`` are only there to be the next ones."""
    texts = documents(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    slices = min(MAX_SLICES, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    points = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    found = texts.agg(F.percentile_approx("doc_id", points, max(10_000, 10 * slices))).first()[0] or []
    rows = texts.select("doc_id", "text", _slice_of("doc_id", sorted(set(found))).alias("slice"))
    heads = rows.groupBy("slice").agg(F.min("doc_id").alias("doc_id"))  # ids of at most MAX_SLICES + 1 rows
    order = Window.orderBy("slice")
    around = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("slice", "doc_id", F.coalesce(F.lag("slice").over(order), F.max("slice").over(around)).alias("before"))
    guards = (
        rows.alias("r").join(F.broadcast(heads).alias("h"), (F.col("r.slice") == F.col("h.slice")) & F.col("r.doc_id").eqNullSafe(F.col("h.doc_id")))
        .groupBy("before").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        .select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("before").alias("slice"), F.lit(True).alias("guard"))
    )
    both = rows.withColumn("guard", F.lit(False)).unionByName(guards)
    run = Window.partitionBy("slice").orderBy("guard", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return both.withColumn("next_text", F.lead("text").over(run)), run


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    found = documents(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", unit_hashes("text"))
    return found.withColumn("a", anchors("text", "h", k)).select("doc_id", as_string("a").alias("fingerprint"))


def edit_report(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of each text, of the text with its second half replaced by the next one's beginning, and their likeness."""
    rows, run = with_next(docs)
    own = rows.withColumn("h", unit_hashes("text")).withColumn("a", anchors("text", "h", k)).drop("h")
    own = own.withColumn("next_a", F.lead("a").over(run)).where("not guard")
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = own.withColumn("edited", F.concat(
        F.substring("text", F.lit(1), F.char_length("text") - half), F.substring("next_text", F.lit(1), half)
    )).drop("next_text")
    edited = edited.withColumn("eh", unit_hashes("edited")).withColumn("ea", anchors("edited", "eh", k))
    return edited.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_string("a").alias("fingerprint"), as_string("ea").alias("edited_fingerprint"),
        likeness("a", "ea").alias("near_edited"), likeness("a", "next_a").alias("near_next"),
    )
