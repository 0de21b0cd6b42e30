"""A store of model answers by content: what was asked before is looked up, and only the rest reaches the model.

An answer's key is the hash of (model name, item id, content, prompt), so a changed content or prompt is a new question and another
model has answers of its own.  Answers are Parquet rows in ``path``; an append adds files and never rewrites any.  Two runs that ask the
same at once both append; readers take one row per key, the least answer, so they agree.

Nulls and edges: a null item, content or prompt is a value of its own, unlike the empty text.  A question whose model call fails has a null
answer; nulls are not stored, so the next run asks again.  Repeated requests come back as often as they were made, asked once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reelgraph.models.inference import Model, apply_model
from reelgraph.session import cut_lineage
from reelgraph.sources import exchange

ANSWERS = "key string, model string, answer string, answered_at double"


def answer_key(model: str, item: Column, content: Column, prompt: Column) -> Column:
    """Hash of a question.  As JSON with nulls kept, so that no two questions share one text."""
    asked = F.struct(F.lit(model).alias("m"), item.cast("string").alias("i"), content.cast("string").alias("c"), prompt.cast("string").alias("p"))
    return F.sha2(F.to_json(asked, {"ignoreNullFields": "false"}), 256)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """(key, model, answer, answered_at), one row per key."""
    if not exchange.exists(spark, path):
        return spark.createDataFrame([], ANSWERS)
    rows = spark.read.schema(ANSWERS).parquet(path)
    first = F.min(F.struct("answer", "answered_at", "model")).alias("r")
    return rows.groupBy("key").agg(first).select("key", "r.model", "r.answer", "r.answered_at")


def ask(
    requests: DataFrame, path: str, model: Model, now: float, item: str = "frame_id", content: str = "content", prompt: str = "prompt",
) -> DataFrame:
    """``requests`` with ``answer`` and ``reused``; new answers are appended to the store.

    Of the new questions each is asked once, and only their texts travel to the model; of all others the keys travel.  The model's rows are
    written before they are joined, so a rerun of a lost task never asks the model again for rows that are stored.
    """
    spark = requests.sparkSession
    keyed = requests.withColumn("__key", answer_key(model.name, F.col(item), F.col(content), F.col(prompt)))
    # A snapshot: the append below must not make new answers look reused.
    known = cut_lineage(stored(spark, path).join(keyed.select(F.col("__key").alias("key")).distinct(), "key", "left_semi").select("key", "answer"))
    missing = keyed.join(known.select(F.col("key").alias("__key")), "__key", "left_anti").dropDuplicates(["__key"])
    question = F.concat_ws("\n\n", F.col(prompt).cast("string"), F.col(content).cast("string"))
    new = cut_lineage(missing.select(F.col("__key").alias("key"), apply_model(model, question).alias("answer")))
    rows = new.where("answer IS NOT NULL").select(
        "key", F.lit(model.name).alias("model"), "answer", F.lit(float(now)).alias("answered_at")
    )
    rows.write.mode("append").parquet(path)
    both = known.withColumn("__reused", F.lit(True)).unionByName(new.withColumn("__reused", F.lit(False)))
    joined = keyed.join(both.withColumnsRenamed({"key": "__key", "answer": "__answer"}), "__key")
    return joined.select(
        *[F.col(f"`{c}`") for c in requests.columns], F.col("__answer").alias("answer"), F.col("__reused").alias("reused")
    )
