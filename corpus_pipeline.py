"""From raw documents to packed training sequences: five stages over the table ``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelgraph.llm import jaccard_join, language, mixing, packing, substring_dedup
from reelgraph.llm.common import staged

#: Calibrated scores below this are no decision: the text is in none of the learned languages.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled rows teach; rejected are texts without a letter and undecided ones."""
    model = language.train(docs.where(~language.held_out()))
    found = language.identify(docs, model, *docs.columns)
    return found.where(F.col("lang_pred") != language.UNKNOWN).where(F.col("score") >= LEAST_SCORE).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the one with the smallest id; of rows that share id and text one.

    Where an id has several texts, each is judged by itself: all but the first get a number of their own, from the hash of id and text.
    """
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("__n")).where("__n > 1")
    if not ids.limit(1).count():
        return docs.join(_linked(docs, "doc_id"), "doc_id", "left_anti").select(*docs.columns)
    same, place = Window.partitionBy("doc_id", "text").orderBy(*docs.columns), Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    lone = docs.where("doc_id is not null").withColumn("__k", F.row_number().over(same)).where("__k = 1")
    own = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), "text"), 2) + F.lit(1 << 62)
    key = F.when(F.row_number().over(place) == 1, F.col("doc_id")).otherwise(own)
    keyed = staged(lone.withColumn("__key", key).drop("__k"))
    kept = keyed.join(_linked(keyed, "__key"), "__key", "left_anti").select(*docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))


def _linked(docs: DataFrame, key: str) -> DataFrame:
    """The keys of the documents that are linked to one with a smaller key."""
    found = jaccard_join.jaccard_components(docs.select(F.col(key).alias("doc_id"), "text"), count_links=False)
    return found.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; a text of which nothing is left goes."""
    made = substring_dedup.remove_repeats(docs, whole=True).where("n_removed = 0 OR n_removed < n_words")
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("kept_text")).otherwise(F.col("rest.n_chars"))
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": n_chars}
    return made.select(*[columns.get(c, F.col(f"rest.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mixing.repeated(mixing.mix(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language id", language_id),
    ("n-gram jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing", source_mix),
    ("packing", sequences),
]

#: SQL can't express the language model and the packing; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each to what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
