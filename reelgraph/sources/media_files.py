"""Media files as a table.  Only names and file attributes are read, never the content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reelgraph.config import ProcessingSettings
from reelgraph.functions import ids


def media_files(spark: SparkSession, folder: str, settings: ProcessingSettings = ProcessingSettings()) -> DataFrame:
    """Every file below ``folder`` with its id, size and whether its format is supported."""
    rows = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        .select("path", "length", "modificationTime")
    )
    modified = F.unix_micros("modificationTime") / 1e6
    return rows.select(
        ids.video_id(F.col("path"), F.col("length"), modified).alias("video_id"), "path",
        F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size_bytes"),
        supported("path", settings.supported_formats).alias("supported"),
    )


def supported(path: str, formats: tuple[str, ...]) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).isin(*formats)


def with_duration(probed: DataFrame) -> DataFrame:
    """Add ``duration`` from ``total_frames`` and ``fps``; 0 where the rate is not positive."""
    return probed.withColumn("duration", F.when(F.col("fps") > 0, F.col("total_frames") / F.col("fps")).otherwise(F.lit(0.0)))


def failed_video(path: Column, message: Column) -> list[Column]:
    """Columns of the row that stands for a video that could not be processed."""
    return [
        ids.short_hash(path).alias("video_id"), path.alias("video_path"), F.lit(0.0).alias("duration"),
        F.lit(False).alias("success"), message.alias("error_message"),
    ]
