"""Export and import of a whole library, and backups with a manifest."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from reelgraph.sources import store

SECTIONS = {
    "videos": ("videos", "chunks", "frames", "audio_segments"),
    "graphs": ("entities", "aliases", "entity_videos", "entity_chunks", "appearances", "relations", "relation_videos"),
    "vectors": ("vectors",),
}
KEYS = {"videos": "video_id", "vectors": "entry_id"}


def _schemas() -> dict:
    from reelgraph.schema import GRAPH_TABLES, METADATA_TABLES, VECTORS

    return {**METADATA_TABLES, **GRAPH_TABLES, "vectors": VECTORS}


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target, jvm


def write_text(spark: SparkSession, path: str, content: str) -> None:
    fs, target, _ = _files(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(content.encode("utf-8")))
    finally:
        out.close()


def exists(spark: SparkSession, path: str) -> bool:
    fs, target, _ = _files(spark, path)
    return fs.exists(target)


def names_in(spark: SparkSession, path: str) -> list[str]:
    fs, target, _ = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def remove(spark: SparkSession, table: str, column: str, value: str) -> None:
    """Delete one partition folder of a table."""
    jvm = spark._jvm
    escaped = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)
    fs, target, _ = _files(spark, f"{table}/{column}={escaped}")
    if fs.exists(target):
        fs.delete(target, True)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def swap(spark: SparkSession, staged: str, live: str) -> None:
    """Put a fully written folder in the place of another; the old one stays beside it."""
    fs, target, jvm = _files(spark, live)
    if fs.exists(target):
        fs.rename(target, jvm.org.apache.hadoop.fs.Path(f"{live}.before-{int(time.time() * 1000)}"))
    fs.rename(jvm.org.apache.hadoop.fs.Path(staged), target)


def export_library(tables: dict[str, DataFrame], path: str, sections=tuple(SECTIONS), compress: bool = True) -> None:
    """One folder of JSON lines per table, gzip-compressed unless told otherwise."""
    for section in sections:
        for name in SECTIONS[section]:
            if name in tables:
                writer = tables[name].write.mode("overwrite")
                (writer.option("compression", "gzip") if compress else writer).json(f"{path}/{name}")


def import_library(
    spark: SparkSession, path: str, current: dict[str, DataFrame], merge: bool = True, sections=None, existing_paths: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Tables after importing an export: merging keeps what exists, replacing takes the import.

    ``existing_paths`` lists the media files that are there; videos whose file is missing are skipped.
    """
    schemas = _schemas()
    out = dict(current)
    new_videos: DataFrame | None = None
    for section in sections or tuple(SECTIONS):
        for name in SECTIONS[section]:
            if not exists(spark, f"{path}/{name}"):
                continue
            rows = spark.read.schema(schemas[name]).json(f"{path}/{name}")
            if name == "videos" and existing_paths is not None:
                there = existing_paths.select(F.col("path").alias("video_path"))
                rows = rows.join(there, "video_path", "left_semi").select(*rows.columns)
            if section == "videos":
                if name == "videos":
                    have = current["videos"].select("video_id") if merge and "videos" in current else None
                    new_videos = rows if have is None else rows.join(have, "video_id", "left_anti")
                    rows = new_videos
                elif new_videos is not None:
                    rows = rows.join(new_videos.select("video_id"), "video_id", "left_semi")
                out[name] = current[name].unionByName(rows) if merge and name in current else rows
            elif not merge or name not in current:
                out[name] = rows
            elif section == "graphs":
                known = current["entities"].select("graph_id").distinct()
                out[name] = current[name].unionByName(rows.join(known, "graph_id", "left_anti"))
            else:
                out[name] = store.insert_absent(current[name], rows, KEYS[name])
    return out


def backup(tables: dict[str, DataFrame], folder: str, now: float | None = None) -> str:
    """A timestamped folder of parquet tables with a manifest of row counts; the manifest comes last,
    so a folder with one is complete."""
    spark = next(iter(tables.values())).sparkSession
    stamp = time.strftime("%Y%m%d_%H%M%S", time.gmtime(now or time.time()))
    target = f"{folder}/backup_{stamp}"
    rows = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{target}/{name}")
        rows[name] = spark.read.parquet(f"{target}/{name}").count()
    write_text(spark, f"{target}/manifest.json", json.dumps({"timestamp": stamp, "rows": rows}, indent=2))
    return target


def restore(spark: SparkSession, backup_path: str) -> dict[str, DataFrame]:
    """The tables of a complete backup; raises when the manifest is missing or counts differ."""
    if not exists(spark, f"{backup_path}/manifest.json"):
        raise FileNotFoundError(f"no manifest in {backup_path}")
    manifest = json.loads(read_text(spark, f"{backup_path}/manifest.json"))
    tables = {name: spark.read.parquet(f"{backup_path}/{name}") for name in manifest["rows"]}
    for name, expected in manifest["rows"].items():
        if tables[name].count() != expected:
            raise ValueError(f"backup table {name} is incomplete")
    return tables


def restore_library(spark: SparkSession, backup_path: str, live: dict[str, str], confirm: bool = False) -> bool:
    """Put a backup in the place of the live table folders.

    Does nothing without ``confirm``.  Every table is staged before any is swapped, and the replaced
    folders stay beside the new ones as a way back.
    """
    if not confirm:
        return False
    tables = restore(spark, backup_path)
    staged = {}
    for name, path in live.items():
        if name in tables:
            staged[name] = f"{path}.restore-{int(time.time() * 1000)}"
            tables[name].write.mode("overwrite").parquet(staged[name])
    for name, path in staged.items():
        swap(spark, path, live[name])
    return True
