"""Identifier formulas."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reelgraph.functions.text import normalize_text


def short_hash(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 16)


def entity_id(name: Column, entity_type: Column) -> Column:
    return short_hash(F.concat_ws("_", entity_type, normalize_text(F.lower(name))))


def relation_id(source: Column, target: Column, relation_type: Column) -> Column:
    return short_hash(F.concat_ws("_", source, relation_type, target))


def video_id(path: Column, size: Column, modified: Column) -> Column:
    """Hash of path, size and modification time; of the path alone where the file is not readable."""
    return F.when(size.isNull() | modified.isNull(), short_hash(path)).otherwise(
        short_hash(F.concat_ws("_", path, size.cast("string"), modified.cast("string")))
    )


def _numbered(owner: Column, kind: str, index: Column) -> Column:
    """``format_string("%s_kind_%04d")``, whose formatter costs several times as much as the usual number of up to four digits needs."""
    four = F.lpad(index.cast("string"), 4, "0")
    number = F.when(index.between(0, 9999), four).otherwise(F.format_string("%04d", index))
    return F.concat(F.coalesce(owner.cast("string"), F.lit("null")), F.lit(f"_{kind}_"), number)


def chunk_id(video: Column, index: Column) -> Column:
    return _numbered(video, "chunk", index)


def frame_id(chunk: Column, index: Column) -> Column:
    return _numbered(chunk, "frame", index)


def keyframe_id(video: Column, kind: str, index: Column) -> Column:
    return _numbered(video, kind, index)


def segment_id(chunk: Column) -> Column:
    return F.concat(chunk, F.lit("_audio"))


def cache_key(*parts: Column) -> Column:
    return short_hash(F.concat_ws("|", *parts))


def content_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)
