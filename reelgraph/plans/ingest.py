"""Ingest: media files to the metadata tables and vectors, with an injected decoder.

1. Every file is probed; one that can't be opened becomes one row with ``success`` false.
2. A file is cut into parts of ``part_chunks`` chunks, which are dealt to all tasks, so a long file doesn't keep one task busy.  Where the
   row has the content, a share of parts travels with a copy of it, so there are no more shares than ``SHARE_BYTES`` in the content.
3. A generator decodes each share chunk by chunk: sampled frames and the chunk's sound.  It holds a bounded batch of chunks, which the models
   caption, transcribe and embed at once, so that pictures and sound never leave their task.
4. The outcome (a row per file, chunk and failure) is written once, then the tables are read off it.  Nothing is grouped by video but the
   counts, which combine map-side; chunks of failed files are taken out where they lie, as long as the failed ids fit a broadcast.

If any part of a file fails, the file is one failed row and none of its chunks, frames, segments or vectors remain.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate, chain
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from reelgraph.functions import ids, text, vectors
from reelgraph.models.inference import Model, answers, apply_model
from reelgraph.session import cut_lineage


class Media(Protocol):
    """An opened file."""

    fps: float
    total_frames: int
    resolution: str

    def frames(self, indexes: Sequence[int]) -> list[bytes]: ...

    def sound(self, start: float, end: float) -> bytes | None: ...


#: Opens a file by its path, or from its content where the row has one; raises if it can't.
Opener = Callable[[str, bytes | None], Media]


@dataclass(frozen=True)
class Models:
    caption: Model
    transcribe: Model
    embed_text: Model | None = None
    embed_image: Model | None = None


BATCH_BYTES, BATCH_CHUNKS = 16_000_000, 256  # of decoded chunks that a task holds
SHARE_BYTES = 1_000_000  # of a file's content for each further task that gets a copy of it
BROADCAST_IDS = 200_000  # of failed files

_FOUND = "fps double, total_frames bigint, resolution string, error string"
_FILE = ("video_path", "filename", "size_bytes", "fps", "total_frames", "resolution")


def _probe(opener: Opener, path: Column, content: Column, fits: Column) -> Column:
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for paths, contents, supported in batches:
            rows = []
            for name, data, known in zip(paths, contents, supported, strict=True):
                try:
                    if not known:
                        rows.append((None, None, None, "unsupported format"))
                        continue
                    media = opener(name, data)
                    if not (media.fps > 0 and media.total_frames > 0):
                        raise ValueError("no frames")
                    rows.append((float(media.fps), int(media.total_frames), media.resolution, None))
                except Exception as e:  # the failure is the row's outcome
                    rows.append((None, None, None, f"{type(e).__name__}: {e}"))
            found = pd.DataFrame(rows, columns=["fps", "total_frames", "resolution", "error"])
            found["total_frames"] = found["total_frames"].astype("Int64")
            yield found

    return F.pandas_udf(run, _FOUND)(path, content, fits)


def sampled(start: float, end: float, fps: float, total: int, per_chunk: int) -> list[int]:
    """Evenly spaced frame numbers of a chunk, or all of them where it has no more."""
    first, last = math.floor(start * fps), min(math.floor(end * fps), total)
    n = min(per_chunk, last - first)
    if last - first <= n:
        return list(range(first, last))
    return [math.floor(first + i * ((last - first) / n)) for i in range(n)]


def _vector_type(model: Model | None) -> str:
    return model.output.simpleString() if model else "array<float>"


def _outcome(models: Models) -> str:
    return (
        "video_id string, is_file boolean, video_path string, filename string, size_bytes bigint, fps double, total_frames bigint, "
        "resolution string, error string, chunk_index bigint, start_time double, end_time double, places array<bigint>, times array<double>, "
        f"captions array<string>, image_vectors array<{_vector_type(models.embed_image)}>, transcript string"
    )


def _decode(opener: Opener, models: Models, seconds: float, per_chunk: int, part_chunks: int):
    double = models.embed_image is not None and models.embed_image.output == T.ArrayType(T.DoubleType())
    vector = pa.list_(pa.float64() if double else pa.float32())

    def answered(held: list[tuple]) -> pa.RecordBatch:
        """The rows of the files, chunks and failures held, with the models' outputs in place of pictures and sound."""
        files, errors, spans, places, times, images, sounds = zip(*held, strict=True)
        flat = list(chain.from_iterable(images))
        seen = answers(models.embed_image, flat) if models.embed_image else [None] * len(flat)

        def listed(like, values, kind):
            """The values as lists as long as those of ``like``."""
            return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, like))], pa.int32()), pa.array(values, kind))

        kinds = (pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.string())
        columns = [pa.array(c, k) for c, k in zip(zip(*files, strict=True), kinds, strict=True)] + [pa.array(errors, pa.string())]
        columns += [pa.array(c, k) for c, k in zip(zip(*spans, strict=True), (pa.int64(), pa.float64(), pa.float64()), strict=True)]
        columns += [
            listed(places, list(chain.from_iterable(places)), pa.int64()), listed(times, list(chain.from_iterable(times)), pa.float64()),
            listed(images, answers(models.caption, flat), pa.string()), listed(images, seen, vector),
            pa.array(["" if s is not None and t is None else t for s, t in zip(sounds, answers(models.transcribe, sounds), strict=True)], pa.string()),
        ]
        names = ["video_id", "is_file", *_FILE, "error", "chunk_index", "start_time", "end_time", "places", "times", "captions", "image_vectors", "transcript"]
        return pa.RecordBatch.from_arrays(columns, names)

    def read(row: dict) -> Iterator[tuple[tuple, int]]:
        """What one share of a file gives, with its bytes."""
        none, part_of = (None, None, None), (row["video_id"], False, *[None] * len(_FILE))
        if row["share"] == 0:
            yield ((row["video_id"], True, *[row[c] for c in _FILE]), row["error"], none, (), (), (), None), 0
        if row["error"] is not None:
            return
        try:
            media = opener(row["video_path"], row["content"])
            duration = media.total_frames / media.fps
            for index in range(row["first"] * part_chunks, min(row["last"] * part_chunks, math.ceil(duration / seconds))):
                start, end = index * seconds, min((index + 1) * seconds, duration)
                places = sampled(start, end, media.fps, media.total_frames, per_chunk)
                images, sound = media.frames(places), media.sound(start, end)
                size = sum(map(len, images)) + len(sound or b"")
                yield (part_of, None, (index, start, end), places, [i / media.fps for i in places], images, sound), size
        except Exception as e:  # the failure is the file's outcome
            yield (part_of, f"{type(e).__name__}: {e}", none, (), (), (), None), 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                for item, size in read(row):
                    held.append(item)
                    total += size
                    if total > BATCH_BYTES or len(held) >= BATCH_CHUNKS:
                        yield answered(held)
                        held, total = [], 0
        if held:
            yield answered(held)

    return run


def ingest(
    files: DataFrame, opener: Opener, models: Models, now: float, seconds: float = 30.0, per_chunk: int = 5, part_chunks: int = 20,
    formats: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """The tables ``videos, chunks, frames, audio_segments, vectors`` of (path, size_bytes, modified, content) rows.

    ``content`` may be null where the opener reads the path itself.  With ``formats`` files of other suffixes fail.  Equal paths with equal
    size and time are one file.  Frames of which no picture could be captioned have an empty caption; sound without words confidence 0.
    """
    known = files.select(
        ids.video_id(F.col("path"), F.col("size_bytes"), F.col("modified")).alias("video_id"), F.col("path").alias("video_path"),
        F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("size_bytes").cast("bigint").alias("size_bytes"),
        F.col("content").cast("binary").alias("content"),
    ).dropDuplicates(["video_id"])
    fits = F.lower(F.regexp_extract("video_path", r"\.([A-Za-z0-9]+)$", 1)).isin(*formats) if formats is not None else F.lit(True)
    probed = known.withColumn("fits", F.coalesce(fits, F.lit(False))).withColumn("content", F.when(F.col("fits"), F.col("content")))
    probed = probed.withColumn("found", _probe(opener, F.col("video_path"), F.col("content"), F.col("fits"))).select(*known.columns, "found.*")

    whole = F.coalesce(F.ceil(F.col("total_frames") / F.col("fps") / (seconds * part_chunks)), F.lit(0).cast("bigint"))
    copies = F.ceil(F.octet_length("content") / F.lit(float(SHARE_BYTES)))
    dealt = (
        probed.withColumn("parts", whole)
        .withColumn("shares", F.greatest(F.least("parts", copies), F.lit(1).cast("bigint")))  # least passes over nulls: without content, every part
        .withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)))
        .select(
            "video_id", *_FILE, "content", "error", "share",
            F.expr("share * parts div shares").alias("first"), F.expr("(share + 1) * parts div shares").alias("last"),
        )
        .repartition("video_id", "share")
    )
    decoded = dealt.mapInArrow(_decode(opener, models, seconds, per_chunk, part_chunks), _outcome(models))
    is_chunk = F.col("chunk_index").isNotNull()
    made = decoded.withColumns({
        "chunk_id": F.when(is_chunk, ids.chunk_id(F.col("video_id"), F.col("chunk_index"))), "transcript": F.trim("transcript"),
    })
    described = text.unified_description(F.col("captions"), F.coalesce("transcript", F.lit("")))
    made = made.withColumn("unified_description", F.when(is_chunk, described))
    wanted = F.when(F.col("unified_description") != "", F.col("unified_description"))
    made = made.withColumn("text_vector", apply_model(models.embed_text, wanted) if models.embed_text else F.lit(None).cast("array<float>"))
    made = made.withColumn("chunk_vector", vectors.fuse_chunk_embedding(F.col("text_vector"), F.get("image_vectors", F.lit(0))).cast("array<float>"))
    outcome = cut_lineage(made.drop("text_vector"))

    broken = cut_lineage(outcome.where("not is_file and error is not null").groupBy("video_id").agg(F.min("error").alias("failure")))
    cut = outcome.where(is_chunk)
    good = _without(cut, broken.select("video_id"))
    counts = cut.groupBy("video_id").agg(F.count("*").cast("int").alias("chunks"), F.sum(F.size("places")).cast("int").alias("shots"))
    at, fine = F.lit(float(now)), F.col("error").isNull()
    files = (
        outcome.where("is_file").select("video_id", *_FILE, "error").join(broken, "video_id", "left").join(counts, "video_id", "left")
        .withColumn("error", F.coalesce("error", "failure"))
    )
    videos = files.select(
        "video_id", "video_path", "filename", F.when(fine, F.col("total_frames") / F.col("fps")).otherwise(F.lit(0.0)).alias("duration"),
        *[F.when(fine, F.col(c)).alias(c) for c in ("fps", "resolution", "size_bytes")],
        F.when(fine, F.coalesce("chunks", F.lit(0))).otherwise(F.lit(0)).alias("chunk_count"),
        F.when(fine, F.coalesce("shots", F.lit(0))).otherwise(F.lit(0)).alias("frame_count"),
        at.alias("created_at"), at.alias("updated_at"), fine.alias("success"), F.col("error").alias("error_message"),
    )
    rows = good.select("chunk_id", "video_id", F.posexplode(F.arrays_zip("places", "times", "captions", "image_vectors")).alias("frame_no", "f")).select(
        ids.frame_id(F.col("chunk_id"), F.col("frame_no")).alias("frame_id"), "chunk_id", "video_id", F.col("f.times").alias("timestamp"),
        F.col("f.places").cast("int").alias("frame_index"), F.coalesce("f.captions", F.lit("")).alias("caption"), F.lit(0.8).alias("confidence"),
        F.lit("").alias("image_path"), at.alias("created_at"), F.col("f.image_vectors").alias("vector"),
    )
    heard = good.where("transcript is not null").select(
        ids.segment_id(F.col("chunk_id")).alias("segment_id"), "chunk_id", "video_id", "start_time", "end_time", "transcript",
        F.when(F.col("transcript") != "", 0.9).otherwise(0.0).alias("confidence"), F.lit("").alias("audio_path"), at.alias("created_at"),
    )
    spoken = F.col("transcript").isNotNull()
    return {
        "videos": videos,
        "chunks": good.select(
            "chunk_id", "video_id", "start_time", "end_time", F.size("places").alias("frame_count"), "unified_description",
            spoken.alias("has_audio"), at.alias("created_at"),
        ),
        "frames": rows.drop("vector"),
        "audio_segments": heard,
        "vectors": _vector_rows(good, rows, at),
    }


def _without(chunks: DataFrame, broken: DataFrame) -> DataFrame:
    """The chunks of whole files.  Many failed ids shuffle the chunks, once for all tables."""
    if broken.count() <= BROADCAST_IDS:
        return chunks.join(F.broadcast(broken), "video_id", "left_anti")
    return cut_lineage(chunks.join(broken, "video_id", "left_anti"))


def _vector_rows(good: DataFrame, frames: DataFrame, at) -> DataFrame:
    """Vector rows of the chunks and frames that have one."""
    chunk = good.where("chunk_vector is not null").select(
        F.concat(F.lit("chunk_"), "chunk_id").alias("entry_id"), F.col("chunk_vector").alias("vector"),
        F.create_map(
            F.lit("start_time"), F.col("start_time").cast("string"), F.lit("end_time"), F.col("end_time").cast("string"),
            F.lit("description"), F.col("unified_description"),
        ).alias("metadata"),
        F.lit("chunk").alias("source_type"), F.col("chunk_id").alias("source_id"), "video_id", F.col("start_time").alias("timestamp"), at.alias("created_at"),
    )
    frame = frames.where("vector is not null").select(
        F.concat(F.lit("frame_"), "frame_id").alias("entry_id"), "vector",
        F.create_map(F.lit("chunk_id"), F.col("chunk_id"), F.lit("caption"), F.col("caption")).alias("metadata"),
        F.lit("frame").alias("source_type"), F.col("frame_id").alias("source_id"), "video_id", "timestamp", "created_at",
    )
    return chunk.unionByName(frame)


class TextReel:
    """An offline medium: a text whose words are the frames, one a second, and which sounds as it reads."""

    resolution = "text"
    fps = 1.0

    def __init__(self, path: str, content: bytes | None):
        self.words = (content or b"").split()
        self.total_frames = len(self.words)

    def frames(self, indexes: Sequence[int]) -> list[bytes]:
        return [self.words[i] for i in indexes]

    def sound(self, start: float, end: float) -> bytes | None:
        said = b" ".join(self.words[int(start) : int(end)])
        if b"token = " in said:
            raise ValueError("protected")
        return said
