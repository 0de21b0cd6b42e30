"""Injected models behind Arrow batches.

A model is a loader (run once per Python worker, on first use) and a batch function.  Where a batch
fails its rows are retried one by one, and a row that fails alone becomes null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType())


@dataclass(frozen=True)
class Model:
    """``infer(loaded, values)`` returns one output per value."""

    name: str
    load: Callable[[], object]
    infer: Callable[[object, Sequence], Sequence]
    output: T.DataType
    memory_mb: float = 0.0
    batch: int = 64
    key: str = field(default_factory=lambda: uuid4().hex)  # travels to the workers; tells models of one name apart


_LOADED: dict[str, tuple[str, object]] = {}  # the last one of each name


def _loaded(model: Model):
    if model.name not in _LOADED or _LOADED[model.name][0] != model.key:
        _LOADED[model.name] = (model.key, model.load())
    return _LOADED[model.name][1]


def _call(model: Model, values: list) -> list:
    engine = _loaded(model)
    out: list = []
    for at in range(0, len(values), model.batch):
        part = values[at : at + model.batch]
        try:
            out.extend(model.infer(engine, part))
        except Exception:
            for v in part:
                try:
                    out.extend(model.infer(engine, [v]))
                except Exception:
                    out.append(None)
    return out


def answers(model: Model, values: Sequence) -> list:
    """The model's output per value; null for null."""
    some = [v for v in values if v is not None]
    out = _call(model, some)
    if len(out) != len(some):
        raise ValueError(f"{model.name}: {len(out)} outputs for {len(some)} values")
    if len(some) == len(values):
        return out
    given = iter(out)
    return [None if v is None else next(given) for v in values]


def apply_model(model: Model, column: Column) -> Column:
    """The model's output for a column; null in, null out."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            given = list(values)
            out: list = [None] * len(given)
            some = [i for i, v in enumerate(given) if v is not None]
            for i, result in zip(some, _call(model, [given[i] for i in some])):
                out[i] = result
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(run, model.output)(column)


def apply_model_to_each(model: Model, column: Column) -> Column:
    """The model's outputs for the elements of an array column, in their order; a batch may span rows."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            out = answers(model, [v for row in values if row is not None for v in row])
            rows, at = [], 0
            for row in values:
                rows.append(None if row is None else out[at : at + len(row)])
                at += 0 if row is None else len(row)
            yield pd.Series(rows, dtype=object)

    return F.pandas_udf(run, T.ArrayType(model.output))(column)


def hashing_embedder(size: int = 64) -> Model:
    """Offline text embedding: signed hashed words, L2-normalised.  Equal texts give equal vectors."""

    def infer(_, texts):
        import numpy as np
        import xxhash

        out = []
        for t in texts:
            v = np.zeros(size, dtype="f8")
            for word in t.lower().split():
                h = xxhash.xxh64_intdigest(word)
                v[h % size] += 1.0 if (h >> 32) & 1 else -1.0
            n = np.sqrt(v @ v)
            out.append((v / n if n else v).astype("f4").tolist())
        return out

    return Model(f"hashing-{size}", lambda: None, infer, VECTOR)


def fixed_text(name: str, make: Callable[[object], str]) -> Model:
    """An offline text model: captioning, transcription or completion by a plain function."""
    return Model(name, lambda: None, lambda _, values: [make(v) for v in values], T.StringType())


def caption_frames(frames: DataFrame, model: Model, image: str = "image", confidence: float = 0.8) -> DataFrame:
    """Captions for frames; failures become empty texts."""
    return frames.withColumn("caption", F.coalesce(apply_model(model, F.col(image)), F.lit(""))).withColumn(
        "confidence", F.lit(confidence)
    )


def transcribe(segments: DataFrame, model: Model, audio: str = "audio") -> DataFrame:
    """Transcripts, trimmed; confidence 0.9 with text and 0 without.  Segments without audio drop out."""
    said = F.trim(F.coalesce(apply_model(model, F.col(audio)), F.lit("")))
    return segments.filter(F.col(audio).isNotNull()).withColumn("transcript", said).withColumn(
        "confidence", F.when(F.col("transcript") != "", F.lit(0.9)).otherwise(F.lit(0.0))
    )


def embed_missing(rows: DataFrame, model: Model, text: str = "text", out: str = "embedding") -> DataFrame:
    """Fill ``out`` where it is null."""
    return rows.withColumn(out, F.coalesce(F.col(out), apply_model(model, F.col(text))))


def respond(chunks: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Extractor responses per chunk; a chunk without text gets an empty response, not a call."""
    asked = F.when(F.coalesce(F.col(text), F.lit("")) != "", F.col(text))
    return chunks.withColumn("response", F.coalesce(apply_model(model, asked), F.lit("{}")))


def model_status(calls: DataFrame) -> DataFrame:
    """Calls, errors and time per model, from a call log ``model, success, seconds, memory_mb``."""
    return calls.groupBy("model").agg(
        F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("errors"),
        F.avg("seconds").alias("mean_seconds"), F.max("memory_mb").alias("memory_mb"),
        (F.count_if("success") > 0).alias("healthy"),
    )


def device_for(required_mb: float, devices: Sequence[tuple[str, float]], headroom: float = 1.2, wanted: str = "auto") -> str:
    """The first device with room for the model and its headroom, else the CPU.

    On a cluster, GPU placement is a Spark resource profile; this picks within one executor.
    """
    if wanted != "auto":
        return wanted
    return next((name for name, free in devices if free >= required_mb * headroom), "cpu")
