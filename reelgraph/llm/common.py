"""Helpers shared by the corpus operators: staged tables, word splitting, word hashes and bounded caches."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgraph.session import ensure_checkpoint_dir

#: Words are maximal runs of anything but space, tab, LF, VT, FF and CR; ``bytes.split()`` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs a reread of shared files, and what is computed once is never computed again.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(docs: DataFrame) -> DataFrame:
    """The two columns that operators on texts use, as (doc_id long, text string)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_STEP = 0xD1342543DE82EF95  # odd
_CHUNK = 1 << 16
_CODES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_CODES[_BLANK] = 0
_LOWER = _CODES.copy()
_LOWER[65:91] = _CODES[97:123]


def _powers(step: int, count: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(count, step, np.uint64))))


_UP, _DOWN = _powers(_STEP, _CHUNK), _powers(pow(_STEP, -1, 1 << 64), _CHUNK)


def _hashed(raw: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of the words of one piece: sums of byte codes times powers, read off one running sum."""
    up, down = (_UP, _DOWN) if len(raw) <= _CHUNK else (_powers(_STEP, len(raw)), _powers(pow(_STEP, -1, 1 << 64), len(raw)))
    blank = np.concatenate(([True], _BLANK[raw], [True]))
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(codes[raw] * up[: len(raw)], out=total[1:])
    start, end = edges[::2], edges[1::2]
    return mixed((total[end] - total[start]) * down[start])


def word_hashes(text: str | None, lower: bool = False) -> np.ndarray:
    """64-bit hashes of a text's words, in their order; ``lower`` takes A-Z as a-z.

    The whole text goes through numpy, in pieces that end between words, so memory is bounded but for single words of that length.
    """
    raw = np.frombuffer(text.encode(), np.uint8) if text else np.empty(0, np.uint8)
    codes, parts, at = _LOWER if lower else _CODES, [], 0
    while at < len(raw):
        end = min(at + _CHUNK, len(raw))
        while end < len(raw) and not _BLANK[raw[end]]:
            back = np.flatnonzero(_BLANK[raw[at:end]])
            if len(back):
                end = at + int(back[-1])
            else:  # one word fills the piece
                more = np.flatnonzero(_BLANK[raw[end : end + _CHUNK]])
                end = min(end + (int(more[0]) if len(more) else _CHUNK), len(raw))
        parts.append(_hashed(raw[at : end + 1], codes))
        at = end + 1
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, as polynomials in the words' hashes."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    h = words[:count].copy()
    for i in range(1, n):
        h *= _BASE
        h += words[i : i + count]
    return mixed(h)


def batches(frames: Iterable, column: str, chars: int = 4_000_000) -> Iterator:
    """Cut Arrow batches into parts of about ``chars`` characters of ``column``, so that long texts don't pile up."""
    for frame in frames:
        sizes = frame[column].str.len().fillna(0).to_numpy()
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(chars, sizes.sum() + chars, chars), side="left") + 1
        start = 0
        for end in [*cuts.tolist(), len(frame)]:
            end = min(end, len(frame))
            if end > start:
                yield frame.iloc[start:end]
                start = end


def slices(tables: Iterable[pa.RecordBatch], column: str = "text", size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The same for Arrow batches, by bytes.  Columns that a task only hands on stay as they are, nulls and large numbers included."""
    for table in tables:
        sizes = pc.fill_null(pc.cast(pc.binary_length(table.column(column)), pa.int64()), 0).to_numpy(zero_copy_only=False)
        groups = np.cumsum(sizes) // size
        cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield table.slice(a, b - a)


def extended(table: pa.RecordBatch, drop: tuple[str, ...], **columns: pa.Array) -> pa.RecordBatch:
    """``table`` without the columns ``drop`` and with new ones after the others."""
    names = [n for n in table.schema.names if n not in drop]
    return pa.RecordBatch.from_arrays([table.column(n) for n in names] + list(columns.values()), names=[*names, *columns])
