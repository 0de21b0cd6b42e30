"""Packing of examples into training sequences: vector bin packing by the dot-product heuristic.

An example demands tokens, one segment and loss-bearing tokens; a sequence has a capacity for each.  A sequence is filled by taking,
again and again, the example that fits and whose demand has the largest dot product with what the sequence has left, each dimension
weighted by its share of the total demand.  Examples of equal demand are one kind, so a step looks at kinds, not examples.

Examples are dealt evenly and without a key into groups of about ``GROUP`` examples, so no source or copy makes a group large, and
each group is packed by one task.  A longer example is cut into full pieces and a rest before that; each document's pieces follow from
its own length alone, so their checksums are taken while its ids are at hand, and the ids never travel.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgraph.llm.common import documents, extended, slices, staged

GROUP = 16_384
MAX_TOKENS = 2_048
MAX_SEGMENTS = 256
REMEMBERED = 400_000


def dot_product_pack(demands: np.ndarray, capacity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of each example, and its place there; ``demands`` has a row per example and a column per limit."""
    if (demands > capacity).any():
        raise ValueError("an example exceeds the capacity of a sequence")
    kinds, kind, counts = np.unique(demands, axis=0, return_inverse=True, return_counts=True)
    order = np.argsort(kind.ravel(), kind="stable")  # examples of a kind, in their order
    nexts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    share = kinds / capacity
    weight = (share * counts[:, None]).sum(axis=0)
    weight = weight / max(weight.sum(), 1e-12)
    sequence, place = np.empty(len(demands), np.int64), np.empty(len(demands), np.int64)
    left, room, current, filled = len(demands), capacity.copy(), 0, 0
    while left:
        score = share @ (weight * room / capacity)
        score[(counts == 0) | (kinds > room).any(axis=1)] = -1
        best = int(score.argmax())
        if score[best] < 0:
            room, current, filled = capacity.copy(), current + 1, 0
            continue
        at = order[nexts[best]]
        sequence[at], place[at] = current, filled
        nexts[best] += 1
        counts[best] -= 1
        room = room - kinds[best]
        filled += 1
        left -= 1
    return sequence, place


def _pack(capacity: tuple[int, int, int]):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = [t for t in tables if t.num_rows]
        if not rows:
            return
        group = pa.Table.from_batches(rows)
        group = group.sort_by([(c, "ascending") for c in ("tokens", "loss", "key", "start", "mark")])
        tokens, loss = (group.column(c).to_numpy() for c in ("tokens", "loss"))
        sequence, place = dot_product_pack(np.stack([tokens, np.ones_like(tokens), loss], axis=1), np.array(capacity))
        order = np.lexsort((place, sequence))
        tokens = tokens[order]
        ends = np.cumsum(tokens)
        heads = np.concatenate(([True], np.diff(sequence[order]) != 0))
        begins = (ends - tokens)[np.flatnonzero(heads)][np.cumsum(heads) - 1]
        out = group.take(pa.array(order)).combine_chunks().to_batches()[0]
        yield extended(
            out, (), sequence_id=pa.array(sequence[order] + (TaskContext.get().partitionId() << 32)),
            segment=pa.array(place[order]), offset=pa.array(ends - tokens - begins),
        )

    return run


def pack(examples: DataFrame, max_tokens: int, max_segments: int, max_loss: int, group: int = GROUP) -> DataFrame:
    """Pack (key long, start long, mark long, tokens long, loss long) rows; adds sequence_id, segment and offset.

    ``start`` and ``mark`` tell the pieces of one key apart.  Every example must fit an empty sequence.  The groups are dealt round robin
    from a staged table, so a rerun of a lost task packs the same examples.
    """
    table = staged(examples.select("key", "start", "mark", "tokens", "loss"))
    tasks = max(1, -(-table.count() // group))
    return table.repartition(tasks).mapInArrow(
        _pack((max_tokens, max_segments, max_loss)),
        "key long, start long, mark long, tokens long, loss long, sequence_id long, segment long, offset long",
    )


def pack_turns(turns: DataFrame, tokens: str, loss: str, key: str, max_tokens: int, max_segments: int, max_loss: int) -> DataFrame:
    """Pack instruction examples given as rows with their own counts.

    Rows with null counts count as zero; rows above a limit are returned with a null sequence, as they fit none.
    """
    counted = turns.select(
        F.col(key).cast("long").alias("key"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("mark"),
        F.coalesce(F.col(tokens).cast("long"), F.lit(0)).alias("tokens"), F.coalesce(F.col(loss).cast("long"), F.lit(0)).alias("loss"),
    )
    fits = (F.col("tokens") <= max_tokens) & (F.col("loss") <= max_loss)
    none = F.lit(None).cast("long")
    rest = counted.where(~fits).select("*", none.alias("sequence_id"), none.alias("segment"), none.alias("offset"))
    return pack(counted.where(fits), max_tokens, max_segments, max_loss).unionByName(rest)


class Encoder(dict):
    """unit of text -> its ids as little-endian bytes, remembered up to ``REMEMBERED`` short units.

    A unit is a run of white space and the word after it.  The vocabulary's pattern never lets a match run from a word into the white
    space that follows, so ids of a text are those of its units in turn.
    """

    #: fixed values: white space as Unicode has it
    SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

    def __init__(self, path: str):
        super().__init__()
        import base64
        from pathlib import Path

        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
        self.encoding = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)}
        )
        self.units = re.compile(f"[{self.SPACE}]*[^{self.SPACE}]+|[{self.SPACE}]+")

    def __missing__(self, unit: str) -> bytes:
        found = self.encoding.encode(unit, allowed_special="all") if "<|" in unit else self.encoding.encode_ordinary(unit)
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(unit) <= 32 and len(self) < REMEMBERED:
            self[unit] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.units.findall(text))) if text else b""


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own copy, read once."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def _pieces(path: str, max_tokens: int, max_loss: int, end_id: int):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = encoder(path), int(end_id).to_bytes(4, "little")
        step = 4 * min(max_tokens, max_loss)
        for table in slices(tables):
            rows = []
            for k, text in enumerate(table.column("text").to_pylist()):
                ids = known.ids(text) + end
                for at in range(0, len(ids), step):
                    piece = ids[at : at + step]
                    rows.append((k, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4))
            k, start, length, crc, total = (pa.array(x, pa.int64()) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [table.column("doc_id").take(k), start, length, crc, total], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            )

    return run


def pack_documents(
    docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_TOKENS, end_id: int = 1
) -> DataFrame:
    """Tokenise whole documents, add ``end_id``, cut them to pieces that fit and pack the pieces.

    ``path`` names a rank file; every token of a document bears loss.  Returns (doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, segment, offset), one row per piece.  A null text counts as empty: one piece with only ``end_id``.  Repeated rows are
    packed each for itself, also with a null ``doc_id``.  Other columns are ignored.
    """
    made = documents(docs).mapInArrow(
        _pieces(path, max_tokens, max_loss, end_id), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    )
    # a piece's checksum and its document's tokens travel in one long: both are below 2**32 and 2**31
    mark = F.shiftleft("doc_tokens", 32).bitwiseOR(F.col("ids_crc32"))
    packed = pack(
        made.select(F.col("doc_id").alias("key"), "start", mark.alias("mark"), F.col("length").alias("tokens"), F.col("length").alias("loss")),
        max_tokens, max_segments, max_loss,
    )
    return packed.select(
        F.col("key").alias("doc_id"), "start", F.col("tokens").alias("length"), F.col("mark").bitwiseAND(F.lit(0xFFFFFFFF)).alias("ids_crc32"),
        F.shiftright("mark", 32).alias("doc_tokens"), "sequence_id", "segment", "offset",
    )
