"""Removal of word passages that already stand in an earlier document, with prefix-partitioned suffix trees.

The suffixes of all documents are far too many to be moved.  Each window of ``window`` words therefore hands its suffix to an
anchor inside it (the leftmost smallest hash among its runs of ``prefix`` words), which equal windows choose alike:

1. One pass over the texts finds the anchors, about one in twenty words.  A prefix of ``prefix`` words that stands in one
   document only can have no repeat in another; those anchors, nearly all, go.  Anchors of a frequent prefix are dealt over all tasks.
2. The suffixes at the other anchors travel to the task of their prefix.  There they form memory-sized groups; each group
   becomes a suffix tree, held as the sorted suffixes' ranks at depths 1, 2, 4, ... ``window``.  A node at that depth with leaves
   of more than one document is a repeat; its leaves in all but the smallest document are marked.
3. A prefix with more than ``group_limit`` suffixes would not be memory-sized.  It is lengthened to the whole window, where a node
   is a key: the smallest document of a key is an aggregate that combines map-side, joined back under adaptive skew handling.

Exact copies of a text met in the same task are settled there.  Marks of neighbouring windows merge to spans, so what comes back
to the texts is small.

Nulls and edges: a null or blank text has no words.  A null ``doc_id`` is neither smaller nor larger than another: such rows come
back unchanged and remove nothing.  Rows that share a ``doc_id`` don't remove from each other.  Repeated rows each come back.
Texts shorter than a window lose nothing.  Other columns of the table pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgraph.llm.common import batches, extended, gram_hashes, slices, staged, word_hashes, words_of

WINDOW = 50
PREFIX = 16
GROUP_LIMIT = 20_000
HEAVY = 1_000  # keys that hold more than one in so many rows: fewer than that many, so they are broadcast

_KEYS = "__id long, __fp long"


def _anchors(words: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions, their hashes, and the first and last window start that each anchor serves."""
    grams = gram_hashes(words, prefix)
    reach = window - prefix + 1
    starts = np.arange(len(words) - window + 1)
    place = np.lib.stride_tricks.sliding_window_view(grams, reach).argmin(axis=1) + starts
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:] - 1, [len(place) - 1]))
    at = place[first]
    return at, grams[at], first, last


def _find_anchors(window: int, prefix: int):
    """(__id, __fp, text) -> one row per text: is it a copy of a smaller document of this task, and its anchors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[bytes, int] = {}
        for frame in batches(frames, "text"):
            rows = []
            for doc, fp, text in zip(frame["__id"], frame["__fp"], frame["text"], strict=True):
                words = word_hashes(text)
                if len(words) < window:
                    continue
                digest = hashlib.blake2b(words.tobytes(), digest_size=16).digest()
                first = seen.get(digest)
                if first is not None and first <= doc:
                    if first < doc:
                        rows.append((doc, fp, True, None, None))
                        continue
                elif first is None and len(seen) > 200_000:
                    seen.clear()
                seen[digest] = doc
                at, grams, _, _ = _anchors(words, window, prefix)
                rows.append((doc, fp, False, grams.view(np.int64), at.astype(np.int32)))
            yield pd.DataFrame(rows, columns=["__id", "__fp", "copy", "grams", "at"])

    return run


def _suffixes(window: int, prefix: int):
    """(__id, __fp, text, at) -> the suffixes that the windows of each listed anchor need, keyed by the anchor's prefix."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, "text", 1_000_000):
            rows = []
            for doc, fp, text, wanted in zip(frame["__id"], frame["__fp"], frame["text"], frame["at"], strict=True):
                words = word_hashes(text)
                at, grams, first, last = _anchors(words, window, prefix)
                for k in np.flatnonzero(np.isin(at, wanted)).tolist():
                    rows.append((int(grams[k].view(np.int64)), doc, fp, int(first[k]), words[first[k] : last[k] + window].tobytes()))
            yield pd.DataFrame(rows, columns=["key", "__id", "__fp", "start", "words"])

    return run


def _long_prefixes(window: int, prefix: int):
    """(__id, __fp, text, at) -> for each window of the listed anchors its hash: the prefix lengthened to the window."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, "text", 1_000_000):
            for doc, fp, text, wanted in zip(frame["__id"], frame["__fp"], frame["text"], frame["at"], strict=True):
                words = word_hashes(text)
                at, _, first, last = _anchors(words, window, prefix)
                key, other = gram_hashes(words, window).view(np.int64), gram_hashes(~words, window).view(np.int64)
                starts = np.concatenate([np.arange(first[k], last[k] + 1) for k in np.flatnonzero(np.isin(at, wanted))])
                yield pd.DataFrame({"key": key[starts], "other": other[starts], "__id": doc, "__fp": fp, "start": starts.astype(np.int32)})

    return run


def _ranks(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes by their first ``depth`` symbols; equal ranks are one node of the suffix tree at that depth."""
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    length = 1
    while length < depth:
        step = min(length, depth - length)
        pair = rank[:-step] * (len(rank) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        length += step
    return rank


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _tree_marks(group: pd.DataFrame, window: int) -> pd.DataFrame:
    """Repeats within the suffixes of some prefixes: spans of words that an earlier document has."""
    parts = [np.frombuffer(x, np.uint64) for x in group["words"]]
    sizes = np.array([len(x) for x in parts])
    counts = sizes - window + 1
    node = _ranks(np.concatenate(parts), window)
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    part = np.repeat(np.arange(len(parts)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    node, doc = node[begins[part] + offset], group["__id"].to_numpy()[part]
    order = np.lexsort((doc, node))
    heads = np.concatenate(([True], np.diff(node[order]) != 0))
    least = np.empty(len(node), np.int64)
    least[order] = doc[order][np.flatnonzero(heads)][np.cumsum(heads) - 1]
    marked, rows = doc > least, []
    cuts = np.concatenate(([0], np.cumsum(counts)))
    hit = np.add.reduceat(marked, cuts[:-1]) > 0
    ids, fps, starts = (group[c].to_numpy() for c in ("__id", "__fp", "start"))
    for k in np.flatnonzero(hit).tolist():
        for a, b in _runs(marked[cuts[k] : cuts[k + 1]]):
            rows.append((ids[k], fps[k], int(starts[k]) + a, int(starts[k]) + b - 1 + window))
    return pd.DataFrame(rows, columns=["__id", "__fp", "from", "to"])


def _subtrees(window: int, budget: int = 500_000):
    """Rows sorted by key -> marks.  Whole keys are gathered up to ``budget`` words, one memory-sized group after the other."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        held = 0
        for frame in frames:
            while len(frame):
                sizes = frame["words"].str.len().to_numpy() // 8
                keys = frame["key"].to_numpy()
                fits = int(np.searchsorted(np.cumsum(sizes), max(1, budget - held)))
                if fits >= len(frame):
                    waiting.append(frame)
                    held += int(sizes.sum())
                    break
                # the first key that begins at or after the budget's end
                nexts = np.flatnonzero(np.concatenate(([not waiting or keys[0] != waiting[-1]["key"].iloc[-1]], keys[1:] != keys[:-1])))
                nexts = nexts[nexts >= fits]
                nexts = nexts[(nexts > 0) | bool(waiting)]
                if not len(nexts):
                    waiting.append(frame)
                    held += int(sizes.sum())
                    break
                cut = int(nexts[0])
                yield _tree_marks(pd.concat([*waiting, frame.iloc[:cut]]), window)
                waiting, held, frame = [], 0, frame.iloc[cut:]
        if waiting:
            yield _tree_marks(pd.concat(waiting), window)

    return run


def _shared_places(anchors: DataFrame, shared: DataFrame, total: int) -> DataFrame:
    """The anchors whose ``key`` is in ``shared`` (key, n, long), with ``long``; ``total`` is the sum of ``n``.

    Keys of more than ``total / HEAVY`` anchors are fewer than HEAVY, whatever the size of the table.  They are broadcast, and their
    anchors go through the shuffle dealt at random in place of their key, so that no task receives all anchors of a frequent key.
    """
    frequent = F.col("n") * HEAVY > total
    heavy = shared.where(frequent).select("key", F.col("long").alias("heavy"))
    light = shared.where(~frequent).select(F.col("key").alias("to"), F.col("long").alias("light"))
    flagged = anchors.join(F.broadcast(heavy), "key", "left")
    dealt = flagged.withColumn("by", F.when(F.col("heavy").isNull(), F.col("key")).otherwise(F.xxhash64("__id", "__fp", "at")))
    met = dealt.join(light, F.col("by") == F.col("to"), "left")
    return met.select("__id", "__fp", "at", "key", F.coalesce("heavy", "light").alias("long")).where("long is not null")


def _cut(whole: bool):
    """Adds the numbers of words and of removed words, and the kept words joined by one space; with ``whole`` an unchanged text stays as it is."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(tables, size=2_000_000):
            total, gone, kept = [], [], []
            for text, copy, spans in zip(*(table.column(c).to_pylist() for c in ("text", "copy", "spans")), strict=True):
                words = words_of(text)
                total.append(len(words))
                if copy:
                    gone.append(len(words))
                    kept.append("")
                    continue
                if spans:
                    edges = np.zeros(len(words) + 1, np.int32)
                    for x in spans:
                        edges[x["from"]] += 1
                        edges[x["to"]] -= 1
                    words = [w for w, n in zip(words, np.cumsum(edges[:-1]).tolist(), strict=True) if not n]
                gone.append(total[-1] - len(words))
                kept.append(text if whole and not gone[-1] else b" ".join(words).decode())
            yield extended(
                table, ("text", "copy", "spans"), n_words=pa.array(total, pa.int64()), n_removed=pa.array(gone, pa.int64()), kept=pa.array(kept, pa.string())
            )

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group_limit: int = GROUP_LIMIT, whole: bool = False) -> DataFrame:
    """Return (doc_id, rest, n_words, n_removed, kept_text), one row per row; ``rest`` is a struct of all columns but id and text.

    With ``whole`` a text that loses nothing is given as it is, null included, else as its words joined by one space.
    """
    if not 1 <= prefix <= window:
        raise ValueError("prefix must be 1 to window words long")
    text = F.col("text").cast("string")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    table = docs.select(
        F.col("doc_id").cast("long").alias("__id"), F.xxhash64(text).alias("__fp"), text.alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in rest] or [F.lit(None).cast("string").alias("__none")]).alias("rest"),
    )
    keyed = table.where("__id is not null").select("__id", "__fp", "text")
    found = staged(keyed.mapInPandas(_find_anchors(window, prefix), f"{_KEYS}, copy boolean, grams array<long>, at array<int>"))

    anchors = found.where("not copy").select("__id", "__fp", F.arrays_zip("grams", "at").alias("z")).select("__id", "__fp", F.inline("z"))
    anchors = anchors.withColumnRenamed("grams", "key")
    shared = staged(
        anchors.groupBy("key").agg(F.min("__id").alias("low"), F.max("__id").alias("high"), F.count("*").alias("n"))
        .where("low < high").select("key", "n", (F.col("n") > group_limit).alias("long"))
    )
    total = shared.agg(F.sum("n")).first()[0] or 0
    places = staged(
        _shared_places(anchors, shared, total)
        .groupBy("__id", "__fp", "long").agg(F.collect_set("at").alias("at")).select("__id", "__fp", "long", "at")
    )

    def with_text(which: str) -> DataFrame:
        return keyed.join(places.where(which).drop("long"), ["__id", "__fp"])

    trees = (
        with_text("not long").mapInPandas(_suffixes(window, prefix), f"key long, {_KEYS}, start int, words binary")
        .repartition("key").sortWithinPartitions("key").mapInPandas(_subtrees(window), f"{_KEYS}, from int, to int")
    )
    spans = trees
    if places.where("long").limit(1).count():
        keys = with_text("long").mapInPandas(_long_prefixes(window, prefix), f"key long, other long, {_KEYS}, start int")
        least = keys.groupBy("key", "other").agg(F.min("__id").alias("least"), F.max("__id").alias("most")).where("least < most")
        late = keys.join(least, ["key", "other"]).where("__id > least")
        spans = trees.unionByName(late.select("__id", "__fp", F.col("start").alias("from"), (F.col("start") + window).alias("to")))
    none = F.lit(None).cast("array<struct<from:int,to:int>>")
    marks = spans.groupBy("__id", "__fp").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    copies = found.where("copy").select("__id", "__fp").distinct()
    changes = (
        marks.select("__id", "__fp", "spans", F.lit(False).alias("copy"))
        .unionByName(copies.select("__id", "__fp", none.alias("spans"), F.lit(True).alias("copy")))
        .groupBy("__id", "__fp").agg(F.max("copy").alias("copy"), F.first("spans", ignorenulls=True).alias("spans"))
    )
    out = table.join(changes, ["__id", "__fp"], "left").select("__id", "text", "rest", "copy", "spans")
    numbers = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    made = out.mapInArrow(_cut(whole), T.StructType([*(table.schema[c] for c in ("__id", "rest")), *numbers]))
    return made.select(F.col("__id").alias("doc_id"), "rest", "n_words", "n_removed", F.col("kept").alias("kept_text"))
