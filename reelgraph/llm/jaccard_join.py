"""Near-duplicate documents by the Jaccard similarity of word n-gram sets: a prefix-filtered similarity self-join.

1. One pass counts how often the n-grams of each of 2**22 hash cells stand in the corpus.  The counts have a fixed size whatever the
   corpus; they order all n-grams from rare to frequent, ties by hash.
2. A second pass writes each set's prefix in that order: ``size - ceil(t * size) + 1`` n-grams, so two similar sets share one.
   Equal sets met in one task are settled there by a digest and write one prefix.
3. In the task of an n-gram the set in which fewest n-grams are rarer leads.  It is paired with the others that the length and
   positional filters let it have, one pair per set and n-gram; the pairs are made distinct, pass the suffix filter and are verified
   once with the whole sets.
   N-grams that may be very frequent are salted first, and their leaders compared.
4. Verified links are joined to components.  Only pairs of sets which share a prefix n-gram and lie in different components then
   remain; they pass the length, positional and suffix filters and are verified once.  So a group of many copies costs one
   comparison per copy instead of one per pair, and no link between components is lost.
5. Links are counted inside components, where all of them are.  Documents with equal sets are one set with its number of documents;
   every two different sets of a component are compared, in blocks of bounded size that give sums per set and not pairs.

Result: (doc_id, n_shingles, component_id, n_links): ``component_id`` is the smallest doc_id reachable by links; ``n_links`` is the
number of other documents that the document is linked with.

Nulls and edges: a null, empty or blank text has no n-grams, links with nothing and is its own component.  A text with fewer than n
words has its whole sequence as its one n-gram.  A null ``doc_id`` gets null as its component.  Rows that share a ``doc_id`` are
one node; each row comes back.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelgraph.llm.common import batches, documents, gram_hashes, slices, staged, word_hashes
from reelgraph.llm.components import components

N = 5
NUM, DEN = 75, 100  # the similarity as a fraction
CELL_BITS = 22
_BLOCK = 1 << 14  # cells of one row of counts
SALT_ABOVE = 200_000
RUN_BLOCK = 20_000
LEADERS = 8
SETS, GRAMS = 512, 2_000_000  # of a block, about
_COLUMNS = 4096  # n-grams compared at once
_PARTS = 32 * 4  # bytes of a set's counts by part of the hash range; its digest stands behind them
FILTER_WORDS = 1 << 18  # of 64 bits; a fixed size, whatever the corpus


def grams_of(text: str | None, n: int) -> np.ndarray:
    """The 64-bit hashes of the text's n-grams, in their order and with repeats."""
    words = word_hashes(text, lower=True)
    if not len(words):
        return words
    return gram_hashes(words, n) if len(words) >= n else gram_hashes(words + np.uint64(len(words)), len(words))


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted hashes of the text's distinct n-grams."""
    return np.unique(grams_of(text, n))


def similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Is the Jaccard similarity of two sorted sets at least ``num / den``?  Empty sets are similar to nothing."""
    if not len(x) or not len(y) or num * max(len(x), len(y)) > den * min(len(x), len(y)):
        return False
    together = np.sort(np.concatenate((x, y)), kind="stable")
    both = int((together[1:] == together[:-1]).sum())
    return den * both >= num * (len(x) + len(y) - both)


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _count_cells(n: int, bits: int):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(1 << bits, np.uint32), [], 0

        def add() -> None:
            np.add(counts, np.bincount((np.concatenate(held) >> np.uint64(64 - bits)).view(np.int64), minlength=1 << bits), out=counts, casting="unsafe")
            held.clear()

        for table in slices(tables):
            for text in table.column("text").to_pylist():
                held.append(grams_of(text, n))
                size += len(held[-1])
                if size > 1_000_000:
                    add()
                    size = 0
        if held:
            add()
        for block in range(0, 1 << bits, _BLOCK):
            part = counts[block : block + _BLOCK]
            if part.any():
                row = [pa.array([block // _BLOCK], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=["block", "counts"])

    return run


def _add_cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, np.ndarray] = {}
    for frame in frames:
        for block, counts in zip(frame["block"], frame["counts"], strict=True):
            part = np.frombuffer(zlib.decompress(counts), np.uint32).astype(np.uint64)
            sums[block] = sums.get(block, 0) + part
    for block, part in sums.items():
        yield pd.DataFrame({"block": [block], "counts": [zlib.compress(part.tobytes(), 1)]})


def cell_counts(docs: DataFrame, n: int = N, bits: int = CELL_BITS) -> np.ndarray:
    """N-grams per hash cell, over the whole corpus; 2**bits numbers, however large the corpus.

    Repeats inside a document count, which saves sorting every set twice: a count only orders n-grams and bounds a cell's sets.
    """
    schema = "block int, counts binary"
    rows = docs.select("text").mapInArrow(_count_cells(n, bits), schema).repartition("block").mapInPandas(_add_cells, schema).collect()
    counts = np.zeros(1 << bits, np.uint64)
    for row in rows:
        counts[row["block"] * _BLOCK : (row["block"] + 1) * _BLOCK] = np.frombuffer(zlib.decompress(row["counts"]), np.uint64)
    return counts


def _prefixes(n: int, num: int, den: int, bits: int, levels, hot):
    """(doc_id, text) -> per document a row with its size and the equal set met before, and a row per prefix n-gram.

    In the first kind ``pos`` is -1, ``token`` spreads the rows, ``rec`` and ``other`` are the document and its equal, and ``spans``
    counts the n-grams in each 32nd of the hash range and ends with the set's digest.
    """

    names = ["token", "salt", "rec", "size", "pos", "other", "spans"]

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = levels.value, {}
        for table in slices(tables, size=2_000_000):
            own, spans, found = [], [], []
            for doc, text in zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True):
                grams = shingles(text, n)
                size, other, digest = len(grams), doc, _digest(grams)
                if size:
                    if len(seen) > 100_000:
                        seen.clear()
                    other = seen.setdefault(digest, doc)
                own.append((doc, size, other))
                spans.append(np.bincount((grams >> np.uint64(59)).view(np.int64), minlength=32).astype("<u4").tobytes() + digest)
                if size and other == doc:
                    length = size - -(-num * size // den) + 1
                    rare = level[(grams >> np.uint64(64 - bits)).view(np.int64)]
                    first = np.argsort(rare, kind="stable")[:length]
                    salts = (1 + (doc % hot[rare[first]])) * (hot[rare[first]] > 1)
                    found.append((doc, size, grams[first].view(np.int64), salts.astype(np.int32)))
            docs, sizes, others = (np.array(c, np.int64) for c in zip(*own, strict=True))
            nothing, ones = np.zeros(len(own), np.int32), np.full(len(own), -1, np.int32)
            columns = [docs, nothing, docs, sizes.astype(np.int32), ones, others, pa.array(spans, pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
            if found:
                docs, sizes, tokens, salts = zip(*found, strict=True)
                lengths = [len(t) for t in tokens]
                places = np.concatenate([np.arange(k, dtype=np.int32) for k in lengths])
                columns = [
                    np.concatenate(tokens), np.concatenate(salts), np.repeat(np.array(docs, np.int64), lengths),
                    np.repeat(np.array(sizes, np.int32), lengths), places, np.zeros(len(places), np.int64), pa.nulls(len(places), pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return run


def _overlap(size_x, size_y, num: int, den: int):
    """The common n-grams that two sets of these sizes need."""
    return -(-num * (size_x + size_y) // (num + den))


def _leaders(num: int, den: int):
    """Rows sorted by (token, salt, pos, rec) -> rows of n-grams with several sets, each with the leader it may be similar to.

    A set in which fewer n-grams are rarer than this one comes earlier: of near copies the least changed one leads, and the others are
    closer to it than to each other.  A leader takes the rows that the length and positional filters leave it; up to ``LEADERS`` sets
    that fit no leader lead as well.  ``ordinal`` numbers the rows of a run.  Nothing of a run is kept but its first row and its
    leaders, so a run may be of any length.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["token", "salt", "rec", "size", "pos"]
        last, first, leaders, ordinal = None, None, [], 0
        for frame in frames:
            info = frame[frame["pos"] < 0]
            if len(info):
                yield info.assign(ordinal=0, leader=info["other"])[[*names, "ordinal", "leader", "spans"]]
            frame = frame[frame["pos"] >= 0]
            if not len(frame):
                continue
            token, salt = frame["token"].to_numpy(), frame["salt"].to_numpy()
            same = np.concatenate(([last == (token[0], salt[0])], (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])))
            keep = same | np.concatenate((same[1:], [True])) | (salt > 0)  # the last row may go on; a salted n-gram has other runs
            out = []
            for joins, tok, s, rec, size, pos in zip(
                same[keep].tolist(), *(frame[c].to_numpy()[keep].tolist() for c in names), strict=True
            ):
                if not joins:
                    if first is not None and first[1] > 0:
                        out.append((*first, 0, first[2]))
                    first, leaders, ordinal = (tok, s, rec, size, pos), [(rec, size, pos)], 0
                    continue
                if first is not None:
                    out.append((*first, 0, first[2]))
                    first = None
                ordinal += 1
                leader = rec
                for head, head_size, head_pos in leaders:
                    if num * max(size, head_size) <= den * min(size, head_size) and (
                        1 + min(size - pos - 1, head_size - head_pos - 1) >= _overlap(size, head_size, num, den)
                    ):
                        leader = head
                        break
                else:
                    if len(leaders) < LEADERS:
                        leaders.append((rec, size, pos))
                out.append((tok, s, rec, size, pos, ordinal, leader))
            last = (token[-1], salt[-1])
            yield pd.DataFrame(out, columns=[*names, "ordinal", "leader"]).assign(spans=None)
        if first is not None and first[1] > 0:
            yield pd.DataFrame([(*first, 0, first[2])], columns=[*names, "ordinal", "leader"]).assign(spans=None)

    return run


def _verify(n: int, num: int, den: int):
    """Rows sorted so that each hub's own row comes first -> (a, b) of the verified links between a hub and its partners."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub, at = [], None
        for frame in batches(frames, "text"):
            links = []
            for key, salt, doc, text in zip(frame["hub"], frame["part"], frame["doc_id"], frame["text"], strict=True):
                grams = shingles(None if text is None else zlib.decompress(text).decode(), n)
                if at != (key, salt):
                    hub, at = [grams], (key, salt)
                elif doc == key:  # another text under the hub's doc_id
                    if not any(np.array_equal(x, grams) for x in hub):
                        hub.append(grams)
                elif any(similar(x, grams, num, den) for x in hub):
                    links.append((key, doc))
            yield pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return run


def _perhaps_among(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """``rows`` with ``__perhaps``: may ``column`` be one of ``wanted``'s?  A bit filter of fixed size; rows it rules out needn't be shuffled."""
    bit = lambda key: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(key, 58).cast("int"))
    word = lambda key: F.pmod(key, F.lit(FILTER_WORDS)).cast("int")
    want, have = F.xxhash64(wanted.columns[0], F.lit(3)), F.xxhash64(column, F.lit(3))
    bits = wanted.select(word(want).alias("__word"), bit(want).alias("bit")).groupBy("__word").agg(F.bit_or("bit").alias("__bits"))
    perhaps = F.coalesce(F.col("__bits").bitwiseAND(bit(have)) != 0, F.lit(False))
    return rows.withColumn("__word", word(have)).join(F.broadcast(bits), "__word", "left").select(*rows.columns, perhaps.alias("__perhaps"))


def _packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts compressed for their way through two shuffles."""
    for frame in batches(frames, "text"):
        texts = [None if t is None else zlib.compress(t.encode()) for t in frame["text"]]
        yield pd.DataFrame({"doc_id": frame["doc_id"], "text": pd.Series(texts, index=frame.index, dtype=object)})


def _verified(docs: DataFrame, pairs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The links among distinct ``pairs`` (a, b).  Each text travels once per hub; a hub with many partners is split."""
    hubs = pairs.groupBy("a").agg(F.count("*").alias("k")).select("a", (1 + F.floor(F.col("k") / 2_000)).cast("int").alias("parts"))
    partners = pairs.join(hubs, "a").select(
        F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("doc_id")
    )
    own = hubs.select(F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("doc_id"))
    wanted = staged(partners.unionByName(own))
    texts = _perhaps_among(docs, "doc_id", wanted.select("doc_id")).where("__perhaps").select("doc_id", "text")
    texts = texts.mapInPandas(_packed, "doc_id long, text binary")
    rows = texts.join(wanted, "doc_id").select("hub", "part", (F.col("doc_id") != F.col("hub")).alias("late"), "doc_id", "text")
    sorted_rows = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "late", "doc_id")
    return staged(sorted_rows.mapInPandas(_verify(n, num, den), "a long, b long"))


def _across(num: int, den: int, most: int | None = None):
    """Rows sorted by (token, low, high, size, rec) -> pairs of one key in different components that the length and positional filters leave.

    A key has the rows of at most two blocks.  Runs of more than ``most`` rows are left out: those are dealt in blocks.
    """

    def pairs_of(size, rec, pos, comp, block) -> np.ndarray:
        two, m = block.min() != block.max(), len(rec)
        found = []
        for late in range(0, m, 64):  # rows late to late + 64 with all before them, of which none is larger
            stop = min(late + 64, m)
            j, i = np.nonzero(np.tri(stop - late, stop, late - 1, dtype=bool))
            j += late
            good = (comp[i] != comp[j]) & (rec[i] != rec[j]) & (num * size[j] <= den * size[i]) & ((block[i] != block[j]) | (not two))
            i, j = i[good], j[good]
            good = 1 + np.minimum(size[i] - pos[i] - 1, size[j] - pos[j] - 1) >= _overlap(size[i], size[j], num, den)
            found.append(np.stack((np.minimum(rec[i], rec[j])[good], np.maximum(rec[i], rec[j])[good]), axis=1))
        return np.concatenate(found)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []  # the last run so far, which may go on in the next batch
        for frame in frames:
            if not len(frame):
                continue
            keys = frame[["token", "low", "high"]].to_numpy()
            cuts = (np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()
            if waiting and (waiting[-1][["token", "low", "high"]].to_numpy()[-1] != keys[0]).any():
                yield made(pd.concat(waiting))
                waiting = []
            if cuts:
                yield made(pd.concat([*waiting, frame.iloc[: cuts[-1]]]))
                waiting = []
            waiting.append(frame.iloc[cuts[-1] if cuts else 0 :])
        if waiting:
            yield made(pd.concat(waiting))

    def made(frame: pd.DataFrame) -> pd.DataFrame:
        keys = frame[["token", "low", "high"]].to_numpy()
        starts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1))
        ends = np.append(starts[1:], len(frame))
        columns = [frame[c].to_numpy().astype(np.int64) for c in ("size", "rec", "pos", "comp", "block")]
        wanted = np.minimum.reduceat(columns[3], starts) < np.maximum.reduceat(columns[3], starts)
        if most is not None:
            wanted &= ends - starts <= most
        pairs = [pairs_of(*(c[a:b] for c in columns)) for a, b in zip(starts[wanted].tolist(), ends[wanted].tolist(), strict=True)]
        return pd.DataFrame(np.unique(np.concatenate([np.empty((0, 2), np.int64), *pairs]), axis=0), columns=["a", "b"])

    return run


def _suffix_filter(num: int, den: int):
    """(a, b, spans_a, spans_b) -> the pairs that may be similar: two sets differ in at least as many n-grams as their counts do by part."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x, y = (np.frombuffer(b"".join(frame[c]), "<u4").astype(np.int64).reshape(len(frame), -1) for c in ("spans_a", "spans_b"))
            together = x.sum(axis=1) + y.sum(axis=1)
            good = np.abs(x - y).sum(axis=1) <= together - 2 * _overlap(together, 0, num, den)
            yield frame.loc[good, ["a", "b"]]

    return run


def _may_link(pairs: DataFrame, info: DataFrame, num: int, den: int) -> DataFrame:
    """The distinct (a, b) that pass the suffix filter."""
    spans = info.select("rec", "spans").repartition("rec").distinct()  # one shuffle for this and the joins
    both = pairs.join(spans.select(F.col("rec").alias("a"), F.col("spans").alias("spans_a")), "a").join(
        spans.select(F.col("rec").alias("b"), F.col("spans").alias("spans_b")), "b"
    )
    return staged(both.select("a", "b", "spans_a", "spans_b").mapInPandas(_suffix_filter(num, den), "a long, b long").distinct())


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows of long runs, in each pair of blocks of their run that holds them; runs within one component are left out."""
    apart = rows.groupBy("token").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 < c2")
    left = rows.join(apart, "token", "left_semi").withColumn("block", F.pmod(F.xxhash64("rec"), F.col("blocks")).cast("int"))
    cells = left.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "token", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "rec", "size", "pos", "comp", "block"
    )
    return cells.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high", "size", "rec")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each two of the sets have in common."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    grams = np.concatenate(sets)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    fresh = np.concatenate(([True], grams[1:] != grams[:-1]))
    shared = ~fresh | np.concatenate((~fresh[1:], [False]))
    owner, column = owner[shared], np.cumsum(fresh[shared]) - 1
    both = np.zeros((m, m), np.int64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, (start, start + _COLUMNS))
        has = np.zeros((m, column[b - 1] - start + 1), np.float32)
        has[owner[a:b], column[a:b] - start] = 1
        both += (has @ has.T).astype(np.int64)  # exact: sums of at most _COLUMNS ones
    return both


def _link_sums(n: int, num: int, den: int):
    """Rows sorted by (component, low, high) -> per set ``x`` the number of plain documents in the cell's other sets similar to it.

    A cell has the sets of at most two blocks and compares those of different blocks, or all of one block.  Similar sets of which one
    is that of a document with several sets are given as (x, y) as well.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, {}
        for frame in batches(frames, "text"):
            out = []
            for comp, low, high, block, digest, plain, several, text in zip(
                *(frame[c] for c in ("component", "low", "high", "block", "digest", "plain", "several", "text")), strict=True
            ):
                if at != (comp, low, high):
                    out += counted(at, held)
                    at, held = (comp, low, high), {}
                if digest not in held:
                    grams = shingles(None if text is None else zlib.decompress(text).decode(), n)
                    if _digest(grams) == digest:  # else another text under the same doc_id
                        held[digest] = (grams, block, plain, several)
            yield pd.DataFrame(out, columns=["x", "y", "plain"])
        yield pd.DataFrame(counted(at, held), columns=["x", "y", "plain"])

    def counted(at, held) -> list[tuple]:
        if len(held) < 2:
            return []
        digests, (sets, block, plain, several) = list(held), zip(*held.values(), strict=True)
        size, block, plain, several = (np.array(x) for x in ([len(x) for x in sets], block, plain, several))
        both = _overlaps(sets)
        linked = den * both >= num * (size[:, None] + size[None, :] - both)
        np.fill_diagonal(linked, False)
        if at[1] != at[2]:
            linked &= block[:, None] != block[None, :]
        sums = linked @ plain
        apart = [(digests[i], digests[j], 0) for i, j in zip(*np.nonzero(linked & (several[:, None] | several[None, :])), strict=True)]
        return [(digests[i], None, int(sums[i])) for i in np.flatnonzero(sums)] + apart

    return run


def _link_counts(docs: DataFrame, info: DataFrame, joined: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(doc, n_links) of every document that is linked.

    A document with one set is plain, and its links are counted by set.  A document with several, of rows that share a ``doc_id``,
    is linked where any of its sets is; those few are followed pair by pair, so that none is counted twice.
    """
    nodes = joined.select("node", "component").unionByName(joined.select(F.col("component").alias("node"), "component").distinct())
    own = info.where("size > 0").select(F.col("rec").alias("node"), "digest", "size").distinct().join(nodes, "node")
    several = F.count("*").over(Window.partitionBy("node")) > 1
    members = staged(own.select(F.col("node").alias("doc"), "digest", "size", "component", several.alias("several")))
    sets = staged(members.groupBy("component", "digest").agg(
        F.min("doc").alias("doc_id"), F.max("size").alias("size"), F.count_if(~F.col("several")).alias("plain"), F.max("several").alias("several")
    ))
    blocks = 1 + F.floor(F.greatest(F.count("*") / SETS, F.sum("size") / GRAMS))
    groups = sets.groupBy("component").agg(F.count("*").alias("k"), blocks.cast("int").alias("blocks")).where("k > 1")
    block = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    cells = sets.join(groups, "component").withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    wanted = staged(cells.select(
        "component", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "digest", "plain", "several", "doc_id"
    ))
    texts = _perhaps_among(docs, "doc_id", wanted.select("doc_id")).where("__perhaps").select("doc_id", "text")
    rows = texts.mapInPandas(_packed, "doc_id long, text binary").join(wanted, "doc_id").drop("doc_id")
    cell = ["component", "low", "high"]
    sums = staged(
        rows.repartition(*cell).sortWithinPartitions(*cell).mapInPandas(_link_sums(n, num, den), "x binary, y binary, plain long")
    )
    plain = sets.select("digest", "plain")
    total = sums.select(F.col("x").alias("digest"), "plain").unionByName(plain).groupBy("digest").agg(F.sum("plain").alias("n"))
    counts = members.where("not several").join(total, "digest").select("doc", "digest", (F.col("n") - 1).alias("n"))
    mixed = members.where("several").select("doc", "digest")
    if not mixed.limit(1).count():
        return counts.select("doc", F.col("n").alias("n_links"))
    near = sums.where("y is not null").select("x", "y").unionByName(mixed.select(F.col("digest").alias("x"), F.col("digest").alias("y"))).distinct()
    far = mixed.select(F.col("doc").alias("other"), F.col("digest").alias("y"))
    beside = near.join(far, "y").select(F.col("x").alias("digest"), "other").distinct().groupBy("digest").agg(F.count("*").alias("more"))
    lone = counts.join(beside, "digest", "left").select("doc", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n_links"))
    around = mixed.join(near, mixed["digest"] == near["x"]).select("doc", "y").distinct()
    parts = around.join(plain, around["y"] == plain["digest"]).select("doc", F.col("plain").alias("n")).unionByName(
        around.join(far, "y").where("doc <> other").select("doc", "other").distinct().select("doc", F.lit(1).cast("long").alias("n"))
    )
    return lone.unionByName(parts.groupBy("doc").agg(F.sum("n").alias("n_links")))


def jaccard_components(
    docs: DataFrame, n: int = N, num: int = NUM, den: int = DEN, bits: int = CELL_BITS, count_links: bool = True
) -> DataFrame:
    """Link documents whose n-gram sets have a Jaccard similarity of at least ``num / den``; see the module's text.

    Without ``count_links`` there is no column ``n_links`` and step 5 is not done.
    """
    if n < 1 or not 0 < num <= den:
        raise ValueError("n must be positive and the similarity in (0, 1]")
    texts = documents(docs)
    keyed = texts.where("doc_id is not null")
    spark = docs.sparkSession
    counts = cell_counts(keyed, n, bits)
    # in steps of an eighth of a power of two; monotone, so rare n-grams stay first
    level = np.floor(8 * np.log2(counts.astype(np.float64) + 1)).astype(np.uint16)
    steps = np.arange(level.max() + 2)
    hot = np.maximum(1, np.ceil(2 ** ((steps + 1) / 8) / SALT_ABOVE)).astype(np.int64)
    levels = spark.sparkContext.broadcast(level)
    rows = keyed.mapInArrow(
        _prefixes(n, num, den, bits, levels, hot), "token long, salt int, rec long, size int, pos int, other long, spans binary"
    )
    sorted_rows = rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "pos", "rec")
    table = staged(sorted_rows.mapInPandas(
        _leaders(num, den), "token long, salt int, rec long, size int, pos int, ordinal long, leader long, spans binary"
    ))
    info, runs = table.where("pos < 0"), table.where("pos >= 0")
    info = info.withColumns({"digest": F.expr(f"substring(spans, {_PARTS + 1}, 16)"), "spans": F.expr(f"substring(spans, 1, {_PARTS})")})

    led = runs.where("leader <> rec").select(F.col("leader").alias("a"), F.col("rec").alias("b"))
    salted = runs.where("salt > 0 and leader = rec").groupBy("token", "rec").agg(F.first("size").alias("size"))
    heads = salted.groupBy("token").agg(F.min("rec").alias("a"))
    between = salted.join(heads, "token").where("a <> rec").select("a", F.col("rec").alias("b"))
    firsts = _may_link(led.unionByName(between).distinct(), info, num, den)
    equal = info.where("leader <> rec").select(F.col("leader").alias("a"), F.col("rec").alias("b")).distinct()
    links = equal.unionByName(_verified(keyed, firsts, n, num, den))
    joined = components(links, "a", "b")

    # a set outside every component so far is its own; most such rows skip the shuffle by set
    maybe = _perhaps_among(runs, "rec", joined.select("node"))
    columns = ["token", "salt", "rec", "size", "pos"]
    placed = (
        maybe.where("__perhaps").join(joined, F.col("rec") == joined["node"], "left").select(*columns, F.coalesce("component", "rec").alias("comp"))
        .unionByName(maybe.where("NOT __perhaps").select(*columns, F.col("rec").alias("comp")))
    )
    nil = F.lit(0)
    pairs = (
        placed.where("salt = 0").select("token", nil.alias("low"), nil.alias("high"), "rec", "size", "pos", "comp", nil.alias("block"))
        .repartition("token").sortWithinPartitions("token", "size", "rec").mapInPandas(_across(num, den, RUN_BLOCK), "a long, b long")
    )
    long_runs = staged(
        runs.where((F.col("ordinal") >= RUN_BLOCK) | (F.col("salt") > 0)).groupBy("token")
        .agg((F.greatest(F.max("salt"), F.lit(1)) * (1 + F.floor(F.max("ordinal") / RUN_BLOCK))).cast("int").alias("blocks"))
    )
    if long_runs.limit(1).count():
        pairs = pairs.unionByName(_in_blocks(placed.join(long_runs, "token")).mapInPandas(_across(num, den), "a long, b long"))
    new = pairs.distinct().join(firsts.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    rest = _may_link(new, info, num, den)
    more = _verified(keyed, rest, n, num, den)
    if more.limit(1).count():
        joined = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), "a", "b")
    out = info.select(F.col("rec").alias("doc_id"), F.col("size").cast("long").alias("n_shingles")).join(
        joined.withColumnRenamed("node", "doc_id"), "doc_id", "left"
    ).withColumn("component_id", F.coalesce("component", "doc_id"))
    none = F.lit(None).cast("long")
    lost = texts.where("doc_id is null").mapInPandas(_sizes(n), "n_shingles long").select(
        none.alias("doc_id"), "n_shingles", none.alias("component_id"), F.lit(0).cast("long").alias("n_links")
    )
    columns = ["doc_id", "n_shingles", "component_id"]
    if count_links:
        counts = _link_counts(keyed, info, joined, n, num, den).withColumnRenamed("doc", "doc_id")
        out, columns = out.join(counts, "doc_id", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0))), [*columns, "n_links"]
    return out.select(*columns).unionByName(lost.select(*columns))


def _sizes(n: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"n_shingles": [len(shingles(t, n)) for t in frame["text"]]})

    return run
