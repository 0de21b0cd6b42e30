"""Nearest neighbours by largest inner product: vantage-point trees over shards of all vectors.

Inner products are no metric.  With one more component, sqrt(M**2 - |x|**2) for rows (M is the largest norm) and 0 for queries, the
distance orders rows as the inner product does.  On those, each shard of about ``SHARD`` rows is a vantage-point tree: a node
splits its rows at the median distance to a vantage point, leaves hold ``LEAF`` rows.

A query goes down the nearer side first.  It skips a side if every row there must be farther than its k-th found so far; by the triangle
inequality that is so if the gap between its distance and the split is larger.  ``factor`` relaxes this: the gap is multiplied by it
first, so larger factors skip more and may miss some; factor 1 is exact.  All queries of a block go through a shard's tree together.

Queries are dealt to blocks of about ``BLOCK``; each block meets each shard in one task, of bounded size on both sides.  Shards and
blocks are drawn by hash of the row's id and values, so no group of equal vectors fills one.  Equal scores are ordered by the smaller
id; scores are summed in double precision from the original components.

Nulls and edges: vectors that are null, empty or all zero, or hold null or non-finite components, take no part.  Vectors of another
length are never compared with each other.  Rows with a null id take no part.  Rows with the query's own id are no candidates.  With
fewer candidates than k all are returned.  A repeated row counts once.  Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelgraph.llm.common import staged

SHARD = 16_384
BLOCK = 4_096
LEAF = 512
K = 20
FACTOR = 1.0


class Tree:
    """A vantage-point tree over the rows of ``points``; ``order`` lists the rows leaf by leaf."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.root = self._grow(np.arange(len(points)))

    def _grow(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        vantage = self.points[rows[0]]
        # of a few rows the one with the widest spread of distances
        best = -1.0
        for k in rows[:: max(1, len(rows) // 5)][:5]:
            spread = float(_distances(self.points[rows[:: max(1, len(rows) // 200)]], self.points[k]).std())
            if spread > best:
                best, vantage = spread, self.points[k]
        distance = _distances(self.points[rows], vantage)
        middle = len(rows) // 2
        split = np.argpartition(distance, middle)
        near, far = split[:middle], split[middle:]
        return vantage, float(distance[near].max()), float(distance[far].min()), self._grow(rows[near]), self._grow(rows[far])


def _distances(points: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((points - point) ** 2).sum(axis=1), 0))


class Search:
    """The k best rows of one shard for each of some queries."""

    def __init__(self, ids, vectors, query_ids, queries, k: int, factor: float, largest: float, leaf: int = LEAF):
        self.ids, self.vectors, self.query_ids, self.queries = ids, vectors, query_ids, queries
        self.k, self.factor = k, factor
        squares = (vectors**2).sum(axis=1)
        self.base = largest**2 + (queries**2).sum(axis=1)  # squared distance = base - 2 * inner product
        self.lifted = np.concatenate((queries, np.zeros((len(queries), 1))), axis=1)
        self.scores = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.tree = Tree(np.concatenate((vectors, np.sqrt(np.maximum(largest**2 - squares, 0))[:, None]), axis=1), leaf)
        self._visit(self.tree.root, np.arange(len(queries)))

    def _reach(self, q: np.ndarray) -> np.ndarray:
        """The distance to the k-th best so far."""
        return np.sqrt(np.maximum(self.base[q] - 2 * self.scores[q, -1], 0))

    def _visit(self, node, q: np.ndarray) -> None:
        if not len(q):
            return
        if isinstance(node, np.ndarray):
            self._scan(node, q)
            return
        vantage, inner, outer, near, far = node
        distance = _distances(self.lifted[q], vantage)
        inside = distance <= (inner + outer) / 2
        self._visit(near, q[inside])
        self._visit(far, q[~inside])
        slack = 1e-9 * (1 + distance)
        go = inside & ((outer - distance) * self.factor <= self._reach(q) + slack)
        self._visit(far, q[go])
        go = ~inside & ((distance - inner) * self.factor <= self._reach(q) + slack)
        self._visit(near, q[go])

    def _scan(self, rows: np.ndarray, q: np.ndarray) -> None:
        rough = self.queries[q] @ self.vectors[rows].T
        least = self.scores[q, -1]
        with np.errstate(invalid="ignore"):
            margin = np.where(np.isfinite(least), 1e-9 * (1 + np.abs(least)), 0)
        some = rough >= (least - margin)[:, None]
        some &= self.ids[rows][None, :] != self.query_ids[q][:, None]
        hit = np.flatnonzero(some.any(axis=1))
        if not len(hit):
            return
        some, rough, q = some[hit], rough[hit], q[hit]
        if len(rows) > 3 * self.k:  # all above the leaf's own k-th, ties included
            kth = -np.partition(-np.where(some, rough, -np.inf), self.k - 1, axis=1)[:, self.k - 1]
            with np.errstate(invalid="ignore"):
                some &= rough >= np.where(np.isfinite(kth), kth - 1e-9 * (1 + np.abs(kth)), -np.inf)[:, None]
        a, b = np.nonzero(some)
        exact = (self.queries[q[a]] * self.vectors[rows[b]]).sum(axis=1)  # the same order of additions for equal vectors
        place = np.arange(len(a)) - np.searchsorted(a, np.arange(len(q)))[a]
        width = int(place.max()) + 1
        scores, found = np.full((len(q), width), -np.inf), np.full((len(q), width), np.iinfo(np.int64).max)
        scores[a, place], found[a, place] = exact, self.ids[rows[b]]
        scores, found = np.concatenate((self.scores[q], scores), axis=1), np.concatenate((self.found[q], found), axis=1)
        order = np.lexsort((found, -scores), axis=1)[:, : self.k]
        self.scores[q], self.found[q] = np.take_along_axis(scores, order, 1), np.take_along_axis(found, order, 1)


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    vectors = table.column("vector").combine_chunks()
    if isinstance(vectors, pa.ChunkedArray):
        vectors = pa.concat_arrays(vectors.chunks)
    return table.column("id").to_numpy(), vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _meet(k: int, factor: float, largest: float):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            empty = pa.array([], pa.int64())
            return pa.table({"query_id": empty, "vec_id": empty, "score": pa.array([], pa.float64())})
        order = pa.compute.sort_indices(rows.column("id"))  # the same tree in every run
        ids, vectors = _matrix(rows.take(order))
        again = np.concatenate(([False], (ids[1:] == ids[:-1]) & (vectors[1:] == vectors[:-1]).all(axis=1)))
        ids, vectors = ids[~again], vectors[~again]  # a repeated row counts once
        query_ids, points = _matrix(queries)
        s = Search(ids, vectors, query_ids, points, min(k, len(ids)), factor, largest)
        good = np.isfinite(s.scores)
        return pa.table({
            "query_id": np.repeat(query_ids, good.sum(axis=1)), "vec_id": s.found[good], "score": s.scores[good],
        })

    return run


def usable(column: str) -> Column:
    """Neither null nor empty nor zero, all components finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    x = F.col(column)
    return F.coalesce((F.size(x) > 0) & ~F.exists(x, bad) & F.exists(x, lambda v: v != 0), F.lit(False))


def nearest(rows: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of ``queries`` the k rows of largest inner product; both have (id, vector)."""
    if factor < 1:
        raise ValueError("a factor below 1 would only search more than an exact search does")
    clean = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where(
        F.col("id").isNotNull() & usable("vector")
    )
    kept, asked = clean(rows), clean(queries)
    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    facts = {r["dim"]: r for r in kept.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"), F.max(length).alias("m")).collect()}
    n_queries = asked.count()
    blocks = max(1, math.ceil(n_queries / block))
    n_shards = max([1, *(math.ceil(f["n"] / shard) for f in facts.values())])
    largest = math.sqrt(max([0.0, *(f["m"] for f in facts.values())])) * (1 + 1e-12)
    spread = lambda n, seed: F.pmod(F.xxhash64("id", "vector", F.lit(seed)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dim = F.size("vector").alias("dim")
    left = kept.select("id", "vector", dim, spread(n_shards, 1).alias("shard"), each(blocks).alias("block"))
    right = asked.select("id", "vector", dim, spread(blocks, 2).alias("block"), each(n_shards).alias("shard"))
    keys = ("dim", "shard", "block")
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_meet(k, factor, largest), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
