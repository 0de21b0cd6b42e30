"""A stored vector index: an inverted file of k-means cells, searched by partition pruning.

``build`` learns centroids on a bounded sample, gives every vector to its nearest one by cosine and writes the posting lists as Parquet
partitioned by cell.  A search looks up the cells nearest to the query in the small centroid table and reads only their partitions; with
all cells it reads everything and equals the exact search.  Rows without a direction (null, zero, or of another length than most) have a
cell of their own, -1, which only a search of all cells reads: their similarity is 0.

A build writes a new version and publishes it by one small file, so searches never see half of one.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from reelgraph.operators import knn
from reelgraph.sources import exchange

SAMPLE = 20_000
ROUNDS = 12


def spherical_means(points: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit points by k-means on cosine; an empty cell moves to the point farthest from its own centroid."""
    rng = np.random.default_rng(seed)
    centroids = points[rng.choice(len(points), min(cells, len(points)), replace=False)].copy()
    for _ in range(rounds):
        near = points @ centroids.T
        own, best = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        sizes = np.linalg.norm(sums, axis=1)
        for cell in np.flatnonzero(sizes == 0):
            far = int(best.argmin())
            sums[cell], sizes[cell], best[far] = points[far], 1.0, 2.0
        centroids = sums / sizes[:, None]
    return centroids


def _usable(dim: int):
    return (F.size("vector") == dim) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)


def _nearest_cell(centroids: np.ndarray):
    import pyarrow as pa

    matrix = centroids.astype("f4")

    def cell(batch):
        out = np.full(len(batch), -1, np.int32)
        rows = np.flatnonzero(np.asarray(batch.is_valid()))
        if len(rows):
            flat = batch.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1).astype("f4")
            out[rows] = (flat @ matrix.T).argmax(axis=1)
        return pa.array(out, pa.int32())

    cell.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    return F.arrow_udf(cell, T.IntegerType())


def build(vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE, rows_per_file: int = 500_000) -> int:
    """Index all rows of ``vectors`` (entry_id, vector, ...) under ``path``; returns the number of cells.

    ``cells`` defaults to the square root of the number of rows, at most 4,096.  The centroids come from the ``sample`` rows with the
    smallest hash of their id; every row is indexed.  A cell with very many rows is written by several tasks.
    """
    spark = vectors.sparkSession
    lengths = vectors.where("vector is not null").groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), "dim").first()
    dim, rows = (most["dim"], most["n"]) if most else (0, 0)
    cells = cells or max(1, min(4_096, round(rows**0.5)))
    good = vectors.where(_usable(dim))
    taken = good.select("vector", F.xxhash64("entry_id").alias("h")).orderBy("h", "vector").limit(sample).collect()  # a bounded sample
    points = np.array([r["vector"] for r in taken], dtype="f8").reshape(len(taken), dim)
    centroids = spherical_means(points / np.linalg.norm(points, axis=1, keepdims=True), cells) if len(taken) else np.zeros((0, dim))
    version = f"{path}/versions/{uuid.uuid4().hex}"
    cell = _nearest_cell(centroids)(F.when(_usable(dim), F.col("vector"))) if len(centroids) else F.lit(-1)
    placed = vectors.withColumn("cell", cell).hint("rebalance", "cell")
    placed.write.option("maxRecordsPerFile", rows_per_file).partitionBy("cell").parquet(f"{version}/postings")
    table = [(i, c.tolist()) for i, c in enumerate(centroids)]
    spark.createDataFrame(table, "cell int, centroid array<double>").coalesce(1).write.parquet(f"{version}/centroids")
    schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType())])
    exchange.write_text(spark, f"{path}/current", json.dumps({"version": version, "schema": schema.json()}))
    return len(centroids)


def _opened(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(postings, centroids) of the version in force."""
    if not exchange.exists(spark, f"{path}/current"):
        raise FileNotFoundError(f"no vector index in {path}")
    named = json.loads(exchange.read_text(spark, f"{path}/current"))
    schema = T.StructType.fromJson(json.loads(named["schema"]))
    return spark.read.schema(schema).parquet(f"{named['version']}/postings"), spark.read.parquet(f"{named['version']}/centroids")


def _closest(centroids: np.ndarray, query: np.ndarray, probes: int) -> np.ndarray:
    """The cells in the order of their centroids' nearness, ties by number."""
    return np.argsort(-(centroids @ query), kind="stable")[:probes]


def search(
    spark: SparkSession, path: str, query: Sequence[float] | None, k: int = 10, probes: int | None = None, threshold: float | None = 0.0,
    filters: dict | None = None,
) -> DataFrame:
    """The k most similar rows of the ``probes`` nearest cells; of all cells, and so exactly, without ``probes``."""
    postings, centroids = _opened(spark, path)
    if probes is not None and query is not None:
        table = sorted(centroids.collect(), key=lambda r: r["cell"])  # one row per cell
        if table and len(table[0]["centroid"]) == len(query):
            near = _closest(np.array([r["centroid"] for r in table]), np.array(query, dtype="f8"), probes)
            postings = postings.where(F.col("cell").isin(*[int(c) for c in near]))
    return knn.top_k(postings.drop("cell"), query, k, threshold, filters)


def _packed(entries: dict, names: list[str]):
    """Packed rows: the ids and their vectors as one run of bytes."""
    import pandas as pd

    rows = [(*key, [i for i, _ in held], np.stack([v for _, v in held]).tobytes()) for key, held in entries.items()]
    return pd.DataFrame(rows, columns=names)


def _pack(keys, names: list[str], size: int):
    """Rows to packed rows of at most ``size`` vectors; ``keys(frame)`` gives the keys that each row goes to."""

    def run(frames: Iterator) -> Iterator:
        held: dict = {}
        for frame in frames:
            for key, name, vector in keys(frame):
                own = held.setdefault(key, [])
                own.append((name, vector))
                if len(own) == size:
                    yield _packed({key: held.pop(key)}, names)
        if held:
            yield _packed(held, names)

    return run


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products, added from the first element to the last as ``vectors.dot`` does: equal vectors have equal scores."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j].astype("f8") * b[:, j]
    return total


def _cosines(products: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """As ``vectors.cosine``: 0 without a direction, and a value that is no number counts as 1."""
    with np.errstate(invalid="ignore", divide="ignore"):
        value = np.where(norms == 0, 0.0, products / norms)
    return np.clip(np.where(np.isnan(value), 1.0, value), -1.0, 1.0)


PACK, GROUP_ROWS, GROUP_QUERIES = 1_024, 131_072, 32_768
BLOCK, BLOCK_ROWS, PAIRS = 512, 4_096, 65_536
SLACK = 1e-9  # matrix products and sums in order differ by far less


def _best_of(asked: np.ndarray, rows: np.ndarray, names: list, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query place, row place, similarity) of each query's k best rows: products of blocks of both, exact sums for those near the k best.

    A block has at most ``BLOCK`` queries and ``BLOCK_ROWS`` rows, and exact sums are taken ``PAIRS`` at a time, so memory is bounded.
    """
    lengths, own = np.sqrt(_products(rows, rows)), np.sqrt(_products(asked, asked))
    by_name = np.empty(len(names), "i8")
    by_name[sorted(range(len(names)), key=lambda i: (names[i] is not None, names[i] or ""))] = np.arange(len(names))
    for at in range(0, len(asked), BLOCK):
        block = asked[at : at + BLOCK].astype("f8")
        n = len(block)
        floor = np.full(n, -np.inf)
        q, r, s = np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0)

        def keep(found_q, found_r, found_s):
            order = np.lexsort((by_name[found_r], -found_s, found_q))
            found_q, found_r, found_s = found_q[order], found_r[order], found_s[order]
            starts = np.searchsorted(found_q, found_q, side="left")
            top = np.arange(len(found_q)) - starts < k
            return found_q[top], found_r[top], found_s[top]

        for low in range(0, len(rows), BLOCK_ROWS):
            part = rows[low : low + BLOCK_ROWS].astype("f8")
            with np.errstate(invalid="ignore", over="ignore"):
                near = _cosines(block @ part.T, own[at : at + n, None] * lengths[None, low : low + len(part)])
            if len(part) > k and np.isinf(floor).any():
                floor = np.maximum(floor, np.partition(near, len(part) - k, axis=1)[:, len(part) - k])
            hit_q, hit_r = np.nonzero(near >= (floor - SLACK)[:, None])
            for cut in range(0, len(hit_q), PAIRS):
                a, b = hit_q[cut : cut + PAIRS], hit_r[cut : cut + PAIRS] + low
                with np.errstate(invalid="ignore", over="ignore"):
                    exact = _cosines(_products(asked[at + a], rows[b]), own[at + a] * lengths[b])
                q, r, s = keep(np.concatenate([q, a]), np.concatenate([r, b]), np.concatenate([s, exact]))
            counts = np.bincount(q, minlength=n)
            last = np.cumsum(counts) - 1
            full = counts == k
            floor[full] = np.maximum(floor[full], s[last[full]])
        yield q + at, r, s


def search_many(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, probes: int = 8) -> DataFrame:
    """(query_id, rank, entry_id, similarity) for every row of ``queries`` (query_id, vector), each in its own ``probes`` nearest cells.

    Vectors travel packed, ``PACK`` to a row.  About ``GROUP_QUERIES`` queries meet about ``GROUP_ROWS`` rows of a cell in one group, so a
    group is bounded, a large cell is many groups, and each gives k rows a query.  Pairs are as many as the search has: with all cells
    probed, queries times rows.
    """
    import pyarrow as pa

    postings, centroids = _opened(spark, path)
    table = sorted(centroids.collect(), key=lambda r: r["cell"])
    kind = queries.schema["query_id"].dataType.simpleString()
    if not table:
        return spark.createDataFrame([], f"query_id {kind}, rank int, entry_id string, similarity double")
    matrix = np.array([r["centroid"] for r in table])
    dim = matrix.shape[1]
    code = "f8" if postings.schema["vector"].dataType == T.ArrayType(T.DoubleType(), postings.schema["vector"].dataType.containsNull) else "f4"
    sizes = {r["cell"]: r["n"] for r in postings.where("cell >= 0").groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
    parts = {cell: -(-n // GROUP_ROWS) for cell, n in sizes.items()}
    shares = max(1, -(-queries.count() * min(probes, len(table)) // (len(table) * GROUP_QUERIES)))

    def probed(frame):
        for name, vector in zip(frame["query_id"], frame["vector"], strict=True):
            if vector is not None and len(vector) == dim:
                vector = np.asarray(vector, dtype="f4")
                share = zlib.crc32(str(name).encode()) % shares
                for cell in _closest(matrix, vector.astype("f8"), probes):
                    for part in range(parts.get(int(cell), 0)):
                        yield (int(cell), part, share), name, vector

    def stored(frame):
        for name, vector, cell, part in zip(frame["entry_id"], frame["vector"], frame["cell"], frame["part"], strict=True):
            yield (int(cell), int(part)), name, np.asarray(vector, dtype=code)

    asked = queries.select("query_id", F.col("vector").cast("array<float>").alias("vector")).mapInPandas(
        _pack(probed, ["cell", "part", "share", "ids", "vectors"], PACK), f"cell int, part int, share int, ids array<{kind}>, vectors binary"
    )
    counts = F.create_map(*[F.lit(x) for pair in sorted(parts.items()) for x in pair])
    rows = postings.where("cell >= 0").select(
        "entry_id", "vector", "cell",
        F.pmod(F.xxhash64("entry_id"), F.try_element_at(counts, F.col("cell"))).cast("int").alias("part"),
    ).mapInPandas(_pack(stored, ["cell", "part", "ids", "vectors"], PACK), "cell int, part int, ids array<string>, vectors binary")
    rows = rows.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))

    def unpacked(packed, kind):
        joined = b"".join(v.as_py() for v in packed["vectors"])
        return packed["ids"].combine_chunks().flatten(), np.frombuffer(joined, dtype=kind).reshape(-1, dim)

    schema = T.StructType([queries.schema["query_id"], T.StructField("entry_id", T.StringType()), T.StructField("similarity", T.DoubleType())])

    def best(left, right):
        ids, wanted = unpacked(left, "f4")
        names, vectors_ = unpacked(right, code)
        found = list(_best_of(wanted, vectors_, names.to_pylist(), k)) if len(wanted) and len(vectors_) else []
        q, r, s = (np.concatenate([f[i] for f in found]) if found else np.empty(0, "i8" if i < 2 else "f8") for i in range(3))
        return pa.table({"query_id": ids.take(pa.array(q)), "entry_id": names.take(pa.array(r)), "similarity": pa.array(s)})

    keys = ["cell", "part", "share"]
    scored = asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(best, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "entry_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "entry_id", "similarity")
