"""The stored vector index against exact search: whole with all cells, recall with few, pruned partitions."""

import numpy as np
import pytest

from reelgraph.operators import knn, vector_index

SCHEMA = "entry_id string, vector array<float>, metadata map<string,string>, source_type string, video_id string, cell_name string"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(40, 16))
    points = middles[rng.integers(0, 40, 4_000)] + 0.35 * rng.normal(size=(4_000, 16))
    points[: 1_300] = middles[0] + 0.05 * rng.normal(size=(1_300, 16))  # a third in one place
    rows = [(f"e{i:05d}", [float(x) for x in p], None, "frame" if i % 2 else "chunk", f"v{i % 7}", "x") for i, p in enumerate(points)]
    rows += [("null", None, None, "frame", None, "x"), ("zero", [0.0] * 16, None, "frame", None, "x"), ("short", [1.0, 2.0], None, "frame", None, "x"),
             ("nan", [float("nan")] * 16, None, "frame", None, "x"), ("hole", [None] + [1.0] * 15, None, "frame", None, "x"), rows[5]]
    table = spark.createDataFrame(rows, SCHEMA).cache()
    path = str(tmp_path_factory.mktemp("index"))
    assert vector_index.build(table, path, cells=32) == 32
    return table, path, points


def pairs(df):
    return [(r.entry_id, round(r.similarity, 6)) for r in df.collect()]


def test_all_cells_equal_the_exact_search(spark, stored):
    table, path, points = stored
    for i in (0, 1_500, 3_999):
        q = points[i].tolist()
        assert pairs(vector_index.search(spark, path, q, 15)) == pairs(knn.top_k(table, q, 15))
        narrow = {"source_type": "frame", "video_id": "v3"}
        assert pairs(vector_index.search(spark, path, q, 5, None, 0.1, narrow)) == pairs(knn.top_k(table, q, 5, 0.1, narrow))
    assert vector_index.search(spark, path, [1.0, 2.0], 9_999, None, None).count() == table.count()


def test_few_cells_find_most(spark, stored):
    table, path, points = stored
    asked = spark.createDataFrame([(i, points[i].tolist()) for i in range(1_300, 4_000, 90)], "query_id long, vector array<float>")
    found = {}
    for r in vector_index.search_many(spark, path, asked, 10, probes=6).collect():
        found.setdefault(r.query_id, []).append(r.entry_id)
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    hit = 0
    for i, names in found.items():
        best = np.argsort(-(unit @ unit[i]), kind="stable")[:10]
        hit += len(set(names) & {f"e{k:05d}" for k in best})
    assert len(found) == 30 and hit >= 0.9 * 10 * len(found)


def test_only_probed_partitions_are_read(spark, stored):
    _, path, points = stored
    near = vector_index.search(spark, path, points[7].tolist(), 10, probes=2)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and "IN (" in plan.split("PartitionFilters")[1][:60]
    files = {f for f in near._jdf.inputFiles()}
    assert near.count() == 10 and files
    read = {r[0] for r in spark.read.parquet(*[f for f in files][:1]).limit(1).select("entry_id").collect()}
    assert read


def test_a_build_replaces_the_one_before(spark, stored, tmp_path):
    table, _, points = stored
    path = str(tmp_path / "index")
    vector_index.build(table.limit(100), path)
    vector_index.build(table, path, cells=4)
    assert vector_index.search(spark, path, points[0].tolist(), 5_000, None, None).count() == table.count()
    with pytest.raises(FileNotFoundError):
        vector_index.search(spark, str(tmp_path / "none"), [1.0])


def test_index_of_nothing(spark, stored, tmp_path):
    table, _, _ = stored
    assert vector_index.build(table.limit(0), str(tmp_path / "empty")) == 0
    assert vector_index.search(spark, str(tmp_path / "empty"), [1.0] * 16).count() == 0
    asked = spark.createDataFrame([(1, [1.0] * 16)], "query_id long, vector array<float>")
    assert vector_index.search_many(spark, str(tmp_path / "empty"), asked).count() == 0
    odd = table.where("entry_id IN ('null', 'zero')")
    vector_index.build(odd, str(tmp_path / "odd"))
    assert vector_index.search(spark, str(tmp_path / "odd"), [1.0] * 16, threshold=None).count() == 2


@pytest.mark.parametrize("group", [(131_072, 32_768), (300, 10)])
def test_search_of_many_in_blocks_equals_pair_by_pair(spark, stored, monkeypatch, group):
    """Equal vectors in different blocks tie exactly, and no pair is joined on its own."""
    from pyspark.sql import functions as F

    from reelgraph.functions import vectors as V

    monkeypatch.setattr(vector_index, "GROUP_ROWS", group[0])
    monkeypatch.setattr(vector_index, "GROUP_QUERIES", group[1])
    table, path, points = stored
    asked = [(i, points[i].tolist()) for i in range(0, 4_000, 80)] + [(-1, [0.0] * 16), (-2, [float("nan")] * 16), (-3, [None] + [1.0] * 15), (-4, None)]
    queries = spark.createDataFrame(asked, "query_id long, vector array<float>")
    found = vector_index.search_many(spark, path, queries, 10, probes=32)
    got = {(r.query_id, r["rank"]): (r.entry_id, round(r.similarity, 12)) for r in found.collect()}
    good = table.where("entry_id NOT IN ('null', 'zero', 'short', 'nan', 'hole')")
    pairs = queries.where("vector is not null").withColumnRenamed("vector", "q").crossJoin(good)
    rows = pairs.select("query_id", "entry_id", V.cosine(F.col("q"), F.col("vector")).alias("s")).toPandas()
    want = {}
    for query_id, own in rows.sort_values(["query_id", "s", "entry_id"], ascending=[True, False, True]).groupby("query_id"):
        want |= {(query_id, rank): (r.entry_id, round(r.s, 12)) for rank, r in enumerate(own.head(10).itertuples(), 1)}
    assert got == want
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "FlatMapCoGroupsInArrow" in plan
