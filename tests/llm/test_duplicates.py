"""Substring dedup, Jaccard join and components against brute force."""

import random

import pytest

from reelgraph.llm import jaccard_join, substring_dedup
from reelgraph.llm.components import components


def words(text):
    return (text or "").encode().split()


def brute_removal(rows, window):
    first = {}
    for doc, text, *_ in rows:
        w = words(text)
        if doc is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i : i + window])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text, *_ in rows:
        w = words(text)
        gone = [False] * len(w)
        if doc is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < doc:
                    gone[i : i + window] = [True] * window
        out.append((doc, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "prefix", "limit"), [(50, 16, 20_000), (50, 16, 3), (12, 5, 2), (5, 5, 100)])
def test_removal(docs, rows, window, prefix, limit):
    made = substring_dedup.remove_repeats(docs, window, prefix, limit)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in made.collect()), key=str)
    assert got == brute_removal(rows, window)
    assert made.select("rest.spans", "rest.key").count() == len(rows)


def test_frequent_prefixes_are_dealt_over_all_tasks(spark, monkeypatch):
    """One passage in a third of all documents, and half of all prefixes frequent: the same result, no task with the whole key."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    hot = [f"h{i}" for i in range(20)]
    rows = []
    for k in range(150):
        own = [f"w{rng.randrange(9)}" for _ in range(rng.randrange(30))]
        rows.append((k, " ".join(own + hot + own[:4] if k % 3 == 0 else own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for heavy in (2, 40, 1_000):
        monkeypatch.setattr(substring_dedup, "HEAVY", heavy)
        made = substring_dedup.remove_repeats(docs, 12, 5, 10)
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in made.collect()), key=str) == brute_removal(rows, 12)
    anchors = spark.range(0, 20_000, 1, 4).select(
        F.col("id").alias("__id"), F.lit(1).cast("long").alias("__fp"), F.lit(0).alias("at"), F.when(F.col("id") % 3 > 0, F.floor(F.col("id") / 6)).otherwise(-1).alias("key")
    )
    shared = anchors.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("long", F.col("n") > 100)
    monkeypatch.setattr(substring_dedup, "HEAVY", 1_000)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = substring_dedup._shared_places(anchors, shared, 20_000)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert got.where("long").count() == anchors.where("key = -1").count() and max(sizes) < 2 * sum(sizes) / len(sizes)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_removal_of_nothing(no_docs):
    assert substring_dedup.remove_repeats(no_docs).collect() == []


def test_tree_groups_end_at_keys():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    base = rng.integers(0, 9, 40).astype(np.uint64)
    rows = []
    for key in range(30):
        for doc in range(4):
            seq = np.concatenate((base[key % 5 : key % 5 + 8], rng.integers(0, 9, 3).astype(np.uint64)))
            rows.append((key, doc, 0, 0, seq.tobytes()))
    frame = pd.DataFrame(rows, columns=["key", "__id", "__fp", "start", "words"])
    whole = pd.concat(substring_dedup._subtrees(6)(iter([frame])))
    parts = pd.concat(substring_dedup._subtrees(6, budget=60)(frame.iloc[i : i + 7] for i in range(0, len(frame), 7)))
    # keys share content here, so only marks that need one key alone are compared
    per_key = pd.concat([substring_dedup._tree_marks(g, 6) for _, g in frame.groupby("key")])
    assert set(map(tuple, per_key.to_numpy())) <= set(map(tuple, parts.to_numpy())) <= set(map(tuple, whole.to_numpy()))


def brute_components(rows, n, num, den):
    sets = {}
    sizes = []
    for doc, text, *_ in rows:
        w = (text or "").encode().lower().split()
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
        sizes.append((doc, len(grams)))
        if doc is not None:
            sets.setdefault(doc, []).append(grams)
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(x and y and den * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted(((d, k, None if d is None else find(d)) for d, k in sizes), key=str)


@pytest.mark.parametrize(("n", "num", "den"), [(5, 75, 100), (1, 60, 100), (3, 100, 100)])
def test_jaccard(docs, rows, n, num, den):
    made = jaccard_join.jaccard_components(docs, n, num, den, bits=12 + 4)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in made.collect()), key=str)
    assert got == brute_components(rows, n, num, den)


def test_jaccard_with_salts_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SALT_ABOVE", 5)
    monkeypatch.setattr(jaccard_join, "RUN_BLOCK", 4)
    rng = random.Random(5)
    common = [f"c{i}" for i in range(30)]
    rows = []
    for k in range(60):
        text = common[: 20 + rng.randrange(10)] + [f"u{k}_{i}" for i in range(rng.randrange(8))]
        rows.append((k + 1, " ".join(text)))
    made = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 2)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in made.collect()), key=str)
    assert got == brute_components(rows, 2, 75, 100)


def test_jaccard_of_nothing(no_docs):
    assert jaccard_join.jaccard_components(no_docs).collect() == []


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, k) for k in range(5001, 5400)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_jaccard_links_rows_of_different_salts(spark, monkeypatch):
    """Two documents whose common n-grams are salted apart, so that each stands alone in its run."""
    monkeypatch.setattr(jaccard_join, "SALT_ABOVE", 1)
    rows = [(k, " ".join([f"p{k // 2}_{i}" for i in range(30)] + [f"own{k}"])) for k in range(20)]
    made = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in made.collect()), key=str)
    assert got == brute_components(rows, 2, 75, 100)


def brute_links(rows, n, num, den):
    sets = {}
    for doc, text, *_ in rows:
        w = (text or "").encode().lower().split()
        if doc is not None:
            sets.setdefault(doc, []).append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    links = {d: 0 for d in sets}
    for a in sets:
        for b in sets:
            links[a] += a != b and any(x and y and den * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b])
    return sorted(((doc, links.get(doc, 0)) for doc, *_ in rows), key=str)


def counted_links(docs, n, **more):
    return sorted(((r.doc_id, r.n_links) for r in jaccard_join.jaccard_components(docs, n, bits=16, **more).collect()), key=str)


def test_jaccard_counts_every_link(spark, monkeypatch):
    """Copies and near copies of several texts, some ids with several texts; blocks of about three sets."""
    monkeypatch.setattr(jaccard_join, "SETS", 3)
    monkeypatch.setattr(jaccard_join, "_COLUMNS", 7)
    rng = random.Random(6)
    bases = [[f"b{g}_{i}" for i in range(40)] for g in range(3)]
    rows = []
    for k in range(90):
        text = list(bases[k % 3])
        for _ in range(rng.randrange(4)):
            text[rng.randrange(40)] = f"x{rng.randrange(6)}"
        rows.append((k, " ".join(text)))
    rows += [(k + 100, rows[k][1]) for k in range(0, 60, 4)]  # exact copies
    plain = list(rows)
    for k in (3, 4, 50):  # ids with several texts, of one group and of two
        rows += [(k, " ".join(bases[0])), (k, " ".join(bases[k % 3][:38] + ["y"])), (k, rows[10][1])]
    rows += [(500, ""), (3, None), (None, rows[0][1]), (501, "alone here")]
    for some in (plain, rows):
        docs = spark.createDataFrame(some, "doc_id long, text string").repartition(5)
        assert counted_links(docs, 2) == brute_links(some, 2, 75, 100)


def test_jaccard_counts_links_of_the_fixture(docs, rows):
    assert counted_links(docs, 5) == brute_links(rows, 5, 75, 100)
    assert counted_links(docs.coalesce(1), 5) == brute_links(rows, 5, 75, 100)


def test_jaccard_triangle_has_three_links(spark):
    rows = [(k, " ".join([f"t{i}" for i in range(40)] + [f"own{k}"])) for k in range(3)]
    assert counted_links(spark.createDataFrame(rows, "doc_id long, text string"), 2) == [(0, 2), (1, 2), (2, 2)]
