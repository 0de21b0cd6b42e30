"""Retrieval: contexts, ranking rules, caching and conversations."""

import random

import pytest
from pyspark.sql import functions as F

from reelgraph.config import RetrievalSettings
from reelgraph.operators import conversation as cv, knn, ranking
from reelgraph.plans import retrieval as R
from reelgraph.sources import driver_tables as dt
from reelgraph.workload import retrieval as W


def test_understand(spark):
    c = R.understand(spark, "  Show the   red*dog at the START, long ")
    assert c.processed == "Show the reddog at the START, long" and c.query_type == "visual"
    assert c.keywords == ("show", "reddog", "start", "long") and (c.time_preference, c.duration_preference) == ("early", "long")
    assert not R.understand(spark, "a b").may_name_entities


def results(spark, rows):
    return spark.createDataFrame(rows, "result_id string, video_id string, relevance double").withColumn("result_type", F.lit("frame"))


def _diverse(rows, per_video=3, min_rows=5, cap=30):
    rows = sorted(rows, key=lambda r: (-r[2], r[0]))
    if len(rows) <= min_rows:
        return [r[0] for r in rows]
    out, used = [], {}
    for r in rows:
        if r[1] is not None and used.get(r[1], 0) >= per_video:
            continue
        used[r[1]] = used.get(r[1], 0) + 1
        out.append(r[0])
        if len(out) >= cap:
            break
    return out


@pytest.mark.parametrize("n,videos", [(4, 1), (5, 1), (6, 1), (7, 2), (200, 3), (400, 60), (120, 0)])
def test_diversify_equals_one_by_one(spark, n, videos):
    rng = random.Random(n)
    rows = [(f"r{i:03d}", f"v{rng.randrange(videos)}" if videos and rng.random() < 0.9 else None, rng.randrange(50) / 50) for i in range(n)]
    got = [r["result_id"] for r in ranking.diversify(results(spark, rows)).orderBy(F.desc("relevance"), "result_id").collect()]
    assert got == _diverse(rows)


def test_ranks(spark):
    rng = random.Random(1)
    rows = [(f"r{i}", "v", rng.choice([0.0, 0.25, 0.5, 0.500001, 1.0])) for i in range(80)]
    want = {r[0]: 1 + sum(o[2] > r[2] for o in rows) for r in rows}
    df = results(spark, rows)
    assert {r["result_id"]: r["rank"] for r in ranking.competition_rank(df, "relevance", 7).collect()} == want
    assert {r["result_id"]: r["rank"] for r in ranking.rank_page(df).collect()} == want


def test_merge_keeps_single_scores_and_blends_repeats(spark):
    cols = "leg int, result_type string, result_id string, relevance double, text_score double, visual_score double, entity_score double, explanation string, content string"
    rows = [(1, "entity", "e", 0.9, 0.9, 0.0, 0.0, "Entity match", "cat"), (3, "entity", "e", 0.8, 0.0, 0.0, 0.8, "Entity", "cat"), (1, "frame", "f", 0.75, 0.75, 0.0, 0.0, "Dog", None)]
    df = spark.createDataFrame(rows, cols).select("*", *[F.lit(None).cast(t).alias(n) for n, t in (("video_id", "string"), ("at", "double"), ("until", "double"))])
    got = {r["result_id"]: r for r in ranking.merge_duplicates(df, keywords=("cat", "dog")).collect()}
    assert round(got["e"]["relevance"], 6) == round(0.9 * 0.4 + 0.8 * 0.2, 6) and got["f"]["relevance"] == 0.75
    assert got["e"]["explanation"] == "Entity match" and got["e"]["keywords_matched"] == ["cat"] and got["f"]["keywords_matched"] == ["dog"]
    assert ranking.explanations_of(df, df.select("result_type", "result_id").distinct()).count() == 3


def test_judge(spark):
    df = results(spark, [(f"r{i}", "v", 1 - i / 10) for i in range(8)]).withColumn("explanation", F.lit("x"))
    assert ranking.judge_page(df, lambda d: [1, 0, 1], 0.6).count() == 7
    with pytest.warns(UserWarning, match="judge failed"):
        assert ranking.judge_page(df, lambda d: 1 / 0, 0.6).count() == 5
    assert ranking.judge_page(df, None, use_judge=False).count() == 8


def test_strategies(spark, sf):
    store = W._store(spark, sf)
    s = RetrievalSettings(similarity_threshold=0.2, confidence_threshold=0.1)
    vec = knn.lookup_vector(store.vectors, "0")
    for strategy in R.STRATEGIES:
        rows = R.retrieve(store, "red", strategy, embed=lambda _: vec, settings=s).collect()
        assert rows and [r["rank"] for r in rows] == sorted(r["rank"] for r in rows) and len(rows) <= 10
    assert R.retrieve(store, "red", "visual", embed=lambda _: None, settings=s).count() == 0
    with pytest.raises(ValueError):
        R.retrieve(store, "red", "other")


def test_vector_edge_cases(spark):
    rows = [("a", [1.0, 0.0]), ("z", [0.0, 0.0]), ("n", None), ("w", [1.0, 2.0, 3.0]), ("b", [0.6, 0.8])]
    v = spark.createDataFrame(rows, "entry_id string, vector array<float>")
    got = {r["entry_id"]: round(r["similarity"], 6) for r in knn.batch_similarity(v, [1.0, 0.0]).collect()}
    assert got == {"a": 1.0, "z": 0.0, "n": 0.0, "w": 0.0, "b": 0.6}
    same = v.filter("entry_id = 'a'")
    assert knn.batch_similarity(same, [1.0, 0.0], "euclidean").first()["similarity"] == 0.0
    assert knn.top_k(v.filter("false"), [1.0, 0.0]).count() == 0
    hits = knn.lsh_top_k(v.filter("size(vector) = 2 and entry_id <> 'z'"), [1.0, 0.0], 2).collect()
    assert [h["entry_id"] for h in hits][0] == "a"


def test_cache(spark):
    now = [0.0]
    cache = R.ResponseCache(RetrievalSettings(cache_size=4, cache_ttl_seconds=10), clock=lambda: now[0])
    for i in range(4):
        now[0] = i
        cache.put(f"k{i}", spark.range(i))
    assert cache.get("k0").count() == 0
    cache.put("k4", spark.range(9))
    assert cache.get("k0") is None and cache.get("k4") is not None and cache.stats()["entries"] == 4
    now[0] = 50
    assert cache.get("k4") is None
    cache.clear()
    assert cache.stats()["entries"] == 0


def test_conversation(spark, sf):
    frames = dt.frames(spark, sf)
    opening = cv.start_conversation(frames.limit(5), "chat_1_0001", 1.0, "ctx")
    assert [r["role"] for r in opening.collect()] == ["system", "system"]
    seen = []
    turn = cv.chat_turn(opening, frames, "chat_1_0001", "what?", 2.0, lambda m: seen.append(m) or "ok", ["3"])
    assert [(r["seq"], r["role"], r["content"]) for r in turn.orderBy("seq").collect()] == [(2, "user", "what?"), (3, "assistant", "ok")]
    assert "Frame ID: 3" in seen[0][0]["content"] and seen[0][-1] == {"role": "user", "content": "what?"}
    log = opening.unionByName(turn)
    assert cv.recent_context(log).first()["context"] == "User asked: what?... | Assistant responded about: ok..."
    assert cv.recent_context(opening).first()["context"] == "No previous conversation context."
    many = spark.range(60).select(F.lit("c").alias("conversation_id"), F.col("id").alias("seq"), F.when(F.col("id") < 3, "system").otherwise("user").alias("role"), F.lit("x").alias("content"), F.lit(0.0).alias("timestamp"))
    kept = [r["seq"] for r in cv.trim(many).orderBy("seq").collect()]
    assert kept == [0, 1, 2] + list(range(35, 60))
    assert cv.trim(many.filter("seq < 50")).count() == 50


def test_rank_fills_all_ranges_wherever_the_scores_lie(spark):
    import random

    rng = random.Random(9)
    for scores in ([0.5 + rng.randrange(900) / 10**6 for _ in range(3_000)], [rng.randrange(5_000) * 10.0 - 9_000 for _ in range(3_000)], [2.0] * 50 + [None] * 9, []):
        rows = spark.createDataFrame(list(enumerate(scores)), "k long, s double")
        got = {r.k: r.rank for r in ranking.competition_rank(rows, "s", 8).collect()}
        order = [-s if s is not None else 10**9 for s in scores]
        firsts = {}
        for place, value in enumerate(sorted(order), 1):
            firsts.setdefault(value, place)
        assert got == {k: firsts[v] for k, v in enumerate(order)}


def test_the_judge_drops_rows_before_they_are_ranked(spark):
    shape = "result_type string, result_id string, video_id string, relevance double, explanation string"
    rows = spark.createDataFrame([("clip", str(i), f"v{i}", 0.9 - i / 100, f"text {i}") for i in range(6)], shape)
    seen = []

    def judge(texts):
        seen.extend(texts)
        return [0 if "text 0" in t else 1 for t in texts]

    out = {r["result_id"]: r["rank"] for r in ranking.post_process(rows, judge=judge).collect()}
    assert out == {"1": 1, "2": 2, "3": 3, "4": 4, "5": 5} and len(seen) == 6
    assert {r["result_id"]: r["rank"] for r in ranking.post_process(rows).collect()}["0"] == 1


def test_video_content(spark):
    from reelgraph.operators import conversation as cv

    span = "start_time double, end_time double"
    chunks = spark.createDataFrame([("c1", "v1", 0.0, 30.0, "a cat"), ("c2", "v1", 30.0, 60.0, None), ("c3", "v2", 0.0, 1.0, "")], f"chunk_id string, video_id string, {span}, unified_description string")
    audio = spark.createDataFrame([("c1", "v1", 0.0, 30.0, "meow"), ("c2", "v1", 30.0, 60.0, None), ("c3", "v2", 0.0, 1.0, "")], f"chunk_id string, video_id string, {span}, transcript string")
    entities = spark.createDataFrame([("e1", "Cat", "OBJECT", "a pet", 0.9), ("e2", "Tom", "PERSON", None, 0.8)], "entity_id string, name string, entity_type string, description string, confidence double")
    seen = spark.createDataFrame([("e1", "v1"), ("e1", "v1"), ("e2", "v2"), ("e9", "v1")], "entity_id string, video_id string")
    rows = sorted((r.video_id, r.section, r.item_id, r.content) for r in cv.video_content(chunks, audio, entities, seen).na.fill("-", ["content"]).collect())
    assert rows == [
        ("v1", "chunk", "c1", "a cat"), ("v1", "chunk", "c2", "-"), ("v1", "entity", "e1", "Cat (OBJECT): a pet"), ("v1", "transcript", "c1", "meow"),
        ("v2", "chunk", "c3", ""), ("v2", "entity", "e2", "Tom (PERSON)"),
    ]
    assert cv.video_content(chunks, audio, entities, seen, "v2").count() == 2
    assert cv.video_content(chunks, audio).count() == 4
