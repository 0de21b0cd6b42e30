"""Scalar functions on hand-computed values."""

import math
import re

import pytest
from pyspark.sql import functions as F

from reelgraph.functions import clock, ids, text, vectors


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_timestamp_to_seconds(spark):
    rows = spark.createDataFrame(
        [("01:30:45", 5445.0), ("30:45", 1845.0), ("45", 45.0), ("3645.0", 3645.0), ("1:2:3:4", 0.0), ("abc", 0.0), ("a:10", 0.0), (None, 0.0)],
        "t string, want double",
    )
    for r in rows.select("want", clock.timestamp_to_seconds(F.col("t")).alias("got")).collect():
        assert r["got"] == r["want"]


def test_seconds_to_timestamp(spark):
    r = one(spark, clock.seconds_to_timestamp(F.lit(5445.0)), clock.seconds_to_timestamp(F.lit(65.25)), clock.seconds_to_timestamp(F.lit(10.0), True))
    assert list(r) == ["01:30:45.000", "01:05.250", "00:00:10.000"]


def test_cosine_and_distance(spark):
    def v(*x):
        return F.array(*[F.lit(float(i)) for i in x]).cast("array<float>")

    r = one(
        spark, vectors.cosine(v(1, 0, 0), v(1, 0, 0)), vectors.cosine(v(1, 0, 0), v(0, 1, 0)), vectors.cosine(v(0, 0), v(1, 1)),
        vectors.cosine(v(1), v(1, 1)), vectors.euclidean(v(0, 0), v(3, 4)), vectors.euclidean(v(1), v(1, 1)),
    )
    assert list(r) == [1.0, 0.0, 0.0, 0.0, 5.0, math.inf]


def test_resample_and_fuse(spark):
    np = pytest.importorskip("numpy")
    a = [1.0, 3.0, 2.0, 8.0]
    got = one(spark, vectors.resample(F.array(*[F.lit(x) for x in a]), F.lit(7)))[0]
    assert np.allclose(got, np.interp(np.linspace(0, 4, 7), np.arange(4), a))
    fused = one(spark, vectors.fuse_chunk_embedding(F.array(F.lit(3.0), F.lit(4.0)).cast("array<float>"), F.lit(None).cast("array<float>")))[0]
    assert fused == [0.6, 0.8]
    none = F.lit(None).cast("array<float>")
    assert one(spark, vectors.fuse_chunk_embedding(none, none))[0] is None


def test_string_similarity(spark):
    r = one(
        spark, text.string_similarity(F.lit("John Smith"), F.lit("john smith")), text.string_similarity(F.lit("John Smith"), F.lit("Jane Doe")),
        text.string_similarity(F.lit(""), F.lit("")), text.string_similarity(F.lit(""), F.lit("a")),
    )
    assert [round(x, 6) for x in r] == [0.8, 0.2, 1.0, 0.0]


def test_normalize_keeps_letters_of_all_scripts(spark):
    r = one(spark, text.normalize_text(F.lit("  Añb\t\n é_ü!  (x) – y? 中 ")), text.normalize_text(F.lit(None).cast("string")))
    assert r[0] == "Añb é_ü! x  y? 中" and r[1] == ""


def test_keywords_order_and_ties(spark):
    t = F.lit("The dog saw a cat. CAT ran, dog ran, bird sat in état e3e")
    assert one(spark, text.extract_keywords(t, 4))[0] == ["dog", "cat", "ran", "saw"]
    assert one(spark, text.extract_keywords(F.lit(""), 4))[0] == []


def test_text_relevance(spark):
    r = one(
        spark,
        text.text_relevance("red car", F.lit("A RED car"), ["red", "car"]),
        text.text_relevance("red car", F.lit("car park"), ["red", "car"]),
        text.text_relevance("red car", F.lit(""), ["red"]),
        text.text_relevance("red", F.lit("blue"), []),
    )
    assert round(r[0], 6) == round(min(1.0, max(0.8, 0.6 + 0.4 * 2 / 3)), 6)
    assert round(r[1], 6) == round(0.3 + 0.4 / 3, 6)
    assert r[2] == 0.0 and r[3] == 0.0


def test_query_classes(spark):
    def kind(q, n=1):
        return one(spark, text.query_type(F.lit(q), F.lit(n)))[0]

    assert kind("show me") == "visual" and kind("who is it") == "entity" and kind("weekend") == "temporal"
    assert kind("cats", 4) == "hybrid" and kind("cats") == "text"
    r = one(spark, text.time_preference(F.lit("at the END")), text.duration_preference(F.lit("a brief one")), text.time_preference(F.lit("x")))
    assert list(r) == ["late", "short", None]


def test_unified_description(spark):
    caps = F.array(*[F.lit(c) for c in ("a", "", "b", "c", "d")])
    none = F.array().cast("array<string>")
    r = one(spark, text.unified_description(caps, F.lit("hi")), text.unified_description(none, F.lit("x" * 300)), text.unified_description(none, F.lit("")))
    assert r[0] == "Visual: a | b | c || Audio: hi"
    assert r[1] == "Audio: " + "x" * 200 and r[2] == text.NO_CONTENT


def test_numbered_descriptions(spark):
    t = "intro\n1. First: item\ncontinues\n\n2. second one\n3) not. new"
    got = one(spark, text.numbered_descriptions(F.lit(t), 5))[0]
    assert got == ["intro", "item continues", "second one", "new", "Description parsing failed"]
    assert one(spark, text.numbered_descriptions(F.lit(t), 1))[0] == ["intro"]


def test_ids(spark):
    import hashlib

    r = one(spark, ids.entity_id(F.lit("Red Car!*"), F.lit("OBJECT")), ids.relation_id(F.lit("a"), F.lit("b"), F.lit("USES")), ids.frame_id(ids.chunk_id(F.lit("v"), F.lit(3)), F.lit(12)))
    assert r[0] == hashlib.md5(b"OBJECT_red car!").hexdigest()[:16]
    assert r[1] == hashlib.md5(b"a_USES_b").hexdigest()[:16]
    assert r[2] == "v_chunk_0003_frame_0012"


def test_epoch_seconds_ignores_session_time_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", z)
            stamp = F.lit("2024-01-01 00:00:07.179575").cast("timestamp_ntz")
            assert abs(one(spark, clock.epoch_seconds(stamp))[0] - 1704067207.179575) < 1e-6
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_keywords_of_a_batch_equal_counting_row_by_row(spark):
    import random

    rng = random.Random(4)
    pool = ["the", "cat", "Dog", "house", "x", "ab", "été", "a1b", "snake_case", "on-line", "RUN", "run", "ça", "und"]
    rows = [(k, None if k % 19 == 0 else "" if k % 23 == 0 else "  ".join(rng.choice(pool) + rng.choice(["", ",", ".", "!"]) for _ in range(rng.randrange(60)))) for k in range(300)]

    def plain(value):
        order = []
        for word in re.findall(r"(?<!\w)[a-z]{3,}(?!\w)", (value or "").lower()):
            if word not in text.STOPWORDS:
                order.append(word)
        return sorted(dict.fromkeys(order), key=lambda w: (-order.count(w), order.index(w)))[:3]

    got = spark.createDataFrame(rows, "k long, t string").select("k", text.extract_keywords(F.col("t"), 3).alias("w")).collect()
    assert {r.k: r.w for r in got} == {k: plain(t) for k, t in rows}
