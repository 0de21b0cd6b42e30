"""Changes merged as they are read: equal to rewriting everything, all or nothing, small, and compacted later."""

import random

import pytest

from reelgraph.sources import delta_store as store, graph_commits

SCHEMAS = {"items": "id string, video_id string, n int", "notes": "id string, video_id string"}
KEYS = {"items": "id", "notes": "id"}


def items(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMAS["items"]).coalesce(1)


def ids(spark, *values, name="video_id"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string").coalesce(1)


def read(spark, path, table="items", commit=None):
    return sorted((tuple(r) for r in store.load(spark, path, SCHEMAS, commit)[table].collect()), key=repr)


def test_reads_equal_the_full_rewrite(spark, tmp_path):
    path, rng, model = str(tmp_path), random.Random(4), []
    past = [[]]
    for step in range(9):
        change = store.Change(spark, path, KEYS)
        kind = ["append", "upsert", "delete", "video"][step % 4]
        if kind in ("append", "upsert"):
            new = [(rng.choice("abcdefgh") if rng.random() < 0.9 else None, rng.choice(["v1", "v2", "v3", None]), step) for _ in range(6)]
            if kind == "upsert":
                model = [r for r in model if r[0] is None or r[0] not in {x[0] for x in new}]
                change.upsert("items", items(spark, *new))
            else:
                change.append("items", items(spark, *new))
            model = model + new
        elif kind == "delete":
            model = [r for r in model if r[0] not in ("a", "b")]
            change.delete("items", ids(spark, "a", "b", None, name="id"))
        else:
            model = [r for r in model if r[1] != "v1"]
            change.delete("items", ids(spark, "v1", "v1"), "video_id")
        assert change.commit() == step + 1
        past.append(sorted(model, key=repr))
        assert read(spark, path) == past[-1]
    assert read(spark, path, commit=4) == past[4]
    assert store.compact(spark, path, SCHEMAS, KEYS) == 10 and read(spark, path) == past[-1]
    assert store.compact(spark, path, SCHEMAS, KEYS) is None
    assert store.vacuum(spark, path, keep=1) > 0 and read(spark, path) == past[-1]


def test_a_change_that_ends_half_way_changes_nothing_and_one_of_two_writers_is_refused(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    store.Change(spark, path, KEYS).append("items", items(spark, ("a", "v1", 1))).commit()

    def killed(*_):
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(graph_commits, "_publish", killed)
        with pytest.raises(OSError):
            store.Change(spark, path, KEYS).delete("items", ids(spark, "v1"), "video_id").commit()
    assert read(spark, path) == [("a", "v1", 1)]
    one, two = store.Change(spark, path, KEYS), store.Change(spark, path, KEYS)
    one.append("items", items(spark, ("b", "v2", 2))).commit()
    two.upsert("items", items(spark, ("a", "v1", 9)))
    with pytest.raises(graph_commits.ConflictError):
        two.commit()
    assert read(spark, path) == [("a", "v1", 1), ("b", "v2", 2)]
    assert read(spark, path, "notes") == []
    with pytest.raises(ValueError):
        one.append("unknown", items(spark))


def test_removing_one_video_writes_less_than_a_hundredth(spark, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path)
    many = spark.range(200_000).select(F.md5(F.col("id").cast("string")).alias("id"), (F.col("id") % 1000).cast("string").alias("video_id"), F.col("id").cast("int").alias("n"))
    store.Change(spark, path, KEYS).append("items", many).commit()
    store.Change(spark, path, KEYS).delete("items", ids(spark, "7"), "video_id").commit()
    base, more = store.file_bytes(spark, path)["items"]
    assert 0 < more * 100 < base
    now = store.load(spark, path, SCHEMAS)["items"]
    assert now.count() == 199_800 and now.where("video_id = '7'").count() == 0
    assert store.compact(spark, path, SCHEMAS, KEYS, share=0.1) is None


def _texts(df, columns):
    return sorted(str(r) for r in df.select(*columns).collect())


def test_library_changes(spark, tmp_path):
    from test_stores import processed
    from reelgraph.plans.library import Library

    path = str(tmp_path / "lib")
    Library.open(spark, str(tmp_path / "none")).save_changes(path)
    rows = processed(spark)
    Library.add_stored(spark, path, rows, 5.0)
    whole = Library.open(spark, str(tmp_path / "none")).add(rows, 5.0)
    stored = Library.open_changes(spark, path)

    def same(a, b, name):
        return _texts(a[name], a[name].columns) == _texts(b[name], a[name].columns)

    for name in ("videos", "chunks", "frames", "audio_segments", "vectors"):
        assert same(stored, whole, name), name
    Library.add_stored(spark, path, rows, 6.0)
    assert stored["videos"].count() == Library.open_changes(spark, path)["videos"].count()
    Library.remove_stored(spark, path, "v1")
    left = Library.open_changes(spark, path)
    for name in ("videos", "chunks", "frames", "audio_segments", "vectors"):
        assert same(left, Library.open(spark, str(tmp_path / "none")).add(rows, 6.0).remove("v1"), name), name
    Library.compact_stored(spark, path, share=0.0)
    assert "v1" not in {r.video_id for r in Library.open_changes(spark, path).videos.collect()}
