"""Stores, exchange, export and settings: round trips on small tables."""

import gzip
import glob
import json
import os
import tempfile
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from reelgraph import config
from reelgraph.models import inference as mi
from reelgraph.operators import frames as fr, media_search as ms, stats
from reelgraph.schema import METADATA_TABLES, PROCESSED_VIDEO
from reelgraph.sources import driver_tables as dt, exchange, graph_export, media_files, store


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="reelgraph-store-")


def processed(spark):
    frames = [("v1_chunk_0000_frame_0000", 1.0, 30, "a cat", 0.8, None, [1.0, 0.0]), ("v1_chunk_0000_frame_0001", 2.0, 60, None, 0.8, None, None)]
    chunks = [
        ("v1_chunk_0000", 0.0, 30.0, "cat scene", [0.5, 0.5], frames, ("v1_chunk_0000_audio", 0.0, 30.0, "meow", 0.9, None)),
        ("v1_chunk_0001", 30.0, 45.0, None, None, [], None),
    ]
    rows = [
        ("v1", "/m/v1.mp4", "v1.mp4", 45.0, 30.0, "224x224", 10, 1.5, True, None, chunks),
        ("v2", "/m/v2.mp4", "v2.mp4", 0.0, 0.0, "", 0, 0.0, False, "Invalid video format or file not found", None),
    ]
    return spark.createDataFrame(rows, PROCESSED_VIDEO)


def test_shred(spark):
    t = store.shred(processed(spark), 5.0)
    v = {r["video_id"]: r for r in t["videos"].collect()}
    assert (v["v1"]["chunk_count"], v["v1"]["frame_count"], v["v2"]["chunk_count"], v["v2"]["frame_count"]) == (2, 2, 0, 0)
    c = {r["chunk_id"]: r for r in t["chunks"].collect()}
    assert (c["v1_chunk_0000"]["has_audio"], c["v1_chunk_0001"]["has_audio"], c["v1_chunk_0001"]["unified_description"]) == (True, False, "")
    assert t["frames"].count() == 2 and t["audio_segments"].count() == 1
    vec = {r["entry_id"]: r for r in store.media_vectors(processed(spark), 5.0).collect()}
    assert set(vec) == {"chunk_v1_chunk_0000", "frame_v1_chunk_0000_frame_0000"} and vec["chunk_v1_chunk_0000"]["timestamp"] == 0.0
    again = store.from_wire(store.to_wire(processed(spark)))
    assert sorted(map(str, again.collect())) == sorted(map(str, processed(spark).collect()))


def test_tables_and_upserts(spark, folder):
    store.create_tables(spark, "default", location=folder)
    for name in METADATA_TABLES:
        assert spark.table(name).count() == 0
    a = spark.createDataFrame([("k1", 1), ("k2", 1)], "entry_id string, v int")
    b = spark.createDataFrame([("k2", 2), ("k3", 2)], "entry_id string, v int")
    assert dict(store.upsert(a, b, "entry_id").collect()) == {"k1": 1, "k2": 2, "k3": 2}
    assert dict(store.insert_absent(a, b, "entry_id").collect()) == {"k1": 1, "k2": 1, "k3": 2}
    assert dict(store.delete_by_key(a, "entry_id", "k1").collect()) == {"k2": 1}


def graph(spark, gid="g1"):
    e = spark.createDataFrame([(gid, "a", 'Ann "A" <x> & co', "PERSON", "d", 0.9), (gid, "b", "Bob", "PERSON", "", 0.5)],
                              "graph_id string, entity_id string, name string, entity_type string, description string, confidence double")
    r = spark.createDataFrame([(gid, "r1", "a", "b", "USES", "", 0.7, 0.0, 30.0)],
                              "graph_id string, relation_id string, source_entity string, target_entity string, relation_type string, "
                              "description string, confidence double, start_time double, end_time double")
    v = spark.createDataFrame([(gid, "a", "v1"), (gid, "a", "v2")], "graph_id string, entity_id string, video_id string")
    empty = {n: spark.createDataFrame([], s) for n, s in __import__("reelgraph.schema").schema.GRAPH_TABLES.items()}
    return {**empty, "entities": e, "relations": r, "entity_videos": v}


def test_graph_store(spark, folder):
    store.save_graph(graph(spark, "g1"), folder)
    store.save_graph(graph(spark, "g2"), folder)
    store.save_graph(graph(spark, "g2"), folder)
    store.save_graph(graph(spark, "g3"), folder)
    bare = graph(spark, "g3")
    store.save_graph({**bare, "aliases": bare["aliases"].limit(0)}, folder)
    assert store.load_graph(spark, folder, "g3")["aliases"].count() == 0 and store.load_graph(spark, folder, "g3")["entities"].count() > 0
    store.delete_graph(spark, folder, "g3")
    assert store.load_graph(spark, folder, "g3")["entities"].count() == 0
    everything = store.load_graph(spark, folder)
    assert sorted(r[0] for r in store.list_graphs(everything["entities"]).collect()) == ["g1", "g2"]
    assert everything["entities"].count() == 4 and store.load_graph(spark, folder, "g1")["relations"].count() == 1
    store.save_graph_json(graph(spark), f"{folder}/json")
    back = store.load_graph_json(spark, f"{folder}/json")
    cols = graph(spark)["entities"].columns
    assert sorted(map(tuple, back["entities"].select(cols).collect())) == sorted(map(tuple, graph(spark)["entities"].collect()))


def _document(folder):
    parts = sorted(glob.glob(f"{folder}/part-*"))
    return "".join(open(p, encoding="utf-8").read() for p in parts)


def test_graph_exports_are_valid_documents(spark, folder):
    g = graph(spark)
    args = (g["entities"].drop("graph_id"), g["entity_videos"].drop("graph_id"), g["relations"].drop("graph_id"))
    graph_export.export_graph(*args, f"{folder}/c", "cytoscape", parts=3)
    doc = json.loads(_document(f"{folder}/c"))
    assert [n["data"]["id"] for n in doc["nodes"]] == ["a", "b"] and doc["nodes"][0]["data"]["video_count"] == 2
    assert doc["edges"][0]["data"]["source"] == "a"
    graph_export.export_graph(*args, f"{folder}/g", "gephi", parts=2)
    root = ET.fromstring(_document(f"{folder}/g"))
    assert [n.get("label") for n in root.iter("node")] == ['Ann "A" <x> & co', "Bob"] and len(list(root.iter("edge"))) == 1
    graph_export.export_graph(*args, f"{folder}/m", "graphml")
    assert len([n for n in ET.fromstring(_document(f"{folder}/m")).iter() if n.tag.endswith("node")]) == 2
    assert graph_export.export_graph(*args, f"{folder}/x", "unknown") is None and not os.path.exists(f"{folder}/x")
    empty = [a.filter("false") for a in args]
    graph_export.export_graph(*empty, f"{folder}/e", "cytoscape")
    assert json.loads(_document(f"{folder}/e")) == {"nodes": [], "edges": []}


def library(spark, n=3):
    t = store.shred(processed(spark), 1.0)
    more = t["videos"].filter("video_id = 'v1'").withColumn("video_id", F.explode(F.array(*[F.lit(f"w{i}") for i in range(n)])))
    vec = spark.createDataFrame([("x1", [1.0], {"a": "b"}, "frame", "f", "v1", None, 1.0)], __import__("reelgraph.schema").schema.VECTORS)
    return {**t, "videos": t["videos"].unionByName(more), "vectors": vec, **graph(spark)}


def test_export_import(spark, folder):
    lib = library(spark)
    exchange.export_library(lib, folder)
    names = glob.glob(f"{folder}/videos/part-*.json.gz")
    assert names and sum(len(gzip.open(n).readlines()) for n in names) == 5
    mine = {**lib, "videos": lib["videos"].filter("video_id = 'w0'"), "chunks": lib["chunks"].filter("false"), "vectors": lib["vectors"].filter("false")}
    merged = exchange.import_library(spark, folder, mine)
    assert merged["videos"].count() == 5 and merged["chunks"].count() == 2 and merged["vectors"].count() == 1
    assert merged["entities"].count() == 2
    replaced = exchange.import_library(spark, folder, mine, merge=False, sections=("videos",))
    assert replaced["videos"].count() == 5 and replaced["vectors"].count() == 0
    there = spark.createDataFrame([("/nowhere",)], "path string")
    assert exchange.import_library(spark, folder, mine, existing_paths=there)["videos"].count() == 1


def test_backup_restore(spark, folder):
    lib = library(spark)
    lib["videos"].write.parquet(f"{folder}/live/videos")
    path = exchange.backup(lib, folder)
    assert exchange.restore(spark, path)["videos"].count() == 5
    assert exchange.restore_library(spark, path, {"videos": f"{folder}/live/videos"}) is False
    spark.createDataFrame([("only",)], "video_id string").write.mode("overwrite").parquet(f"{folder}/live/videos")
    assert exchange.restore_library(spark, path, {"videos": f"{folder}/live/videos"}, confirm=True)
    assert spark.read.parquet(f"{folder}/live/videos").count() == 5
    with pytest.raises(FileNotFoundError):
        exchange.restore(spark, f"{folder}/nothing")


def test_sync_copies_children_of_new_videos_only(spark):
    lib = library(spark)
    target = {**lib, "videos": lib["videos"].filter("video_id <> 'v1'"), "chunks": lib["chunks"].filter("false"), "entities": lib["entities"].filter("false")}
    out = store.sync(target, lib)
    assert out["videos"].count() == 5 and out["chunks"].count() == 2 and out["entities"].count() == 2
    assert store.sync(lib, lib)["chunks"].count() == 2


def test_media_files(spark, folder):
    for name in ("a.mp4", "b.MOV", "c.txt"):
        open(f"{folder}/{name}", "w").write("x" * 5)
    rows = {r["filename"]: r for r in media_files.media_files(spark, folder).collect()}
    assert (rows["a.mp4"]["supported"], rows["b.MOV"]["supported"], rows["c.txt"]["supported"]) == (True, True, False)
    assert rows["a.mp4"]["size_bytes"] == 5 and len({r["video_id"] for r in rows.values()}) == 3


def test_chunking_and_sampling(spark):
    v = spark.createDataFrame([("v", 95.0, 30.0, 2850)], "video_id string, duration double, fps double, total_frames long")
    c = fr.chunk_windows(v)
    assert [(r["start_time"], r["end_time"]) for r in c.orderBy("start_time").collect()] == [(0.0, 30.0), (30.0, 60.0), (60.0, 90.0), (90.0, 95.0)]
    s = fr.sample_frames(c, 15).filter("chunk_id = 'v_chunk_0000'").orderBy("frame_index").collect()
    assert [r["frame_index"] for r in s] == list(range(0, 900, 60))
    short = spark.createDataFrame([("s", 1.0, 3.0, 3)], v.schema)
    assert [r["frame_index"] for r in fr.uniform_keyframes(short, 20).orderBy("frame_index").collect()] == [0, 1, 2]
    assert fr.extract_keyframes(v, "nonsense").count() == 0


def test_scene_keyframes_against_loop(spark):
    import random

    rng = random.Random(8)
    videos, diffs, want = [], [], {}
    for i in range(5):
        total = rng.randint(200, 4000)
        d = [(f, rng.choice([0.0, 10.0, 31.0, 90.0])) for f in range(15, total, 15)]
        videos.append((f"v{i}", 30.0, total))
        diffs += [(f"v{i}", f, x) for f, x in d]
        kept = [0]
        for f, x in d:
            if len(kept) >= 20:
                break
            if x > 30 and f - kept[-1] > 60:
                kept.append(f)
        if kept[-1] != total - 1:
            kept.append(total - 1)
        want[f"v{i}"] = kept[:20]
    got = fr.scene_keyframes(
        spark.createDataFrame(videos, "video_id string, fps double, total_frames long"),
        spark.createDataFrame(diffs, "video_id string, frame_index long, difference double"),
    ).collect()
    for v, frames in want.items():
        assert sorted(r["frame_index"] for r in got if r["video_id"] == v) == frames


def test_listing_edge_cases(spark, sf):
    v = dt.videos(spark, sf)
    assert ms.list_videos(v, None, 5).count() == v.filter("success").count()
    assert ms.list_videos(v, 3, 1, False).count() == 3
    f, a = dt.frames(spark, sf), dt.audio_segments(spark, sf)
    wild = ms.search_frames(f, v, "%", limit=None)
    assert wild.count() == f.filter(F.contains("caption", F.lit("%"))).join(v, "video_id").count()
    both = ms.hybrid_search(v, f, a, None, "the", compat=True)
    assert both.filter("vector_score > 0").count() == 0


def test_models(spark):
    rows = spark.createDataFrame([("a b",), ("bad",), (None,)], "t string")

    def infer(v):
        if v == "bad":
            raise ValueError
        return v.upper()

    out = {r["t"]: r["o"] for r in rows.withColumn("o", mi.apply_model(mi.fixed_text("up", infer), F.col("t"))).collect()}
    assert out == {"a b": "A B", "bad": None, None: None}
    assert mi.device_for(1000, [("gpu0", 1100), ("gpu1", 1300)]) == "gpu1" and mi.device_for(9000, [("gpu0", 1100)]) == "cpu"


def test_health(spark):
    rows = spark.createDataFrame(
        [(True, 0, False, False, 0, 4), (True, 0, False, False, 3, 4), (False, 2, True, False, 0, 0)],
        "initialized boolean, failed_models int, memory_short boolean, disk_short boolean, failed int, total int",
    )
    assert sorted(r["overall"] for r in stats.health(rows).collect()) == ["degraded", "healthy", "unhealthy"]


def test_settings(folder):
    s = config.Settings().with_model("embedder", device="cpu")
    path = f"{folder}/s.json"
    config.save_settings(s, path)
    assert config.load_settings(path) == s and config.load_settings(f"{folder}/none.json") == config.Settings()
    assert s.is_model_enabled("embedder") and not s.is_model_enabled("x") and s.problems() == []
    e = config.settings_from_env({"REELGRAPH_RETRIEVAL_TOP_K_TEXT": "7", "REELGRAPH_PROCESSING_SUPPORTED_FORMATS": "mp4, webm"})
    assert e.retrieval.top_k_text == 7 and e.processing.supported_formats == ("mp4", "webm")


def test_library(spark, folder):
    from reelgraph.config import RetrievalSettings, Settings
    from reelgraph.plans.library import Library

    empty = Library.open(spark, f"{folder}/none")
    assert empty.search("cat").count() == 0 and empty.retrieve("cat").count() == 0
    lib = empty.add(processed(spark), 1.0).with_tables(**graph(spark))
    lib.save(f"{folder}/lib")
    lib = Library.open(spark, f"{folder}/lib", settings=Settings(retrieval=RetrievalSettings(confidence_threshold=0.1)))
    assert lib.search("cat").count() == 2 and lib.query("cat").count() == 1 and lib.query("cat", "nothing").count() == 0
    assert lib.query("bob", "entities").count() == 1 and lib.timeline("v1").count() == 5
    first = lib.retrieve("cat")
    assert [r["result_id"] for r in first.collect()] == ["v1_chunk_0000_frame_0000"] and lib.retrieve("cat") is first
    assert lib.near_vector([1.0, 0.0], 1).first()["source_id"] == "v1_chunk_0000_frame_0000"
    assert lib.hybrid("cat", [1.0, 0.0]).filter("text_score > 0 or vector_score > 0").count() == 2
    again = lib.add(processed(spark), 2.0)
    assert again["videos"].count() == 2 and again["frames"].count() == 2 and again["vectors"].count() == 2
    again.save(f"{folder}/lib")  # onto the path it is read from
    again.remove("v1").save(f"{folder}/lib")
    assert "v1" not in {r.video_id for r in Library.open(spark, f"{folder}/lib").videos.collect()}
    broken = again.with_tables(frames=again["frames"].withColumn("caption", F.raise_error(F.lit("stop"))))
    with pytest.raises(Exception):
        broken.with_tables(frames=broken["frames"].limit(0).unionByName(spark.range(1).select(
            *[F.raise_error(F.lit("stop")).cast(f.dataType).alias(f.name) for f in again["frames"].schema]))).save(f"{folder}/lib")
    assert "v1" not in {r.video_id for r in Library.open(spark, f"{folder}/lib").videos.collect()}
    assert again.remove("v1")["vectors"].count() == 0 and again.tidy(3.0)["videos"].count() == 1
    assert again.merge(lib)["videos"].count() == 2 and lib.statistics().count() == 6
    assert lib.neighbourhood("a").count() == 2 and lib.prune_graph()["entities"].count() == 2
