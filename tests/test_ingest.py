"""Ingest with an injected decoder: failures as rows, parts of long files, models that fail."""

import pytest

import reelgraph.plans.ingest as plan
from reelgraph.functions import ids
from reelgraph.models.inference import VECTOR, Model, fixed_text
from reelgraph.plans.ingest import Models, TextReel, ingest, sampled
from reelgraph.schema import METADATA_TABLES, VECTORS

FILES = "path string, size_bytes bigint, modified double, content binary, error string, fps double"


# made inside functions, so that they travel to the tasks by value


def models():
    def caption(image):
        if image == b"dark":
            raise ValueError("nothing to see")
        return image.decode().upper()

    measure = lambda _, values: [[float(len(v)), 1.0] for v in values]
    return Models(
        fixed_text("upper", caption), fixed_text("said", lambda sound: sound.decode()),
        Model("text", lambda: None, measure, VECTOR), Model("image", lambda: None, measure, VECTOR),
    )


def broken():
    class Broken(TextReel):
        """Fails at the word ``broken``, wherever it stands."""

        def sound(self, start, end):
            said = TextReel.sound(self, start, end)
            if b"broken" in said.split():
                raise OSError("bad block")
            return said

    return Broken


def rows():
    words = [b"w%d" % i for i in range(2_000)]
    late = words[:1_500] + [b"broken"] + words[1_500:]
    return [
        ("a/short.txt", 3, 1.0, b"one dark two"), ("a/long.txt", 9, 1.0, b" ".join(words)), ("a/late.txt", 9, 1.0, b" ".join(late)),
        ("a/empty.txt", 0, 1.0, b""), ("a/null.txt", None, None, None), ("a/song.ogg", 5, 2.0, b"la la"), ("a/short.txt", 3, 1.0, b"one dark two"),
    ]


@pytest.fixture(scope="module")
def made(spark):
    files = spark.createDataFrame([(*r, "x", 9.0) for r in rows()], FILES)
    return {k: v.cache() for k, v in ingest(files, broken(), models(), now=5.0, part_chunks=7, formats=("txt",)).items()}


def test_a_failing_file_is_one_row(made):
    videos = {r.filename: r for r in made["videos"].collect()}
    assert made["videos"].count() == len(videos) == 6
    assert {k: (r.success, r.error_message) for k, r in videos.items()} == {
        "short.txt": (True, None), "long.txt": (True, None), "late.txt": (False, "OSError: bad block"), "empty.txt": (False, "ValueError: no frames"),
        "null.txt": (False, "ValueError: no frames"), "song.ogg": (False, "unsupported format"),
    }
    good = {videos[k].video_id for k in ("short.txt", "long.txt")}
    for name in ("chunks", "frames", "audio_segments", "vectors"):
        assert {r.video_id for r in made[name].select("video_id").distinct().collect()} == good
    assert videos["late.txt"].duration == 0.0 and videos["late.txt"].chunk_count == 0


def test_a_long_file_is_whole(made):
    long = next(r for r in made["videos"].collect() if r.filename == "long.txt")
    assert (long.duration, long.chunk_count, long.frame_count) == (2000.0, 67, 66 * 5 + 5)
    chunks = sorted(made["chunks"].where(made["chunks"].video_id == long.video_id).collect(), key=lambda r: r.start_time)
    assert [(r.start_time, r.end_time) for r in chunks] == [(30.0 * i, min(30.0 * i + 30, 2000.0)) for i in range(67)]
    said = sorted(made["audio_segments"].where(made["audio_segments"].video_id == long.video_id).collect(), key=lambda r: r.start_time)
    assert " ".join(r.transcript for r in said) == " ".join(f"w{i}" for i in range(2_000))
    frames = made["frames"].where(made["frames"].video_id == long.video_id).collect()
    assert all(r.caption == f"W{r.frame_index}" and r.timestamp == float(r.frame_index) for r in frames)


def test_a_model_that_fails_on_a_picture_leaves_an_empty_caption(made):
    short = next(r for r in made["videos"].collect() if r.filename == "short.txt")
    frames = sorted(made["frames"].where(made["frames"].video_id == short.video_id).collect(), key=lambda r: r.frame_index)
    assert [r.caption for r in frames] == ["ONE", "", "TWO"]
    chunk = made["chunks"].where(made["chunks"].video_id == short.video_id).first()
    assert chunk.unified_description == "Visual: ONE | TWO || Audio: one dark two" and chunk.has_audio
    vectors = {r.entry_id: list(r.vector) for r in made["vectors"].where(made["vectors"].video_id == short.video_id).collect()}
    assert len(vectors) == 4 and vectors[f"chunk_{chunk.chunk_id}"][0] == pytest.approx(0.9989, abs=2e-3)


def test_tables_have_the_declared_columns(made):
    for name, ddl in METADATA_TABLES.items():
        declared = {c.split()[0] for c in ddl.split(", ")} - {"processing_time"}
        assert set(made[name].columns) >= declared, name
    assert set(made["vectors"].columns) == {c.split()[0] for c in VECTORS.split(", ")}


def test_without_embedders_and_without_files(spark):
    plain = Models(models().caption, models().transcribe)
    files = spark.createDataFrame([(*r, "x", 9.0) for r in rows()[:1]], FILES)
    assert ingest(files, TextReel, plain, now=0.0)["vectors"].count() == 0
    assert all(t.count() == 0 for t in ingest(files.limit(0), TextReel, models(), now=0.0).values())


def logged(log):
    class Logged(TextReel):
        """Notes each opening; reads ``long.txt`` from its path."""

        def __init__(self, path, content):
            with open(log, "a") as f:
                f.write(path + "\n")
            words = b" ".join(b"w%d" % i for i in range(2_000))
            TextReel.__init__(self, path, words if path == "a/long.txt" else content)

    return Logged


def test_content_is_opened_once_and_never_written(spark, tmp_path, monkeypatch):
    written, cut = [], plan.cut_lineage
    monkeypatch.setattr(plan, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    files = spark.createDataFrame([("a/deep.txt", 9, 1.0, b"word " * 2_000, "x", 9.0)], FILES)
    made = ingest(files, logged(str(tmp_path / "log")), models(), now=0.0, part_chunks=1)
    assert made["chunks"].count() == 67
    assert (tmp_path / "log").read_text().split() == ["a/deep.txt"] * 2  # the probe and one share; 68 before
    assert not any("content" in columns for columns in written)


def test_shares_without_content_or_of_long_content(spark, tmp_path, monkeypatch):
    row = ("a/long.txt", 9, 1.0, None, "x", 9.0)
    whole = ingest(spark.createDataFrame([row], FILES), logged(str(tmp_path / "path")), models(), now=0.0, part_chunks=7)
    monkeypatch.setattr(plan, "SHARE_BYTES", 4_000)
    long = spark.createDataFrame([r for r in [(*r, "x", 9.0) for r in rows()] if r[0] == "a/long.txt"], FILES)
    shared = ingest(long, logged(str(tmp_path / "content")), models(), now=0.0, part_chunks=7)
    assert len((tmp_path / "path").read_text().split()) == 1 + 10 and len((tmp_path / "content").read_text().split()) == 1 + 3
    for name in ("videos", "chunks", "frames", "audio_segments"):
        assert sorted(map(str, whole[name].collect())) == sorted(map(str, shared[name].collect())), name
    assert whole["chunks"].count() == 67 and whole["frames"].count() == 335


def test_many_failed_files_give_the_same_tables(spark, made, monkeypatch):
    monkeypatch.setattr(plan, "BROADCAST_IDS", 0)
    files = spark.createDataFrame([(*r, "x", 9.0) for r in rows()], FILES)
    again = ingest(files, broken(), models(), now=5.0, part_chunks=7, formats=("txt",))
    for name, table in again.items():
        assert sorted(map(str, table.collect())) == sorted(map(str, made[name].collect())), name


def test_chunks_are_not_shuffled_to_leave_out_failed_files(spark):
    limit = "spark.sql.autoBroadcastJoinThreshold"
    kept = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        files = spark.createDataFrame([(*r, "x", 9.0) for r in rows()], FILES)
        made = ingest(files, broken(), models(), now=5.0, formats=("txt",))
        for name in ("chunks", "frames", "audio_segments", "vectors"):
            assert "SortMergeJoin" not in made[name]._jdf.queryExecution().executedPlan().toString(), name
    finally:
        spark.conf.set(limit, kept)


def test_a_medium_that_gives_too_few_pictures(spark):
    class Short(TextReel):
        def frames(self, indexes):
            return TextReel.frames(self, indexes)[:-1]

    files = spark.createDataFrame([("a/few.txt", 9, 1.0, b"one dark two", "x", 9.0)], FILES)
    made = ingest(files, Short, models(), now=0.0)
    frames = sorted(made["frames"].collect(), key=lambda r: r.frame_index)
    assert [(r.frame_index, r.caption) for r in frames] == [(0, "ONE"), (1, ""), (2, "")]


def test_numbered_ids_are_the_formatted_ones(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("v", n) for n in (0, 7, 9999, 10000, 123456, -3, None)] + [(None, 1)], "v string, n bigint")
    both = rows.select(ids.chunk_id(F.col("v"), F.col("n")), F.format_string("%s_chunk_%04d", "v", "n")).collect()
    assert all(a == b for a, b in both) and len(both) == 8


def test_sampled_frames():
    assert sampled(0.0, 30.0, 1.0, 100, 5) == [0, 6, 12, 18, 24] and sampled(90.0, 100.0, 0.25, 25, 5) == [22, 23, 24]
