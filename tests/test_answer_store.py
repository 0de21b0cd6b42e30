"""The answer store: no question twice, failures asked again, keys by content, model and prompt."""

from reelgraph.models.inference import Model, fixed_text
from reelgraph.sources import answer_store as store
from pyspark.sql import types as T

SHAPE = "frame_id string, content string, prompt string, extra int"


def never():
    def refuse(_, values):
        raise AssertionError("the model was called")

    return Model("m", lambda: None, refuse, T.StringType())


def rows(df):
    return sorted(((r.frame_id, r.content, r.prompt, r.extra, r.answer, r.reused) for r in df.collect()), key=repr)


def test_a_second_run_calls_the_model_for_nothing(spark, tmp_path):
    path = str(tmp_path / "answers")
    asked = [("1", "cat", "what", 1), ("1", "cat", "what", 2), ("2", "cat", "what", 3), ("2", None, "what", 4), ("2", "", "what", 5),
             (None, "cat", "what", 6), ("1", "cat", None, 7), ("1", "dog", "what", 8)]
    requests = spark.createDataFrame(asked, SHAPE)
    first = rows(store.ask(requests, path, fixed_text("m", str.upper), 1.0))
    assert [r[:4] for r in first] == sorted(asked, key=repr) and not any(r[5] for r in first)
    assert {r[4] for r in first if r[3] in (1, 2, 3, 6)} == {"WHAT\n\nCAT"}
    assert store.stored(spark, path).count() == 7
    again = rows(store.ask(requests, path, never(), 2.0))
    assert [r[:5] for r in again] == [r[:5] for r in first] and all(r[5] for r in again)
    assert store.stored(spark, path).count() == 7


def test_only_changed_content_is_asked_and_other_models_have_their_own(spark, tmp_path):
    path = str(tmp_path / "answers")
    store.ask(spark.createDataFrame([("1", "cat", "what", 1)], SHAPE), path, fixed_text("m", lambda q: "old"), 1.0)
    changed = spark.createDataFrame([("1", "cat", "what", 1), ("1", "cats", "what", 1)], SHAPE)
    assert {(r[1], r[4]) for r in rows(store.ask(changed, path, fixed_text("m", lambda q: "new"), 2.0))} == {("cat", "old"), ("cats", "new")}
    assert {(r[4], r[5]) for r in rows(store.ask(changed, path, fixed_text("n", lambda q: "other"), 3.0))} == {("other", False)}


def test_failures_are_not_stored(spark, tmp_path):
    path = str(tmp_path / "answers")
    requests = spark.createDataFrame([("1", "good", "what", 1), ("2", "bad", "what", 1)], SHAPE)

    def half(q):
        if "bad" in q:
            raise ValueError(q)
        return "fine"

    assert {(r[0], r[4]) for r in rows(store.ask(requests, path, fixed_text("m", half), 1.0))} == {("1", "fine"), ("2", None)}
    again = rows(store.ask(requests, path, fixed_text("m", lambda q: "late"), 2.0))
    assert {(r[0], r[4], r[5]) for r in again} == {("1", "fine", True), ("2", "late", False)}


def test_double_appends_agree_and_empty_requests_are_fine(spark, tmp_path):
    path = str(tmp_path / "answers")
    requests = spark.createDataFrame([("1", "cat", "what", 1)], SHAPE)
    assert rows(store.ask(requests.limit(0), path, never(), 0.0)) == []
    store.ask(requests, path, fixed_text("m", lambda q: "b"), 1.0)
    store.stored(spark, path).selectExpr("key", "model", "'a' AS answer", "2.0D AS answered_at").write.mode("append").parquet(path)
    assert rows(store.ask(requests, path, never(), 3.0)) == [("1", "cat", "what", 1, "a", True)]


def test_questions_that_read_alike_differ(spark):
    from pyspark.sql import functions as F

    made = spark.range(1).select(
        store.answer_key("m", F.lit("a"), F.lit("b,c"), F.lit("d")).alias("x"), store.answer_key("m", F.lit("a,b"), F.lit("c"), F.lit("d")).alias("y"),
        store.answer_key("m", F.lit(None), F.lit("c"), F.lit("d")).alias("z"), store.answer_key("m", F.lit(""), F.lit("c"), F.lit("d")).alias("w"),
    ).first()
    assert len(set(made)) == 4
