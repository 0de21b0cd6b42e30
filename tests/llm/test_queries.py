"""Registered corpus queries against their SQL, and the pipeline stage by stage."""

from types import SimpleNamespace

import pytest

import corpus_pipeline
from oracle import compare, duck
from reelgraph.llm.queries import QUERIES
from test_duplicates import brute_components, brute_removal


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query(name, spark, sf, con):
    run, sql = QUERIES[name]
    ok, message, _ = compare(spark, con, SimpleNamespace(run=run, sql=sql), sf)
    assert ok, message


def test_every_operator_has_one_query():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 14))
    assert "pipeline" in names


def test_stages(spark, docs, rows, sf):
    after = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after.append(spark.createDataFrame(stage(spark, after[-1], sf).collect(), docs.schema))
        assert after[-1].columns == docs.columns
    # language: only texts without letters go
    assert {r.text for r in after[0].collect()} - {r.text for r in after[1].collect()} <= {None, "", "  \t\n ", "123 456 !!"}
    # near duplicates: one per group
    before = [tuple(r) for r in after[1].collect()]
    keep = {c for _, _, c in brute_components(before, 5, 75, 100)}
    assert sorted((r.doc_id for r in after[2].collect()), key=str) == sorted(keep - {None}, key=str) + [None] * sum(r[0] is None for r in before)
    # passages
    made = {d: (n, gone, kept) for d, n, gone, kept in brute_removal([tuple(r) for r in after[2].collect()], 50)}
    for r in after[3].collect():
        n, gone, kept = made.pop(r.doc_id)
        assert r.text == kept if gone else True
        assert not gone or r.n_chars == len(r.text)
    assert all(n == gone > 0 for n, gone, _ in made.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, after[4], sf).collect()
    assert sorted((r.doc_id for r in packed if r.start == 0), key=str) == sorted((r.doc_id for r in after[4].collect()), key=str)


def test_texts_under_one_id_are_judged_each(spark, docs):
    """Of two unrelated texts under one id, one of which is a copy, only the copy goes; of equal rows one stays."""
    a, b, c = ("one two three four five six seven", "red green blue white black grey pink", "sun moon star sky cloud rain snow")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (4, a), (None, a), (None, a)]
    table = spark.createDataFrame([(k, t, "en", "s", len(t), *[None] * 5) for k, t in rows], docs.schema)
    left = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, table, "").collect()), key=str)
    assert sorted(t for d, t in left if d is not None) == sorted([a, b, c]) and sum(d is None for d, _ in left) == 2
    assert (2, b) in left


def test_pipeline_runs(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_stages_on_nothing(spark, no_docs, sf):
    table = no_docs
    for _, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, sf)
        assert table.count() == 0
