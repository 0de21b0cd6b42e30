import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # extra columns whose names the operators use themselves
    T.StructField("size", T.StringType()), T.StructField("key", T.IntegerType()), T.StructField("spans", T.StringType()),
    T.StructField("shard", T.StringType()), T.StructField("copies", T.StringType()),
])


def prose(rng: random.Random, n: int, words: int = 400) -> list[str]:
    return [f"w{rng.randrange(words)}" for _ in range(n)]


def make_rows() -> list[tuple]:
    """Documents with every edge: nulls, blanks, copies, near copies, shared passages, repeated rows, very long texts, odd characters."""
    rng = random.Random(11)
    texts: list[str | None] = [None, "", "  \t\n ", "a", "one two", "Ä ö É", "123 456 !!", "A A A A " * 60, "x" * 3000, "<|endoftext|> and <s> x"]
    base = prose(rng, 220)
    texts += [" ".join(base)] * 6
    for k in range(12):  # near copies
        copy = list(base)
        for _ in range(1 + k // 3):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(99)}"
        texts.append("  ".join(copy) if k % 2 else " ".join(copy).upper())
    passage = prose(rng, 70)
    for _ in range(12):
        texts.append(" ".join(prose(rng, rng.randrange(60)) + passage + prose(rng, rng.randrange(60))))
    for _ in range(40):
        texts.append(" ".join(prose(rng, rng.randrange(1, 160), 3000)))
    texts.append(" ".join(prose(rng, 6000, 3000)) + " " + " ".join(passage))
    texts += [" em space  tail  ", "tab\tsep\x0bvt\x1cfs ls", "\U0001f600 日本語の文章 café", "▁▁x ▁", "don't  we'll  I'm\n\n\nx"]
    rows = []
    for k, text in enumerate(texts):
        source = None if k % 11 == 0 else ("hot" if k % 3 == 0 else f"s{k % 7}")
        rows.append((k * 3 + 1, text, ["en", "de", None][k % 3], source, None if text is None else len(text), "s", k, "x", "y", "z"))
    rows += [rows[12], rows[12], rows[20]]  # repeated rows
    rows += [(None, texts[12], "en", "hot", 5, "s", 1, "x", "y", "z"), (None, None, None, None, None, None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
