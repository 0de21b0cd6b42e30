"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, with calibrated scores.

* Features: hashed runs of 1 to 3 characters of the lower-cased text, weighted (1 + log count) * idf and scaled to length one.
* Corpus statistics (document frequencies, languages and their counts) cover every labelled training row.
* The weights are fitted by follow-the-regularised-leader (FTRL-proximal) steps with elastic-net penalties: the L1 part keeps most
  weights at exactly zero.  Fitting uses at most ``per_language`` rows of each language, those with the smallest hash of text and id:
  a bounded sample of labelled rows.  A fifth of it is kept from the fit and sets the temperature that calibrates the scores.
* Prediction reads every whole text.

The model has a fixed size (2**bits cells times the languages) and is sent to the tasks as a broadcast variable.

Nulls and edges: a null text, or one without any letter, is ``und`` with score 0, as is every text when nothing can be learned.
Rows without ``lang`` are predicted but not learned from.  Repeated rows each come back.  Columns other than those named are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from reelgraph.llm.common import batches, extended, slices, staged

BITS = 16
PER_LANGUAGE = 1_500
FOLDS = 5
UNKNOWN = "und"


def cells_of(text: str, bits: int = BITS) -> np.ndarray:
    """The cells of all runs of 1, 2 and 3 characters of a text, one after the other."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)
    shift = np.uint32(32 - bits)
    two = code[:-1] * np.uint32(0x9E3779B1) + code[1:]
    three = two[:-1] * np.uint32(0x85EBCA77) + code[2:]
    parts = [(x ^ (x >> np.uint32(15))) * np.uint32(odd) >> shift for x, odd in ((code, 0xC2B2AE3D), (two, 0x27D4EB2F), (three, 0x165667B1))]
    return np.concatenate(parts)


def _vector(text: str, idf: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(cells_of(text, bits), minlength=1 << bits)
    at = np.flatnonzero(counts)
    values = (1 + np.log(counts[at])) * idf[at]
    norm = np.sqrt((values**2).sum())
    return at, values / norm if norm else values


def _document_frequencies(bits: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, mark = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, bool)
        for frame in batches(frames, "text"):
            for text in frame["text"]:
                mark[cells_of(text, bits)] = True
                found += mark
                mark[:] = False
        at = np.flatnonzero(found)
        for part in np.array_split(at, 1 + len(at) // 4096):
            yield pd.DataFrame({"cell": part.astype(np.int32), "n": found[part]})

    return run


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], cells: int, classes: int, alpha=0.5, beta=1.0, l1=0.002, l2=0.002, rounds=3) -> np.ndarray:
    """Weights (cells, classes) by per-coordinate FTRL-proximal steps on the multinomial log loss."""
    z, n = np.zeros((cells, classes)), np.zeros((cells, classes))
    order = np.random.default_rng(0)
    for _ in range(rounds):
        for k in order.permutation(len(rows)):
            at, x, label = rows[k]
            zk, nk = z[at], n[at]
            w = np.where(np.abs(zk) > l1, -(zk - np.sign(zk) * l1) / ((beta + np.sqrt(nk)) / alpha + l2), 0.0)
            p = softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p
            root = np.sqrt(nk + g * g)
            z[at] = zk + g - (root - np.sqrt(nk)) / alpha * w
            n[at] = nk + g * g
    return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(u: float) -> float:
        return float(-np.log(softmax(logits / np.exp(u))[np.arange(len(labels)), labels] + 1e-12).mean())

    low, high, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (cells, languages), idf included
    idf: np.ndarray
    heat: float
    bits: int

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        at, x = _vector(text, self.idf, self.bits)
        p = softmax(x @ self.weights[at] / self.heat)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _fit(languages: list[str], idf: np.ndarray, bits: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {x: k for k, x in enumerate(languages)}
        fit, rest = [], []
        for frame in frames:
            for text, lang, fold in zip(frame["text"], frame["lang"], frame["fold"], strict=True):
                (rest if fold == 0 else fit).append((*_vector(text, idf, bits), known[lang]))
        if not fit:
            fit, rest = rest, []
        # an order that doesn't depend on how rows arrive
        fit.sort(key=lambda r: (r[2], len(r[0]), r[0].tobytes(), r[1].tobytes()))
        weights = ftrl(fit, 1 << bits, len(languages))
        logits = np.array([x @ weights[at] for at, x, _ in rest]).reshape(len(rest), len(languages))
        heat = temperature(logits, np.array([label for *_, label in rest], dtype=int))
        rows = np.flatnonzero((weights != 0).any(axis=1))
        yield pd.DataFrame({"cell": rows.astype(np.int32), "w": list(weights[rows])})
        yield pd.DataFrame({"cell": np.array([-1], np.int32), "w": [np.array([heat])]})

    return run


def train(labelled: DataFrame, bits: int = BITS, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from the (text, lang) rows; rows without text or language are left out."""
    own = [F.col("doc_id").cast("string")] if "doc_id" in labelled.columns else []
    rows = labelled.select(
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64("text", *own, F.lit(7)).alias("at")
    ).where("text is not null and lang is not null")
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("at").alias("places")).collect()  # one row per language
    counts, places = ({r["lang"]: r[c] for r in found} for c in ("n", "places"))
    languages = sorted(counts)
    frequency = np.zeros(1 << bits)
    total = sum(counts.values())
    if languages:
        for r in rows.select("text").mapInPandas(_document_frequencies(bits), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            frequency[r["cell"]] = r["n"]  # at most 2**bits rows
    idf = np.log((1 + total) / (1 + frequency)) + 1
    weights, heat = np.zeros((1 << bits, len(languages))), 1.0
    if languages:
        # about twice the wanted rows by the hash of text and id, in each task, or all; then exactly the wanted ones.  The share goes by
        # different hashes, so rows that are all equal are taken together and none of a language's is never the outcome
        shares = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, 2.5 * per_language / max(1, places[lang])) if places[lang] > 100 else 1.0)])
        near = rows.where(F.pmod("at", F.lit(1 << 20)) < F.ceil(F.element_at(shares, F.col("lang")) * (1 << 20)))
        first = Window.partitionBy("lang").orderBy(F.pmod("at", F.lit(1 << 20)), "at", "text")
        sample = near.withColumn("k", F.row_number().over(first)).where(F.col("k") <= per_language)
        fitted = sample.select("text", "lang", (F.col("k") % FOLDS).cast("int").alias("fold")).coalesce(1)  # a language's first rows are always fitted
        for r in staged(fitted.mapInPandas(_fit(languages, idf, bits), "cell int, w array<double>")).collect():  # the model: of fixed size
            if r["cell"] < 0:
                heat = r["w"][0]
            else:
                weights[r["cell"]] = r["w"]
    return Model(languages, weights.astype(np.float32), idf, heat, bits)


def _predict(model, column: str, drop: tuple[str, ...]):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(tables, column):
            found = [model.value.predict(t) for t in table.column(column).to_pylist()]
            yield extended(table, drop, lang_pred=pa.array([x for x, _ in found], pa.string()), score=pa.array([x for _, x in found], pa.float64()))

    return run


def identify(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns ``keep`` of every row with lang_pred and score.  Only the text takes part in a prediction.

    A string column ``text`` that is kept goes to the tasks once.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    if "text" in keep and docs.schema["text"].dataType == T.StringType():
        return kept.mapInArrow(_predict(sent, "text", ()), schema)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("__text"))
    return rows.mapInArrow(_predict(sent, "__text", ("__text",)), schema)


def held_out(doc_id: str = "doc_id"):
    """Is the crc32 of the id's text divisible by five?  A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fold_of(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5
