"""Spelling variants: words one edit apart, each grouped under the most frequent form it is a variant of.

Method: asymmetric q-chunks.  Of two words the shorter (or, of equal lengths, the lesser) is cut into two disjoint chunks; the other
contributes its positional grams of the chunks' lengths.  One inserted or replaced code point spoils one chunk and leaves the other
whole, at its own position or one further on, so every near pair meets in a join on (length, chunk) with a shift of at most one.  Grams at
positions that no shift within one can meet are not written: of a word's grams that leaves four, the two for its own length and the two
for words one shorter.

A chunk of half a short word is shared by many words, and all pairs of such a group would be compared.  So the method is applied to
the other half again: it holds the edit, is cut into two chunks, and one of them is whole.  The join key is the whole half and the whole
quarter, and only words that share three quarters meet.  Each near pair is verified once (the edit distance is one) and counted once: a
substitution spoils one half and one quarter, so only one key fits; for an insertion the first key that fits counts.

Counting words is one pass with bounded tables per task, then a sum with map-side combine.  The vocabulary is written once to the shared
folder.  Roots follow by pointer jumping: a form has at least twice the word's count, so chains are short and rounds few.

Nulls and edges: a null or blank text has no words.  A null ``doc_id`` is an empty text before the colon.  Words without a near word
stay, with ``n_near`` 0.  Repeated rows count as often as they stand.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgraph.llm.common import documents, slices, staged

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT, FACTOR, TYPO_RATE = 5, 3, 2, 97
#: Distinct words a task counts before it hands its counts on.
HELD = 200_000


def _without(word: str, h: int) -> str:
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, typo_rate: int = TYPO_RATE, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n): the words of all whole texts, lower-cased from A to Z, with how often they stand.

    ``typo_rate`` plants misspellings for measuring: a word of a document loses a code point if the rate divides the crc32 of
    ``<doc_id>:<word>``; 0 plants none.
    """

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for table in slices(tables):
            for doc_id, text in zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(RUN.findall(text.encode().lower().decode())).items():
                    if len(word) < least_length:
                        continue
                    if typo_rate:
                        h = zlib.crc32(word.encode(), start)
                        if h % typo_rate == 0:
                            word = _without(word, h)
                            if len(word) < least_length:
                                continue
                    total[word] += n
                if len(total) >= HELD:
                    yield handed()
        if total:
            yield handed()

    counted = documents(docs).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _part(word: str, start: Column, length: Column) -> Column:
    """``length`` code points of ``word``, from ``start``, which counts from 0."""
    return F.substring(F.col(word), start + 1, length)


def _signatures(word: str, length: Column, longer: bool) -> list[Column]:
    """The four keys of a word for partners cut at ``length``: each a whole half with a whole quarter of the other half.

    ``longer``: the word has one code point more, which lies in the half that isn't whole; what comes after it is one further on.
    """
    more = 1 if longer else 0
    half = F.floor(length / 2).cast("int")
    rest = length - half
    keys = []
    for second, (whole_at, whole, other_at, other) in enumerate(((F.lit(0), half, half, rest), (half + more, rest, F.lit(0), half))):
        quarter = F.floor(other / 2).cast("int")
        for last, (at, size) in enumerate(((other_at, quarter), (other_at + quarter + more, other - quarter))):
            keys.append(F.xxhash64(F.lit(2 * second + last), length, _part(word, whole_at, whole), _part(word, at, size)))
    return keys


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): every two words of (word, n) that differ by exactly one inserted, deleted or replaced code point, once.

    ``a`` is the shorter, of equal lengths the lesser.
    """
    sized = words.select("word", "n", F.char_length("word").alias("size"))
    chunks = sized.select(
        F.col("word").alias("a"), F.col("n").alias("n_a"), F.posexplode(F.array(*_signatures("word", F.col("size"), False))).alias("path", "key")
    )
    grams = sized.select(
        F.col("word").alias("b"),
        F.col("n").alias("n_b"),
        F.posexplode(F.array(*_signatures("word", F.col("size"), False), *_signatures("word", F.col("size") - 1, True))).alias("place", "key"),
    )
    near = (F.char_length("a") < F.char_length("b")) | (F.col("a") < F.col("b"))
    joined = chunks.join(grams, "key").where((F.col("place") % 4 == F.col("path")) & near)
    return joined.where(_verified()).select("a", "n_a", "b", "n_b")


def _verified() -> Column:
    """Whether a pair is one edit apart and its key the first of the four that fits.

    What lies around the spoiled quarter must be equal; the edit distance is taken of that quarter alone, so long words cost little.
    """
    size = F.char_length("a")
    more = F.char_length("b") - size
    half = F.floor(size / 2).cast("int")
    in_rest, in_last = F.col("path") < 2, F.col("path") % 2 == 0  # where the edit is: in the second half, in its half's second quarter
    other = F.when(in_rest, size - half).otherwise(half)
    start, quarter = F.when(in_rest, half).otherwise(F.lit(0)), F.floor(other / 2).cast("int")
    same_half = _part("a", F.lit(0), half) == _part("b", F.lit(0), half)
    same_quarter = _part("a", start, quarter) == _part("b", start, quarter)
    at = F.when(in_last, start + quarter).otherwise(start)
    length = F.when(in_last, other - quarter).otherwise(quarter)
    before = _part("a", F.lit(0), at) == _part("b", F.lit(0), at)
    after = _part("a", at + length, size) == _part("b", at + length + more, size)
    edit = F.levenshtein(_part("a", at, length), _part("b", at, length + more), 1) == 1
    return (in_rest == same_half) & (in_last == same_quarter) & before & after & edit


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of (word, n), words being distinct.

    ``form`` is the near word of largest count (ties: the least) if it counts at least ``factor`` times the word, ``root`` the last form
    on the way from a word, ``n_near`` the number of its near words.
    """
    words = words.select("word", "n")
    pairs = near_pairs(words)
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")),
                    F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m")))
    sides = pairs.select(F.explode(sides).alias("s")).select("s.*")
    # the least near word of those with the largest count: the smallest of (-count, word)
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("near"))).alias("best"))
    found = words.join(best, "word", "left")
    fits = -F.col("best.m") >= factor * F.col("n")
    found = staged(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.m")).cast("long").alias("form_n"),
    ))
    roots = _roots(found.where("form is not null").select("word", F.col("form").alias("root")))
    out = found.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(steps: DataFrame) -> DataFrame:
    """(word, root): every word's last form.  Each round doubles the way that ``root`` has gone."""
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = staged(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not steps.where("moved").limit(1).count():
            return steps.select("word", "root")
        steps = steps.select("word", "root")


def spelling_variants(docs: DataFrame, typo_rate: int = TYPO_RATE) -> DataFrame:
    """The variants of the words with at least five code points and three occurrences."""
    return variants(staged(word_counts(docs, typo_rate).where(F.col("n") >= LEAST_COUNT)))
