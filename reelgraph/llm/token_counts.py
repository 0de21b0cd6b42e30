"""Token counts of texts under a byte-pair vocabulary with byte fallback, without making the tokens.

A text's symbols are its characters; the adjacent pair whose union has the best rank in the vocabulary is merged, the leftmost of
equals first, until no union is in it.  A heap holds the pairs and a linked list the symbols, so a text of n characters takes
n log n steps.  The count is the number of first symbols minus the number of merges; a character that the vocabulary lacks stands for
its UTF-8 bytes.  Where no piece of the vocabulary has a blank after another character, no merge crosses into a blank, and the text is
counted unit by unit (blanks and the word after them); counts of short units are remembered in the worker, up to a fixed number.

Nulls and edges: a null text counts as empty, and an empty text has no tokens.  Repeated rows each come back; other columns are ignored;
there is no limit to the length of a text or a unit.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from reelgraph.llm.common import documents, extended, slices

BLANK = "▁"
REMEMBERED = 500_000


class Vocabulary(dict):
    """unit -> number of its tokens; as a mapping it remembers up to ``REMEMBERED`` short units."""

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ranks = {model.id_to_piece(i): -model.get_score(i) for i in ids}
        crossing = any(BLANK in piece.lstrip(BLANK) for piece in self.ranks)
        self.units = re.compile("(?s).+" if crossing else f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        blank = model.encode(" ", out_type=str)
        self.first = BLANK if "".join(model.encode("a", out_type=str)).startswith(BLANK) else ""
        if "".join(blank) != self.first + BLANK or model.normalize("a  ①") != f"{self.first}a{BLANK}{BLANK}①":
            raise ValueError("only vocabularies that leave characters and blanks as they are can be counted")

    def __missing__(self, unit: str) -> int:
        n = self.merge(unit)
        if len(unit) <= 32 and len(self) < REMEMBERED:
            self[unit] = n
        return n

    def merge(self, unit: str) -> int:
        rank, symbols = self.ranks.get, list(unit)
        end = len(symbols)
        count = sum(1 if s in self.ranks else len(s.encode()) for s in symbols)
        if end == 1:
            return count
        before, after = list(range(-1, end - 1)), list(range(1, end + 1))
        heap = []
        for i in range(end - 1):
            pair = symbols[i] + symbols[i + 1]
            r = rank(pair)
            if r is not None:
                heap.append((r, i, pair))
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            # a pair is stale once either of its symbols has grown or gone
            if symbols[i] is None or j == end or symbols[i] + symbols[j] != pair:
                continue
            count -= 1
            symbols[i], symbols[j] = pair, None
            k = after[i] = after[j]
            if k != end:
                before[k] = i
                right = pair + symbols[k]
                r = rank(right)
                if r is not None:
                    heapq.heappush(heap, (r, i, right))
            h = before[i]
            if h >= 0:
                left = symbols[h] + pair
                r = rank(left)
                if r is not None:
                    heapq.heappush(heap, (r, h, left))
        return count

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, self.units.findall(self.first + text.replace(" ", BLANK))))


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The worker's own copy, read once."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def _count(path: str, limit: int):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for table in slices(tables):
            texts = [t or "" for t in table.column("text").to_pylist()]
            counts = [known.count(t) for t in texts]
            yield extended(
                table, ("text",), n_bytes=pa.array([len(t.encode()) for t in texts], pa.int64()),
                n_tokens=pa.array(counts, pa.int64()), over_limit=pa.array([n > limit for n in counts], pa.bool_()),
            )

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; ``path`` names the vocabulary file, at the same place on every machine."""
    return documents(docs).mapInArrow(_count(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
