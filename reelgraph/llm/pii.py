"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes for the ways of writing they miss.

Base spans, leftmost and non-overlapping per kind: e-mail addresses, IPv4 addresses (parts up to 255), card numbers (14 to 19 digits
passing Luhn), phone numbers with ``+`` (10 to 15 digits).  Matches that fail a test are dropped without another try.  They always stay.

The field labels the words ``[^\\x20\\x09-\\x0D]+`` of a text with O, B-kind or I-kind.  Its features are shapes: digits, letters and marks of a
word, its numbers of digits and groups, its ends, and the same of the words beside it.  It is trained here by gradient ascent on the exact
likelihood (forward-backward, L2 penalty) from a small labelled table; ``labelled_rows`` makes one by rule, a user may pass another.
Words with neither digit nor ``@`` are O by definition, so a text falls apart exactly into stretches of words that have one; all stretches
of a batch are decoded together by Viterbi in numpy, step by step over the longest.

A decoded span is added if it passes its kind's test (Luhn for cards, digits for phones, a valid address) and touches no other span.

Matching is linear in the text: where a pattern could try every start in a long run, the run is read once and judged after.

Nulls and edges: a null or empty text has no spans.  Positions count code points, ends exclusive.  Repeated rows each come back, null ids
too.  Columns other than doc_id and text are ignored.  No shuffle; the model has a few thousand numbers and goes to the tasks with the code.
"""

from __future__ import annotations

import ipaddress
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgraph.llm.common import documents, slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
BLANK = "\x20\x09-\x0d"
#: A run of local characters is read whole; where ``@`` and a domain follow, it is an address.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
IP = re.compile(r"[0-9]+(?:\.[0-9]+(?:\.[0-9]+(\.[0-9]+)?)?)?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TAIL = re.compile(f"[0-9@][^{BLANK}]*")
GAP = re.compile(f"[{BLANK}]+")
NEVER = -1e4
#: Labelled rows that training takes at most.
ROWS = 5_000

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        value = int(d) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns by start, then kind."""
    spans: list[Span] = []
    if "@" in text:
        spans += [("email", m.start(), m.end()) for m in EMAIL.finditer(text) if m.group(1)]
    if "." in text:
        for m in IP.finditer(text):
            if m.group(1) and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                spans.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            spans.append(("card", m.start(), m.end()))
    if "+" in text:
        spans += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


# ---------------------------------------------------------------- words and their shapes


def stretches(text: str) -> list[list[tuple[int, int]]]:
    """The (start, end) of words with a digit or ``@``, neighbours together."""
    found: list[list[tuple[int, int]]] = []
    last = 0
    for m in TAIL.finditer(text):
        start = m.start()
        while start > last and not (text[start - 1] == " " or "\t" <= text[start - 1] <= "\r"):
            start -= 1
        gap = GAP.match(text, last) if found else None
        if gap and gap.end() == start:
            found[-1].append((start, m.end()))
        else:
            found.append([(start, m.end())])
        last = m.end()
    return found


_NUMBER, _LETTERS, _MARKS = re.compile(r"[0-9]+"), re.compile(r"[^\W\d_]+"), re.compile(r"[^\w+\-.():@/%#$]+")
_EDGES = re.compile(r"^[^\w+(\[]+|[^\w)\]]+$")


def features(word: str) -> list[str]:
    """A word's shape, from fine to coarse."""
    core = _EDGES.sub("", word)
    numbers = _NUMBER.findall(core)
    coarse = _MARKS.sub("*", _LETTERS.sub("x", _NUMBER.sub("9", core)))
    fine = _NUMBER.sub(lambda m: "9" * min(len(m.group()), 5), _MARKS.sub("*", _LETTERS.sub("x", core)))
    digits = sum(map(len, numbers))
    bucket = sum(digits > b for b in (0, 2, 3, 4, 6, 9, 13, 19))
    return [
        "one", f"fine {fine}", f"coarse {coarse}", f"digits {bucket}", f"groups {min(len(numbers), 5)} {bucket}",
        f"first {core[:1] if core[:1] in '+([@' else 'x' if core[:1].isalpha() else '9'}", f"marks {''.join(sorted(set(coarse) - {'x', '9'}))}",
        f"letters {'x' in coarse} {bucket}", f"longest {min(max(map(len, numbers), default=0), 6)}",
    ]


BESIDE = "beside a plain word"


@dataclass
class Crf:
    """Weights by feature name: of the word itself, of the word before and of the word after; and of neighbouring labels."""

    weights: dict[str, np.ndarray]
    steps: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def _sum(self, side: str, names: Iterable[str]) -> np.ndarray:
        total = np.zeros(len(LABELS))
        for n in names:
            w = self.weights.get(f"{side} {n}")
            if w is not None:
                total += w
        return total

    def scores(self, words: list[str], cache: dict) -> np.ndarray:
        """Scores of all labels for each word of a stretch."""
        sides = []
        for w in words:
            s = cache.get(w)
            if s is None:
                names = features(w)
                s = tuple(self._sum(side, names) for side in ("own", "before", "after"))
                if len(cache) < 50_000 and len(w) <= 64:
                    cache[w] = s
            sides.append(s)
        edge = cache.get(BESIDE)
        if edge is None:
            edge = cache[BESIDE] = (None, self._sum("before", [BESIDE]), self._sum("after", [BESIDE]))
        out = np.array([s[0] for s in sides])
        out += np.array([edge[1], *(s[1] for s in sides[:-1])])
        out += np.array([*(s[2] for s in sides[1:]), edge[2]])
        return out

    def decode(self, scored: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of every stretch, all stretches at once: a step takes those that are long enough."""
        order = sorted(range(len(scored)), key=lambda i: -len(scored[i]))
        lengths = np.array([len(scored[i]) for i in order])
        if not len(order):
            return []
        alpha = np.array([scored[i][0] for i in order]) + self.first
        back: list[np.ndarray] = []
        for t in range(1, lengths[0]):
            n = int(np.searchsorted(-lengths, -t, side="left"))  # stretches longer than t
            ways = alpha[:n, :, None] + self.steps
            back.append(ways.argmax(axis=1))
            alpha[:n] = ways.max(axis=1) + np.array([scored[i][t] for i in order[:n]])
        label = (alpha + self.last).argmax(axis=1)
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(order)
        for at, i in enumerate(order):
            path = np.empty(lengths[at], np.int64)
            path[-1] = y = label[at]
            for t in range(lengths[at] - 1, 0, -1):
                y = path[t - 1] = back[t - 1][at, y]
            out[i] = path
        return out


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """Penalties of forbidden neighbours: I-kind only follows B-kind or I-kind of its kind."""
    n = len(LABELS)
    steps, first = np.zeros((n, n)), np.zeros(n)
    for j, to in enumerate(LABELS):
        if to[0] == "I":
            first[j] = NEVER
            for i, frm in enumerate(LABELS):
                if frm[2:] != to[2:]:
                    steps[i, j] = NEVER
    return steps, first


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def likelihood(score: np.ndarray, y: np.ndarray, mask: np.ndarray, steps: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Log likelihood of labels ``y`` [rows, length], and its gradients by the word scores, steps, first and last labels.

    ``score`` holds every label's score of a word [rows, length, labels] and ``mask`` which places are words.
    """
    rows, length, n = score.shape
    ends = mask.sum(axis=1) - 1
    at = np.arange(rows)
    alpha, beta = np.zeros_like(score), np.zeros_like(score)
    alpha[:, 0] = score[:, 0] + first
    for t in range(1, length):
        alpha[:, t] = np.where(mask[:, t, None], _log_sum(alpha[:, t - 1, :, None] + steps, 1) + score[:, t], 0.0)
    total = _log_sum(alpha[at, ends] + last, 1)
    for t in range(length - 1, -1, -1):
        after = _log_sum(steps + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2) if t + 1 < length else np.zeros((rows, n))
        beta[:, t] = np.where((ends == t)[:, None], last, after)
    belief = np.exp(np.where(mask[:, :, None], alpha + beta - total[:, None, None], NEVER))
    truth = np.eye(n)[y] * mask[:, :, None]
    value = (truth * score).sum() + first[y[:, 0]].sum() + last[y[at, ends]].sum() - total.sum()
    d_steps = np.zeros((n, n))
    for t in range(1, length):
        on = mask[:, t]
        both = alpha[:, t - 1, :, None] + steps + (score[:, t] + beta[:, t])[:, None, :] - total[:, None, None]
        pair = truth[on, t - 1][:, :, None] * truth[on, t][:, None, :]
        d_steps += (pair - np.exp(both[on])).sum(axis=0)
        value += (pair * steps).sum()
    d_score = truth - belief
    return value, d_score, d_steps, d_score[:, 0].sum(axis=0), (truth[at, ends] - belief[at, ends]).sum(axis=0)


def _examples(rows: Iterable[tuple[str, list[Span]]]) -> list[tuple[list[str], list[int]]]:
    """(words, labels) of every stretch of labelled texts."""
    out = []
    for text, spans in rows:
        for stretch in stretches(text):
            labels, open_span = [], None
            for start, end in stretch:
                span = next((s for s in spans if s[1] < end and s[2] > start), None)
                labels.append(0 if span is None else LABELS.index(f"{'I' if span == open_span else 'B'}-{span[0]}"))
                open_span = span
            out.append(([text[a:b] for a, b in stretch], labels))
    return out


def train(rows: Iterable[tuple[str, list[Span]]], rounds: int = 120, rate: float = 0.1, penalty: float = 0.02) -> Crf:
    """Fit the field to (text, spans) rows by Adam steps on the whole table."""
    examples = [e for e in _examples(rows) if e[0]]
    forbidden, no_start = _allowed()
    if not examples:
        return Crf({}, forbidden, no_start, np.zeros(len(LABELS)))
    names: dict[str, int] = {}
    active: list[tuple[int, int]] = []
    word = 0
    for words, _ in examples:
        shapes = [features(w) for w in words]
        for t in range(len(words)):
            before = shapes[t - 1] if t else [BESIDE]
            after = shapes[t + 1] if t + 1 < len(words) else [BESIDE]
            for side, found in (("own", shapes[t]), ("before", before), ("after", after)):
                active += [(word, names.setdefault(f"{side} {n}", len(names))) for n in found]
            word += 1
    x = np.zeros((word, len(names)))
    x[tuple(np.array(active).T)] = 1.0
    length = max(len(w) for w, _ in examples)
    y, mask = np.zeros((len(examples), length), np.int64), np.zeros((len(examples), length), bool)
    for r, (_, labels) in enumerate(examples):
        y[r, : len(labels)], mask[r, : len(labels)] = labels, True
    n = len(LABELS)
    p = [np.zeros((len(names), n)), np.zeros((n, n)), np.zeros(n), np.zeros(n)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    score = np.zeros((*y.shape, n))
    for k in range(1, rounds + 1):
        score[mask] = x @ p[0]
        _, d_score, *others = likelihood(score, y, mask, p[1] + forbidden, p[2] + no_start, p[3])
        for i, g in enumerate([x.T @ d_score[mask], *others]):
            g = g - penalty * p[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            p[i] += rate * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.99**k)) + 1e-8)
    return Crf({name: p[0][i] for name, i in names.items()}, p[1] + forbidden, p[2] + no_start, p[3])


# ---------------------------------------------------------------- the labelled table


def labelled_rows(count: int = 700, seed: int = 5) -> list[tuple[str, list[Span]]]:
    """A small labelled table made by rule: values of each kind in several ways of writing, and numbers that are none of them."""
    rng = random.Random(seed)

    def d(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def w(low: int = 2, high: int = 8) -> str:
        return "".join(rng.choice("abcdefghijklmnoprstuvwyéüñ") for _ in range(rng.randint(low, high)))

    def plain(low: int = 2, high: int = 8) -> str:
        return "".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randint(low, high)))

    def card(sep: str) -> str:
        body = rng.choice("45") + d(14)
        last = next(c for c in "0123456789" if luhn(body + c))
        number = body + last
        return sep.join(number[i : i + 4] for i in range(0, 16, 4))

    def octet() -> str:
        return str(rng.randint(0, 255))

    def group(n: int) -> str:
        return "".join(rng.choice("0123456789abcdef") for _ in range(n))

    values = {
        "email": [
            lambda: f"{plain()}@{plain()}.{rng.choice(('com', 'org', 'net', 'de'))}", lambda: f"{plain()}.{d(2)}@mail{d(1)}.{plain()}.com",
            lambda: f"{w()}@{w()}.{plain(2, 3)}", lambda: f"{plain()}_{plain()}@{plain()}", lambda: f"{plain()}{d(2)}@{w()}.{plain()}.{plain(2, 3)}",
        ],
        "ip": [
            lambda: ".".join(octet() for _ in range(4)), lambda: ":".join(group(4) for _ in range(8)),
            lambda: f"fe80::{group(4)}:{group(4)}:{group(4)}:{group(4)}", lambda: f"2001:db8:{group(4)}::{d(1)}",
        ],
        "card": [lambda: card(""), lambda: card(" "), lambda: card("-"), lambda: card("."), lambda: card("/")],
        "phone": [
            lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"({d(3)}){d(3)}-{d(4)}",
            lambda: f"+{d(2)} {d(3)} {d(7)}", lambda: f"+{d(2)} {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"{d(3)}.{d(3)}.{d(4)}",
            lambda: f"1-{d(3)}-{d(3)}-{d(4)}", lambda: f"+{d(2)}-{d(3)}-{d(4)}-{d(3)}",
        ],
    }
    others = [
        lambda: str(rng.randint(0, 99)), lambda: str(rng.randint(1900, 2030)), lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"{d(2)}/{d(2)}/{d(4)}",
        lambda: f"{d(2)}.{d(2)}.{d(4)}", lambda: f"{d(2)}:{d(2)}", lambda: f"{d(2)}:{d(2)}:{d(2)}", lambda: f"${d(2)}.{d(2)}", lambda: f"{d(2)}%",
        lambda: f"v{d(1)}.{d(1)}.{d(2)}", lambda: f"{d(1)}.{d(1)}.{d(1)}", lambda: f"{d(1)}.{d(5)}", lambda: f"#{d(6)}", lambda: f"{d(2)}-{d(2)}",
        lambda: group(40), lambda: f'"{group(40)}"', lambda: group(16), lambda: d(rng.randint(5, 13)), lambda: d(rng.randint(20, 40)), lambda: f"{plain()}{d(3)}",
        lambda: f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", lambda: f"{group(8)}-{group(4)}-{group(4)}-{group(4)}-{group(12)}", lambda: f"@{plain()}", lambda: f"{plain()}@",
        lambda: f"{d(1)},{d(3)},{d(3)}", lambda: f"({d(1)})", lambda: f"({d(4)})", lambda: f"[{d(2)}]", lambda: f"{d(2)} {d(2)} {d(2)}", lambda: f"{d(3)} {d(3)} {d(3)}",
        lambda: f"{d(1)} {d(2)} {d(4)}", lambda: f"{d(4)} {d(4)}", lambda: f"{d(1)}x{d(1)}", lambda: f"{plain()}-{d(2)}", lambda: f"§{d(3)}", lambda: f"{d(3)}-{d(4)}",
        lambda: f"{d(2)}.{d(3)}.{d(3)}", lambda: f"1.{d(1)}.{d(1)}.{d(1)}.{d(1)}", lambda: f"{plain()}/{d(4)}.{d(5)}", lambda: f"-{d(2)}", lambda: f"+{d(1)}",
    ]
    rows = []
    for _ in range(count):
        text, spans = " ".join(w() for _ in range(rng.randint(0, 4))), []
        for _ in range(rng.randint(1, 3)):
            kind = rng.choice([*KINDS, "other", "other", "other", "other"])
            value = rng.choice(values.get(kind, others))()
            before, after = rng.choice(("", "", "", "(", '"', "<")), rng.choice(("", "", "", ".", ",", ")", "###", "&&&", '"', ">", ":"))
            text += (" " if text else "") + before
            if kind in KINDS:
                spans.append((kind, len(text), len(text) + len(value)))
            text += value + after
            if rng.random() < 0.8:
                text += " " + " ".join(w() for _ in range(rng.randint(1, 3)))
        rows.append((text, spans))
    return rows


def labelled_table(spark: SparkSession, count: int = 700, seed: int = 5) -> DataFrame:
    """(text, spans) of ``labelled_rows``."""
    return spark.createDataFrame(labelled_rows(count, seed), "text string, spans array<struct<kind:string, start:long, end:long>>")


def fit(labelled: DataFrame, rows: int = ROWS) -> Crf:
    """Train on at most ``rows`` rows of a labelled table (text, spans), those that come first by text."""
    taken = labelled.where("text is not null").orderBy("text").limit(rows).collect()
    return train([(r["text"], [tuple(s) for s in r["spans"] or []]) for r in taken])


# ---------------------------------------------------------------- spans


def _added(text: str, words: list[tuple[int, int]], labels: np.ndarray, taken: list[Span]) -> list[Span]:
    """The labelled spans of one stretch that pass their kind's test and touch none of ``taken``."""
    spans: list[Span] = []
    t = 0
    while t < len(words):
        name = LABELS[labels[t]]
        end = t + 1
        if name != "O":
            while end < len(words) and LABELS[labels[end]] == f"I-{name[2:]}":
                end += 1
            span = _trimmed(text, name[2:], words[t][0], words[end - 1][1])
            if span and not any(s[1] < span[2] and s[2] > span[1] for s in taken):
                spans.append(span)
        t = end
    return spans


def _trimmed(text: str, kind: str, start: int, end: int) -> Span | None:
    """The span without marks around it, if what is left is of its kind."""
    heads = "+(" if kind == "phone" else ""
    while start < end and not (text[start].isalnum() or text[start] in heads):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    if text[start:end].startswith("(") and ")" not in text[start:end]:
        start += 1
    value = text[start:end]
    digits = _digits(value)
    if kind == "card":
        good = 14 <= len(digits) <= 19 and luhn(digits) and not any(c.isalpha() for c in value)
    elif kind == "phone":
        good = 10 <= len(digits) <= 15 and not any(c.isalpha() for c in value)
    elif kind == "email":
        good = 0 < value.find("@") < len(value) - 1
    else:
        try:
            good = bool(ipaddress.ip_address(value))
        except ValueError:
            good = False
    return (kind, start, end) if good else None


def all_spans(texts: list[str | None], model: Crf, cache: dict) -> list[list[tuple[str, int, int, bool]]]:
    """Each text's (kind, start, end, whether a fixed pattern found it), by start and kind."""
    base = [base_spans(t) if t else [] for t in texts]
    places, scored = [], []
    for i, text in enumerate(texts):
        for words in stretches(text) if text else []:
            places.append((i, words))
            scored.append(model.scores([text[a:b] for a, b in words], cache))
    out = [[(*s, True) for s in spans] for spans in base]
    for (i, words), labels in zip(places, model.decode(scored), strict=True):
        if labels.any():
            low, high = words[0][0], words[-1][1]
            near = [s for s in base[i] if s[1] < high and s[2] > low]
            out[i] += [(*s, False) for s in _added(texts[i], words, labels, near)]
    return [sorted(s, key=lambda x: (x[1], KINDS.index(x[0]))) for s in out]


SPANS = "array<struct<kind:string, start:long, end:long, base:boolean>>"


def find(docs: DataFrame, model: Crf) -> DataFrame:
    """(doc_id, spans): the personal data of every whole text; ``base`` tells what the fixed patterns found."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for table in slices(tables):
            found = all_spans(table.column("text").to_pylist(), model, cache)
            offsets = np.cumsum([0, *map(len, found)])
            flat = [s for spans in found for s in spans]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_())
            parts = [pa.array([s[k] for s in flat], t) for k, t in enumerate(kinds)]
            spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, ["kind", "start", "end", "base"]))
            yield pa.RecordBatch.from_arrays([table.column("doc_id"), spans], names=["doc_id", "spans"])

    return documents(docs).mapInArrow(run, f"doc_id long, spans {SPANS}")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, model: Crf) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of the base spans, and all spans as text."""
    found = find(docs, model).withColumn("base", F.filter("spans", lambda s: s["base"]))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
