"""Conversation repair, spelling variants and personal data against plain one-by-one versions."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from reelgraph.llm import dialog_repair, pii, spelling
from reelgraph.llm.dialog_repair import Audits, Repair

# ---------------------------------------------------------------- conversation repair

TURNS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("fate", T.StringType()), T.StructField("copy", T.StringType()),
    T.StructField("audit", T.IntegerType()), T.StructField("repeated", T.StringType()),
])


def plain_repair(rows):
    """(faults, illegal, cost, audit, text) of rows (role, text) in order, from the last edit to the first with whole strings."""
    seen, facts = set(), []
    counts = dict(blank=0, duplicate=0, truncated=0)
    for role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        if fault:
            counts[fault] += 1
        seen.add((role, text))
        facts.append((role, text, fault))
    initials = [r[:1] for r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @lru_cache(None)
    def best(i, state, inserted):
        ways = []
        if i == len(facts) and state in ("", "a"):
            ways.append((0, "", ()))
        if inserted < 3:
            for role, letter in (("user", "u"), ("assistant", "a")):
                if letter in after[state]:
                    c, a, t = best(i, letter, inserted + 1)
                    ways.append((c + 2, "I" + a, (f"{role}:", *t)))
        if i < len(facts):
            role, text, fault = facts[i]
            c, a, t = best(i + 1, state, 0)
            ways.append((c + 3, "D" + a, t))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                for new, letter, cost in ((role, "K", 0), ("user", "R", 2), ("assistant", "R", 2)):
                    if new[:1] in after[state]:
                        c, a, t = best(i + 1, new[:1], 0)
                        ways.append((c + cost + extra, letter + a, (f"{new}:{text}", *t)))
        return min(ways, default=(10**9, "", ()))

    cost, audit, lines = best(0, "", 0)
    return counts, illegal, cost, audit, "\n".join(lines)


TEXTS = ("Yes.", "No!", "cut", " ", "", "Why? ", "open end\n")


def run_repair(rows, **options):
    lines, results = [], []
    for emit in (lambda n, edit, role, text: lines.append(f"{role}:{text}"), None):
        repair, seen = Repair(emit, **options), set()
        for k, (role, text) in enumerate(rows):
            repair.add(k, role, text, (role, text) in seen)
            seen.add((role, text))
        results.append(repair.result())
    assert results[0] == results[1]
    _, blank, duplicate, truncated, illegal, cost, audit, sha = results[0]
    assert sha == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return dict(blank=blank, duplicate=duplicate, truncated=truncated), illegal, cost, audit, "\n".join(lines)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "u"]), st.sampled_from(TEXTS)), max_size=9), st.sampled_from([1, 3, 4096]),
       st.sampled_from([2, 61]))
def test_repair_equals_plain_version(rows, settle, bits):
    """Also where rows are settled every one or three rows, and where nearly all hashes collide."""
    assert run_repair(rows, settle=settle, bits=bits) == plain_repair(rows)


def test_repair_of_long_conversations():
    rng = random.Random(4)
    rows = [(rng.choice(["user", "assistant", "assistant", "user", "system"]), f"{k} {rng.choice(TEXTS)}") for k in range(700)]
    got = run_repair(rows, settle=64)
    assert got == run_repair(rows, settle=100_000)
    assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in got[4].split("\n") if re.match("(user|assistant|system):", line)))


def test_settled_letters_are_put_away():
    """An undamaged conversation is settled as it goes; one that stays undecided to its end keeps letters, never texts."""
    held = {}
    for roles in (("user", "assistant"), ("user",)):
        repair = Repair(settle=128)
        for k in range(5_000):
            repair.add(k, roles[k % len(roles)], f"text {k}.", False)
            held[roles] = max(held.get(roles, 0), len(repair.audits.letter))
        assert not repair.waiting and len(repair.result()[6]) >= 5_000
    assert held["user", "assistant"] < 1_500 and held["user",] <= 4 * 5_000


def test_audits_compare_like_texts():
    rng = random.Random(8)
    for bits in (2, 61):
        audits, nodes = Audits(bits), [0]
        for _ in range(400):
            nodes.append(audits.add(rng.choice(nodes), rng.choice("DIKR")))
        for _ in range(3_000):
            a, b = rng.choice(nodes), rng.choice(nodes)
            assert audits.less(a, b) == (audits.text(a) < audits.text(b))


def turn_rows():
    rng = random.Random(2)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice(TEXTS), None, None, None, None))
    rows += [(None, 1, "user", "Hello.", *[None] * 4), (None, None, None, None, *[None] * 4), (7, None, "tool", "x", *[None] * 4), (7, 1, None, "Twice.", *[None] * 4)]
    rows += rows[:5] + [(99, 3, "user", "x" * 200_000, *[None] * 4)]
    return rows


def plain_damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = role if role is not None else " ", text if text is not None else " "
        m = zlib.crc32(key.encode()) % 20
        text = "" if m == 1 else re.sub("[.!?]", "", text) if m == 2 else text
        out += [(conv, turn, "user" if m == 4 else role, text)] * (0 if m == 0 else 2 if m == 3 else 1)
    return out


def test_damage_and_report(spark):
    rows = turn_rows()
    after = plain_damage(rows)
    want = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        counts, illegal, cost, audit, text = plain_repair([r[2:] for r in own])
        turns = {r[1] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        want[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    table = spark.createDataFrame(rows, TURNS).repartition(5)
    got = dialog_repair.repair_report(dialog_repair.damaged(table)).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == want and len(got) == len(want)
    lines = {}
    for r in sorted(dialog_repair.repaired_turns(dialog_repair.damaged(table)).collect(), key=lambda r: r.line):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, values in want.items():
        assert hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() == values[-1]


def test_repair_of_nothing(spark):
    assert dialog_repair.repair_report(dialog_repair.damaged(spark.createDataFrame([], TURNS))).count() == 0


# ---------------------------------------------------------------- spelling variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    out = {}
    for w, n in words.items():
        near = sorted((-m, v) for v, m in words.items() if one_edit(v, w))
        form = (near[0][1], -near[0][0]) if near and -near[0][0] >= 2 * n else (None, None)
        out[w] = (form[0], n, len(near), form[1])
    roots = {}
    for w in words:
        root = w
        while out[root][0]:
            root = out[root][0]
        roots[w] = root
    return {(w, form, roots[w], n, near, form_n) for w, (form, n, near, form_n) in out.items()}


def test_near_words_equal_all_pairs(spark):
    rng = random.Random(3)
    words = {}
    for alphabet, low, high, count in (("ab", 5, 8, 150), ("abcdé", 5, 7, 250), ("aö", 1, 4, 20), ("a", 30, 40, 8)):
        for _ in range(count):
            words["".join(rng.choice(alphabet) for _ in range(rng.randint(low, high)))] = 2 ** rng.randrange(9) + rng.randrange(3)
    words["x" * 50_000], words["x" * 49_999] = 9, 3
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    got = [tuple(r) for r in spelling.variants(table).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(words) and set(got) == plain_variants(words)


def test_words_of_documents(spark, docs, rows):
    counts = {}
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run
            if len(word) >= 5:
                counts[word] = counts.get(word, 0) + 1
    got = {r.word: r.n for r in spelling.word_counts(docs).collect()}
    assert got == counts
    found = {tuple(r) for r in spelling.spelling_variants(docs).collect()}
    assert found == plain_variants({w: n for w, n in counts.items() if n >= 3})


def test_variants_of_nothing(spark, no_docs):
    assert spelling.spelling_variants(no_docs).count() == 0


# ---------------------------------------------------------------- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for place, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
            good = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 14 <= len(digits) <= 19 and sum(v // 10 + v % 10 for v in doubled) % 10 == 0, "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), place, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["1", "25", "4111111111111111", "4539 1488", "0343-6467", ".", "@", "a", "b-c", " ", "  ", "+", "(", ")", "-", "é", "\n", "300", "x.y"]), max_size=24))
def test_base_spans_equal_the_plain_patterns(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == plain_spans(text)


@pytest.fixture(scope="module")
def model():
    return pii.train(pii.labelled_rows())


def test_gradient_of_the_likelihood():
    rng = np.random.default_rng(1)
    n = len(pii.LABELS)
    score, steps, first, last = rng.normal(size=(3, 4, n)), rng.normal(size=(n, n)), rng.normal(size=n), rng.normal(size=n)
    y = rng.integers(0, n, size=(3, 4))
    mask = np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0]], bool)
    value, *grads = pii.likelihood(score, y, mask, steps, first, last)
    for place, grad in enumerate(grads):
        for _ in range(6):
            at = tuple(rng.integers(0, k) for k in grad.shape)
            given_ = [score.copy(), steps.copy(), first.copy(), last.copy()]
            given_[place][at] += 1e-5
            more = pii.likelihood(given_[0], y, mask, *given_[1:])[0]
            assert abs((more - value) / 1e-5 - grad[at]) < 1e-3


def test_viterbi_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(2)
    n = len(pii.LABELS)
    crf = pii.Crf({}, rng.normal(size=(n, n)), rng.normal(size=n), rng.normal(size=n))
    scored = [rng.normal(size=(k, n)) for k in (1, 3, 2, 4, 1, 3)]
    for score, got in zip(scored, crf.decode(scored), strict=True):
        def worth(path, score=score):
            return sum(score[t, y] for t, y in enumerate(path)) + sum(crf.steps[a, b] for a, b in zip(path, path[1:], strict=False)) + crf.first[path[0]] + crf.last[path[-1]]
        assert tuple(got) == max(product(range(n), repeat=len(score)), key=worth)


def test_stretches_cover_the_words_with_a_digit_or_at():
    text = "a1 b2\tc d@ \n 3  4 é5é  6 x"
    words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text) if re.search("[0-9@]", m.group())]
    assert [w for s in pii.stretches(text) for w in s] == words
    assert [[text[a:b] for a, b in s] for s in pii.stretches(text)] == [["a1", "b2"], ["d@", "3", "4", "é5é", " 6"]]


def test_spans_on_unseen_rows(model):
    hit = found = wanted = 0
    for text, spans in pii.labelled_rows(400, seed=77):
        own = {s for s in spans if not any(b[1] < s[2] and b[2] > s[1] for b in plain_spans(text))}
        added = {s[:3] for s in pii.all_spans([text], model, {})[0] if not s[3]}
        hit, found, wanted = hit + len(own & added), found + len(added), wanted + len(own)
    assert hit >= 0.85 * wanted and hit >= 0.85 * found


def test_added_spans(model):
    def added(text):
        return [(s[0], text[s[1] : s[2]]) for s in pii.all_spans([text], model, {})[0] if not s[3]]

    assert added("call (743) 555-3824 now") == [("phone", "(743) 555-3824")]
    assert added("two cards 4465758382889437 4465758382889437 here") == [("card", "4465758382889437")] * 2
    assert added("on 2024-01-05 at 12:30 we sold 17 of 400 for $12.50, see page 1234567") == []
    assert added("words without any number") == []


def test_report(spark, docs, rows, model):
    table = docs.union(spark.createDataFrame([(5, t, *[None] * 8) for t in ("mail é a.b@c.de, 1.2.3.4", "+1 (743) 555-3824" * 3, "7" * 3_000)], docs.schema))
    texts = [(r[0], r[1]) for r in rows] + [(5, "mail é a.b@c.de, 1.2.3.4"), (5, "+1 (743) 555-3824" * 3), (5, "7" * 3_000)]
    want = []
    for doc_id, text in texts:
        base = plain_spans(text or "")
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        want.append((doc_id, *(sum(k == kind for k, _, _ in base) for kind in PATTERNS), digest))
    got = pii.report(table, model).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    assert all(set(",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(t or "")).split(",")) - {""} <= set(r.spans.split(","))
               for (_, t), r in zip(texts, got, strict=True) if t and "mail" in t)


def test_long_runs_are_read_once(model):
    for text in ("7" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" + " 2" * 150_000, "a@" * 100_000, "x" * 300_000 + "1"):
        assert isinstance(pii.all_spans([text], model, {}), list)


def test_report_of_nothing(spark, no_docs, model):
    assert pii.report(no_docs, model).count() == 0
    assert pii.fit(pii.labelled_table(spark, 0)).weights == {}


def test_hilbert_ranges_of_strings_follow_whole_values(spark):
    from reelgraph.llm import hilbert

    rows = [(None,)] * 3 + [(f"common_crawl_{i:03d}",) for i in range(64) for _ in range(2)] + [("",)] + [("zz",)] * 60
    table = spark.createDataFrame(rows, "source string").select(hilbert.ordinal("source", "string").alias("d0"))
    found = {r["value"]: r["range"] for r in hilbert.string_ranges(table, "d0", 5).collect()}
    order = ["null", *sorted({f"v{v}" for v, in rows if v is not None})]
    keys = ["null" if v is None else f"v{v}" for v, in rows]
    want = {k: sum(o < k for o in keys) * 32 // len(rows) for k in order}
    assert found == want and found["null"] == 0
    assert len({found[f"vcommon_crawl_{i:03d}"] for i in range(64)}) > 16


def test_hilbert_orders_null_before_negative_numbers_and_takes_dates(spark):
    import datetime

    from reelgraph.llm import hilbert

    days = [None, datetime.date(1950, 1, 1), datetime.date(2000, 1, 1)]
    docs = spark.createDataFrame(
        [(i, f"t{i}", None if i % 3 == 0 else -5 * i, days[i % 3]) for i in range(30)], "doc_id long, text string, number int, day date"
    )
    low = docs.select(hilbert.ordinal("number", "int").alias("n"), "number").orderBy("n").collect()
    assert [r["number"] for r in low[:10]] == [None] * 10
    made = hilbert.shards(docs, 4, ("number", "day")).collect()
    assert sorted(r["doc_id"] for r in made) == list(range(30))
    assert sorted(sum(r["shard"] == s for r in made) for s in range(4)) == [7, 7, 8, 8]
    assert hilbert.shards(docs, 4, ("day",)).count() == 30


def test_hilbert_handles_sources_of_one_prefix_and_an_empty_table(spark):
    from reelgraph.llm import hilbert

    docs = spark.createDataFrame([(i, f"text {i}", f"common_crawl_{i % 4}") for i in range(64)], "doc_id long, text string, source string")
    made = hilbert.shards(docs, 4, ("source",)).collect()
    by_shard = {s: {r["doc_id"] % 4 for r in made if r["shard"] == s} for s in range(4)}
    assert sorted(by_shard.values(), key=min) == [{0}, {1}, {2}, {3}]
    assert hilbert.shards(docs.limit(0), 4, ("source",)).collect() == []
