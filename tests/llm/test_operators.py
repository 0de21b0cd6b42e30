"""The other corpus operators against brute force, the tokenizers themselves, exact round trips or held-out accuracy."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from reelgraph.llm import hilbert, language, mixing, packing, syncmers, token_counts, url_filter, vptree

RANKS, JSON, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))


# packing


def test_packing_pieces_and_limits(docs, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    want = Counter()
    for doc, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want[doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    made = packing.pack_documents(docs, RANKS).collect()
    whole = Counter((r.doc_id, r.doc_tokens, r.ids_crc32) for r in made if r.length == r.doc_tokens)
    assert all(want[k] == n for k, n in whole.items())
    for doc, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for r in made:
            if r.doc_id == doc and r.doc_tokens == len(ids) > 2048:
                assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert sum(r.length for r in made) == sum(n * k for (_, n, _), k in want.items())
    sequences = defaultdict(list)
    for r in made:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048 and len(pieces) <= packing.MAX_SEGMENTS


def test_packing_of_nothing(no_docs):
    assert packing.pack_documents(no_docs, RANKS).collect() == []


def test_dot_product_pack_respects_every_limit():
    rng = np.random.default_rng(1)
    tokens = rng.integers(1, 2049, 3000)
    demands = np.stack([tokens, np.ones_like(tokens), (tokens * rng.random(3000) * 0.7).astype(int)], axis=1)
    capacity = np.array([2048, 6, 900])
    demands = demands[(demands <= capacity).all(axis=1)]
    sequence, place = packing.dot_product_pack(demands, capacity)
    for s in range(sequence.max() + 1):
        assert (demands[sequence == s].sum(axis=0) <= capacity).all()
        assert sorted(place[sequence == s]) == list(range((sequence == s).sum()))
    free, _ = packing.dot_product_pack(demands, np.array([2048, 300, 2048]))
    assert demands[:, 0].sum() / (2048 * (free.max() + 1)) > 0.97


def test_turns(spark):
    turns = spark.createDataFrame([(1, 10, 3), (2, 2000, 2000), (3, 9000, 1), (4, None, None)], "conv_id long, t long, l long")
    got = {r.key: r.sequence_id for r in packing.pack_turns(turns, "t", "l", "conv_id", 2048, 4, 2001).collect()}
    assert got[3] is None and got[1] != got[2] and None not in (got[1], got[2], got[4])


# language


def test_language_accuracy_and_edges(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", language.held_out())
    model = language.train(docs.where("not held_out"))
    assert (model.weights == 0).mean() > 0.5
    found = language.identify(docs, model, "doc_id", "lang", "held_out").collect()
    tested = [r for r in found if r.held_out and r.lang is not None]
    assert sum(r.lang == r.lang_pred for r in tested) >= 0.95 * len(tested)
    assert all(0 <= r.score <= 1 for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    odd = spark.createDataFrame([(1, None, 2**60 + 1), (None, "", 1), (3, "12 !?", None), (3, "the of and", 1)], "doc_id long, text string, score long")
    got = {(r.doc_id, r.lang_pred) for r in language.identify(odd, model, "doc_id").collect()}
    assert {(1, "und"), (None, "und"), (3, "und")} <= got and len(got) == 4
    assert {r[0] for r in language.identify(odd.withColumnRenamed("score", "n"), model, "n").collect()} == {2**60 + 1, 1, None}


def test_language_without_examples(docs, no_docs):
    model = language.train(no_docs)
    assert {(r.lang_pred, r.score) for r in language.identify(docs, model, "doc_id").collect()} == {("und", 0.0)}
    assert language.identify(no_docs, language.train(docs), "doc_id").collect() == []


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3)) * 2
    labels = np.array([rng.choice(3, p=language.softmax(x)) for x in logits])
    assert language.temperature(logits * 5, labels) == pytest.approx(5, rel=0.15)


# token counts


def test_token_counts_are_the_library_s(docs, rows, no_docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sorted((tuple(r) for r in token_counts.token_counts(docs, PIECES, 500).collect()), key=str)
    want = []
    for doc, text, *_ in rows:
        n = len(model.encode(text or ""))
        want.append((doc, len((text or "").encode()), n, n > 500))
    assert got == sorted(want, key=str)
    assert token_counts.token_counts(no_docs, PIECES).collect() == []


def test_heap_merges_random_texts():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    known, rng = token_counts.vocabulary(PIECES), random.Random(4)
    alphabet = "aaabcdeeeilmnoorst   ▁.,éü日\n\t\x00😀<>0x4"
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        assert known.count(text) == len(model.encode(text)), repr(text)
    for text in ("a" * 5000, " " * 777, "ab" * 3000, "日" * 500):
        assert known.count(text) == len(model.encode(text))


# URL rules


def brute_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:cut], rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), a, h + p) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_url_rules(spark):
    rng = random.Random(8)
    hosts = ["example.org", "a.example.org", "org", "ÉX.org", "B.COM", "x.com", "com", "notexample.org", "", "a..org"]
    paths = ["", "/", "/es/", "/en/1", "/en/12?x", "/fr/#top", "?q=/es/", "/de/x://y/z", "#f", "/E S/\n"]
    urls = [f"{s}://{h}{p}" for s in ("http", "https") for h in hosts for p in paths] + [None, "", "no scheme", "://", "a://b://c/es/"]
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "", "block"),
             ("example.org", "/es/", "allow"), ("a.example.org", "", "allow")]
    pages = spark.createDataFrame([(rng.randrange(5), u, "h", "r") for u in urls * 2], "page_id long, url string, host string, rule string")
    table = spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, action string")
    got = sorted(((r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, table).collect()), key=str)
    deduped = [r for r in rules if r != ("example.org", "/es/", "allow")]
    assert got == sorted((brute_rule(u, deduped) for u in urls * 2), key=str)
    assert {r.verdict for r in url_filter.judge(pages, table.limit(0)).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), table).collect() == []


def test_bloom_filter_has_no_false_negatives_and_few_positives(spark):
    listed = spark.range(2000).select(F.concat(F.lit("h"), "id").alias("host"), F.lit("/p").alias("path"))
    blocks = 2000 * url_filter.BITS_PER_KEY // 64
    bloom = url_filter.bloom_blocks(listed, blocks)
    tried = spark.range(12000).select(F.concat(F.lit("h"), "id").alias("host"), F.lit("/p").alias("path"), "id")
    block, bits = url_filter._block_and_bits("host", "path", blocks)
    passed = tried.withColumns({"block": block, "w": bits}).join(bloom, "block").where(F.col("bits").bitwiseAND(F.col("w")) == F.col("w"))
    ids = {r.id for r in passed.select("id").collect()}
    assert set(range(2000)) <= ids and len(ids) < 2000 + 0.05 * 10000


# fingerprints


def brute_anchors(text, k=syncmers.K, unit=syncmers.UNIT):
    parts = [w[i : i + unit] for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in text).split(" ") for i in range(0, len(w), unit)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    hashes = [h - 2**64 if h >= 2**63 else h for h in hashes]
    if len(hashes) < k:
        return ([(0, text)] if hashes else [])
    found = []
    for i in range(len(hashes) - k + 1):
        run = tuple(hashes[i : i + k])
        if min(run) in (run[0], run[-1]) and run not in found:
            found.append(run)
    return found or ["the run of least hash"]


def test_language_of_copies_is_learned(spark):
    rows = [(k, "le chat noir dort sur la table de la cuisine", "fr") for k in range(40)] + [(99, "les mêmes mots chaque fois", "it")] * 30
    rows += [(100 + k, f"the dog number {k} runs through the old town", "en") for k in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for per_language in range(1, 6):
        model = language.train(table, per_language=per_language)
        assert model.predict("le chat noir dort sur la table de la cuisine")[0] == "fr"
        assert model.predict("the dog number 3 runs through the old town")[0] == "en"


def test_fingerprints(spark, docs, rows, no_docs):
    got = syncmers.edit_report(docs).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, _signed(r[1] or "")))
    prints = {r.doc_id: r for r in got}
    for k, (doc, text, *_) in enumerate(order):
        if doc is None or sum(r[0] == doc for r in rows) > 1:
            continue
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        m = len(text) // 2
        edited = text[: len(text) - m] + after[:m]
        r = prints[doc]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, e, n = (brute_anchors(x) for x in (text, edited, after))
        assert len(r.fingerprint) == 8 * len(a) and len(r.edited_fingerprint) == 8 * len(e)
        if any(isinstance(x[0], str) for x in (a, e, n) if x):
            continue  # covered by test_short_texts_have_their_own_anchors
        near = lambda x, y: 1.0 if x == y else (len(set(x) & set(y)) / max(len(x), len(y)) if x and y else 0.0)
        assert r.near_edited == pytest.approx(near(a, e)) and r.near_next == pytest.approx(near(a, n))
    by_text = defaultdict(set)
    whole = {r[0]: r[1] for r in rows}
    for r in got:
        by_text[whole[r.doc_id] if r.doc_id is not None else None].add(r.fingerprint)
    assert all(len(v) == 1 for k, v in by_text.items() if k is not None)
    assert syncmers.edit_report(no_docs).collect() == []
    one = syncmers.edit_report(spark.createDataFrame([(7, "a b c d e f g h i j k")], "doc_id long, text string")).collect()
    assert one[0].near_next == 1.0
    plan = syncmers.edit_report(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_short_texts_have_their_own_anchors(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(7 + k % 3))) for k in range(300)] + [(900, "  "), (901, "")]
    got = {r.doc_id: r for r in syncmers.edit_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k].fingerprint for k, _ in rows[:300]) and got[900].fingerprint == got[901].fingerprint == ""
    assert len({got[k].fingerprint for k, _ in rows[:300]}) == 300
    assert max(got[k].near_next for k in range(299)) < 1 and got[900].near_next == 1.0 and got[299].near_next == 0.0


def _signed(text):
    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - 2**64 if h >= 2**63 else h


# shards


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 2), (4, 1)])
def test_hilbert_curve_steps_to_neighbours(spark, n, bits):
    cells = spark.range(1 << (bits * n))
    axes = [F.shiftright("id", bits * i).bitwiseAND(F.lit((1 << bits) - 1)) for i in range(n)]
    got = cells.select(*[a.alias(f"a{i}") for i, a in enumerate(axes)]).select(
        F.array(*[f"a{i}" for i in range(n)]).alias("a"), hilbert.hilbert_index([F.col(f"a{i}") for i in range(n)], bits).alias("h")
    ).sort("h").collect()
    assert [r.h for r in got] == list(range(1 << (bits * n)))
    for x, y in zip(got, got[1:]):
        assert sum(abs(p - q) for p, q in zip(x.a, y.a)) == 1


@pytest.mark.parametrize("shards", [4, 16, 200])
def test_shards(docs, rows, no_docs, shards):
    got = hilbert.shards(docs, shards).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows
    )
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(slots) <= set(range(shards))
    ranked = sorted(got, key=lambda r: r["rank"])
    assert [r.curve for r in ranked] == sorted(r.curve for r in got)
    seen = set()
    for x, y in zip(ranked, ranked[1:]):  # equal texts stand together
        if x.text_key != y.text_key:
            assert y.text_key not in seen
            seen.add(x.text_key)
    assert hilbert.shards(no_docs).collect() == []


def test_written_shards(spark, docs, rows, tmp_path):
    hilbert.write_shards(docs, hilbert.shards(docs, 4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and back.where("__shard is null").count() == 0


# neighbours


def brute_nearest(rows, every, k):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault(i, []).append(np.array(v, float))
    out = []
    for q in good:
        if q % every == 0:
            scored = sorted({(-float((v * good[q][0]).sum()), i) for i, vs in good.items() for v in vs if i != q and len(v) == len(good[q][0])})
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def vectors():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.4).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[3][1]) for i in range(70)]  # a large tie
    rows += [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [1.0, None] + [0.0] * 6), (2004, [float("nan")] * 8), (2005, [float("inf")] + [1.0] * 7),
             (None, rows[0][1]), (2010, [1.0, 2.0]), (2020, [3.0, 1.0]), rows[5], rows[5]]
    return rows


def test_exact_search(spark):
    rows = vectors()
    table = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    got = vptree.nearest(table, table.where("id % 10 = 0"), 20, 1.0, shard=200, block=30)
    assert sorted((r.query_id, r.rank, r.vec_id, pytest.approx(r.score, abs=1e-12)) for r in got.collect()) == brute_nearest(rows, 10, 20)
    assert vptree.nearest(table.limit(0), table.where("id = 10")).collect() == []
    assert vptree.nearest(table.where("id = 10"), table.where("id = 10")).collect() == []


def test_relaxed_search_keeps_recall(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vector")
    exact, relaxed = (
        {(r.query_id, r.vec_id) for r in vptree.nearest(table, table.where("id % 20 = 0"), 20, f, shard=150).collect()} for f in (1.0, 1.3)
    )
    assert len(exact & relaxed) >= 0.9 * len(exact)
    with pytest.raises(ValueError):
        vptree.nearest(table, table, factor=0.5)


# mixing


def brute_targets(sizes, weights, cap):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free) if free else 0
        above = [s for s in free if weight[s] * level > cap * sizes[s]]
        if not above:
            return fixed | {s: weight[s] * level for s in free}
        fixed |= {s: cap * sizes[s] for s in above}


def test_mixing(docs, rows, no_docs):
    mixed = mixing.mix(docs)
    got = mixed.select("row.doc_id", "row.source", "row.copies", F.col("size"), "source_size", "target", mixed["copies"].alias("k")).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    want = brute_targets(sizes, mixing.WEIGHTS, 3)
    assert len(got) == len(rows)
    taken, same_id = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.k <= 3
        taken[r.source] += r["size"] * r.k
        same_id[r.source, r.doc_id] += r["size"]  # repeated rows are taken alike
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(n for (source, _), n in same_id.items() if source == s)
    assert Counter((r.doc_id, r.k) for r in mixing.mix(docs.repartition(5)).select("row.doc_id", F.col("copies").alias("k")).collect()) == Counter((r.doc_id, r.k) for r in got)
    assert mixing.repeated(mixed).count() == sum(r.k for r in got)
    assert mixing.mix(no_docs).collect() == []


def test_all_sources_capped(spark):
    table = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string").withColumn("source", F.lit(None).cast("string"))
    assert {r.target for r in mixing.mix(table).collect()} == {3.0}
