"""Graph operators on small fixtures, with brute-force models of the order-dependent ones."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from reelgraph.operators import extraction, folding, graph_algorithms as ga, graph_search as gs, linking, resolution as rs


@pytest.fixture(scope="module")
def small(spark):
    e = spark.createDataFrame(
        [("person_001", "John Smith", "PERSON", "A person wearing blue shirt", 0.85), ("object_001", "Red Car", "OBJECT", "A red sedan car", 0.9),
         ("action_001", "Walking", "ACTION", "Person walking on sidewalk", 0.75)],
        "entity_id string, name string, entity_type string, description string, confidence double",
    )
    r = spark.createDataFrame(
        [("rel_001", "person_001", "action_001", "PERFORMS", "", 0.8), ("rel_002", "person_001", "object_001", "INTERACTS_WITH", "", 0.7)],
        "relation_id string, source_entity string, target_entity string, relation_type string, description string, confidence double",
    )
    a = spark.createDataFrame(
        [("person_001", "video_001", 10.0, 25.0), ("object_001", "video_001", 12.0, 30.0), ("action_001", "video_001", 10.0, 20.0)],
        "entity_id string, video_id string, start_time double, end_time double",
    )
    return e, r, a


def test_statistics(spark, small):
    e, r, _ = small
    s = ga.degree_stats(e, r).first()
    assert (s["vertices"], s["edges"], round(s["density"], 6), round(s["mean_degree"], 6)) == (3, 2, 0.666667, 1.333333)
    c = ga.component_stats(ga.connected_components(e.select("entity_id"), r)).first()
    assert (c["components"], c["largest_component"]) == (1, 3)


def test_empty_graph(spark, small):
    e, r, _ = small
    e, r = e.filter("false"), r.filter("false")
    s = ga.degree_stats(e, r).first()
    assert (s["vertices"], s["edges"], s["density"], s["mean_degree"]) == (0, 0, 0.0, 0.0)
    assert ga.component_stats(ga.connected_components(e.select("entity_id"), r)).first()["components"] == 0


def test_queries_and_neighbourhood(small):
    e, r, a = small
    assert [x["entity_id"] for x in gs.query_entities(e, None, "PERSON").collect()] == ["person_001"]
    rings = ga.neighbourhood(e, r, "person_001", 2).collect()
    for ring in (1, 2):
        assert {x["entity_id"] for x in rings if x["ring"] == ring} == {"action_001", "object_001"}
    assert ga.neighbourhood(e, r, "nobody", 2).count() == 0
    assert ga.shortest_paths(e, r, "person_001", 2).count() == 2
    near = gs.related_entities(r, e, e.filter("entity_id = 'person_001'").select("entity_id")).orderBy(F.desc("strength")).collect()
    assert [(x["other_id"], x["strength"]) for x in near] == [("action_001", 0.8), ("object_001", 0.7)]


def test_co_occurrence(small):
    rows = ga.co_occurrences(small[2], "person_001", 30.0).collect()
    assert [(r["entity_id"], r["total_overlap"], r["min_time_difference"]) for r in rows] == [("object_001", 13.0, 2.0), ("action_001", 10.0, 0.0)]


def test_co_occurrence_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        s = rng.randrange(0, 200)
        rows.append((f"e{rng.randrange(5)}", f"v{rng.randrange(2)}", float(s), float(s + rng.choice([0, 1, 5, 80]))))
    want = {}
    for t in rows:
        for o in rows:
            if t[0] == "e0" and o[0] != "e0" and t[1] == o[1]:
                gap = min(abs(t[2] - o[2]), abs(t[3] - o[3]))
                lap = min(t[3], o[3]) - max(t[2], o[2])
                if gap <= 7 and lap > 0:
                    n, total, least = want.get(o[0], (0, 0.0, 1e9))
                    want[o[0]] = (n + 1, total + lap, min(least, gap))
    df = spark.createDataFrame(rows, "entity_id string, video_id string, start_time double, end_time double")
    got = {r["entity_id"]: (r["overlaps"], r["total_overlap"], r["min_time_difference"]) for r in ga.co_occurrences(df, "e0", 7.0).collect()}
    assert got == want


def test_clean_up(spark, small):
    e, r, _ = small
    weak = e.withColumn("confidence", F.when(F.col("entity_id") == "person_001", 0.2).otherwise(F.col("confidence")))
    kept_e, kept_r = ga.clean_up(weak, r, 0.3)
    assert kept_e.count() == 2 and kept_r.count() == 0


def test_components_against_union_find(spark):
    rng = random.Random(7)
    nodes = [f"n{i:03d}" for i in range(150)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(110)] + [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40, 80)]
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    want = {n: find(n) for n in nodes}
    v = spark.createDataFrame([(n,) for n in nodes], "entity_id string")
    r = spark.createDataFrame(edges, "source_entity string, target_entity string")
    got = {x["entity_id"]: x["component"] for x in ga.connected_components(v, r).collect()}
    assert got == want


def test_density_counts_busier_direction(spark):
    e = spark.createDataFrame([("a",), ("b",)], "entity_id string")
    r = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "a"), ("a", "a")], "source_entity string, target_entity string")
    assert ga.degree_stats(e, r).first()["edges"] == 3


def test_group_merge(spark):
    rows = [
        ("1", "x1", "John Smith", "PERSON", "A person wearing blue shirt", 0.85, "video_001"),
        ("2", "x2", "john smith", "PERSON", "Same person in different video", 0.8, "video_002"),
        ("3", "x3", "Alone", "PERSON", "", 0.5, "video_001"),
    ]
    m = spark.createDataFrame(rows, "seq string, entity_id string, name string, entity_type string, description string, confidence double, video_id string")
    merged = {r["name_key"]: r for r in rs.merge_mentions(m).collect()}
    assert merged["john smith"]["entity_id"] == "x1" and round(merged["john smith"]["confidence"], 6) == 0.825
    assert {(r["name_key"], r["alias"]) for r in rs.mention_aliases(m).collect()} == {("john smith", "John Smith"), ("john smith", "john smith")}
    texts = [r["description"] for r in rs.mention_descriptions(m).orderBy("seq").collect()]
    assert " | ".join(texts) == "A person wearing blue shirt | Same person in different video"


def test_fold_confidence_against_loop(spark):
    rng = random.Random(11)
    versions, chunks, want = [], [], {}
    for e in range(6):
        seen, conf = set(), None
        for seq in sorted(rng.sample(range(3000), rng.randint(1, 25))):
            own = {f"c{rng.randrange(12)}" for _ in range(rng.choice([0, 1, 3, 6]))}
            c = round(rng.random(), 3)
            versions.append((f"e{e}", seq, c))
            chunks += [(f"e{e}", seq, x) for x in own]
            if conf is None:
                conf, seen = c, set(own)
            else:
                seen |= own
                if seen:
                    conf = (conf * (len(seen) - len(own)) + c * len(own)) / len(seen)
        want[f"e{e}"] = conf
    v = spark.createDataFrame(versions, "entity_id string, seq long, confidence double")
    k = spark.createDataFrame(chunks, "entity_id string, seq long, chunk_id string")
    for span in (4, 1024):
        got = {r["entity_id"]: r["confidence"] for r in rs.fold_confidence(v, k, span=span).collect()}
        assert set(got) == set(want) and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_fold_descriptions_against_loop(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for e in range(20):
        merged = ""
        for seq in range(rng.randint(1, 8)):
            d = rng.choice(["", "a", "a", "b", "c"])
            rows.append((f"e{e}", seq, d))
            if d and d != merged:
                merged = f"{merged} | {d}" if merged else d
        want[f"e{e}"] = merged
    kept = rs.fold_descriptions(spark.createDataFrame(rows, "entity_id string, seq int, description string")).collect()
    got = {e: " | ".join(r["description"] for r in sorted((r for r in kept if r["entity_id"] == e), key=lambda r: r["seq"])) for e in want}
    assert got == want


def test_running_sum_and_gaps(spark):
    rng = random.Random(2)
    rows = [(f"k{rng.randrange(3)}", i, rng.randrange(9)) for i in rng.sample(range(500), 120)]
    df = spark.createDataFrame(rows, "k string, seq long, v long")
    got = {(r["k"], r["seq"]): r["s"] for r in folding.running_sum(df, ["k"], "seq", "v", "s", span=16).collect()}
    for k, seq, _ in rows:
        assert got[(k, seq)] == sum(v for kk, s, v in rows if kk == k and s <= seq)
    gaps = {(r["k"], r["seq"]): r["g"] for r in folding.gap_to_next(df, "k", "seq", "g", 16).collect()}
    for k, seq, _ in rows:
        later = [s for kk, s, _ in rows if kk == k and s > seq]
        assert gaps[(k, seq)] == (min(later) - seq if later else None)


def test_dense_index_is_a_bijection(spark):
    df = spark.range(5000).select(F.concat(F.lit("v"), F.col("id") % 700).alias("video_id"))
    rows = folding.dense_index(df, "video_id", "seq").collect()
    assert sorted(r["seq"] for r in rows) == list(range(700)) and len({r["video_id"] for r in rows}) == 700


def _similarity(a, b):
    def lev(x, y):
        row = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            prev, row[0] = row[0], i
            for j, q in enumerate(y, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (p != q))
        return row[-1]

    def s(x, y):
        return 1.0 if x == y else (0.0 if not x or not y else 1 - lev(x, y) / max(len(x), len(y)))

    alias = max((s(x.lower(), y.lower()) for x in a["aliases"] for y in b["aliases"]), default=0.0)
    wa, wb = set(a["description"].lower().split()), set(b["description"].lower().split())
    desc = len(wa & wb) / len(wa | wb) if wa and wb else 0.0
    return s(a["name"].lower(), b["name"].lower()) * 0.4 + alias * 0.2 + desc * 0.4


@pytest.fixture(scope="module")
def crowd():
    rng = random.Random(9)
    words = ["tall", "man", "hat", "red", "walks"]
    out = []
    for i in range(80):
        name = rng.choice(["John Smith", "Jon Smith", "Jane Doe", "Janet Doe"]) + f" {i % 13}"
        out.append({
            "id": f"e{i:02d}", "type": rng.choice(["PERSON", "OBJECT"]), "name": f"{name}{chr(97 + i % 7)}",
            "description": " ".join(rng.sample(words, rng.choice([0, 3, 4, 5, 5]))),
            "aliases": [name] if rng.random() < 0.85 else [], "videos": rng.sample(["v1", "v2", "v3"], rng.randint(0, 2)),
        })
    return out


def _crowd_tables(spark, crowd):
    e = spark.createDataFrame([(x["id"], x["name"], x["type"], x["description"]) for x in crowd], "entity_id string, name string, entity_type string, description string")
    a = spark.createDataFrame([(x["id"], n) for x in crowd for n in x["aliases"]], "entity_id string, alias string")
    v = spark.createDataFrame([(x["id"], n) for x in crowd for n in x["videos"]], "entity_id string, video_id string")
    return e, a, v


def _crowd_pairs(crowd, threshold=0.8):
    return [
        (a["id"], b["id"], _similarity(a, b)) for a, b in itertools.combinations(crowd, 2)
        if a["type"] == b["type"] and set(a["videos"]) != set(b["videos"]) and _similarity(a, b) >= threshold - 1e-12
    ]


@pytest.mark.parametrize("threshold", [0.79, 0.62])
def test_link_candidates_below_the_default_threshold(spark, crowd, threshold):
    """Entities without aliases link too."""
    rows = linking.link_candidates(*_crowd_tables(spark, crowd), threshold).collect()
    want = {(a, b): round(s, 9) for a, b, s in _crowd_pairs(crowd, threshold)}
    bare = {x["id"] for x in crowd if not x["aliases"]}
    assert {(r["primary"], r["secondary"]): round(r["similarity"], 9) for r in rows} == want
    assert threshold > 0.7 or any(bare & set(pair) for pair in want)
    with pytest.raises(ValueError):
        linking.link_candidates(*_crowd_tables(spark, crowd), 0.6)


@pytest.mark.parametrize("block", [3, 1024])
def test_link_candidates_equal_all_pairs(spark, crowd, block, monkeypatch):
    monkeypatch.setattr(linking, "BLOCK", block)
    got = {(r["primary"], r["secondary"]): round(r["similarity"], 9) for r in linking.link_candidates(*_crowd_tables(spark, crowd)).collect()}
    want = {(a, b): round(s, 9) for a, b, s in _crowd_pairs(crowd)}
    assert len(want) > 10 and got == want


def _greedy(pairs):
    dead, done = set(), []
    for p, s, sim in sorted(pairs, key=lambda x: (-x[2], x[0], x[1])):
        if p not in dead and s not in dead:
            dead.add(s)
            done.append((p, s))
    return done


def test_greedy_equals_one_by_one(spark):
    rng = random.Random(4)
    for _ in range(3):
        pairs = {}
        for _ in range(90):
            a, b = sorted(rng.sample(range(25), 2))
            pairs[(f"n{a:02d}", f"n{b:02d}")] = rng.choice([0.8, 0.85, 0.9, 0.95])
        rows = [(a, b, s) for (a, b), s in pairs.items()]
        merges = linking.greedy_merges(spark.createDataFrame(rows, "primary string, secondary string, similarity double"))
        want = _greedy(rows)
        assert {(r["primary"], r["secondary"]) for r in merges.collect()} == set(want)
        target = {s: p for p, s in want}

        def end(x):
            while x in target:
                x = target[x]
            return x

        assert {r["entity_id"]: r["target"] for r in linking.final_targets(merges).collect()} == {s: end(s) for s in target}


def test_greedy_settles_long_chains_in_few_rounds(spark):
    """Chains of waiting pairs, forwards and through a hot entity, in rounds that grow with the logarithm of their length."""
    n = 5000
    chain = [(f"n{i:05d}", f"n{i + 1:05d}", 1 - i / (4 * n)) for i in range(n)]
    hot = [("a", f"m{i:05d}", 0.9) for i in range(300)] + [(f"m{i:05d}", f"n{i:05d}", 0.85) for i in range(300)]
    rows = chain + hot
    df = spark.createDataFrame([*rows, rows[0], (None, "x", 1.0), ("x", "y", None)], "primary string, secondary string, similarity double")
    got = {(r["primary"], r["secondary"]) for r in linking.greedy_merges(df, max_rounds=30).collect()}
    assert got == set(_greedy(rows))
    with pytest.raises(RuntimeError):
        linking.greedy_merges(df.filter("secondary like 'n0000%'"), max_rounds=1)


def test_merged_confidence_against_loop(spark):
    rng = random.Random(6)
    conf = {f"n{i:02d}": round(rng.random(), 3) for i in range(15)}
    chunks = {n: {f"c{rng.randrange(9)}" for _ in range(rng.randint(1, 4))} for n in conf}
    rows = [(f"n{a:02d}", f"n{b:02d}", rng.choice([0.8, 0.9])) for a, b in {tuple(sorted(rng.sample(range(15), 2))) for _ in range(30)}]
    state, sets = dict(conf), {n: set(c) for n, c in chunks.items()}
    for p, s in _greedy(rows):
        sets[p] |= sets[s]
        n, u = len(sets[s]), len(sets[p])
        state[p] = (state[p] * (u - n) + state[s] * n) / u
        del state[s]
    e = spark.createDataFrame(list(conf.items()), "entity_id string, confidence double")
    k = spark.createDataFrame([(n, c) for n in chunks for c in chunks[n]], "entity_id string, chunk_id string")
    merges = linking.greedy_merges(spark.createDataFrame(rows, "primary string, secondary string, similarity double"))
    got = {r["entity_id"]: r["confidence"] for r in linking.merged_confidence(e, k, merges).collect()}
    assert set(got) == set(state) and all(abs(got[n] - state[n]) < 1e-9 for n in state)


def test_redirect_relations(spark):
    r = spark.createDataFrame([("r1", "a", "b"), ("r2", "b", "c"), ("r3", "b", "b")], "relation_id string, source_entity string, target_entity string")
    t = spark.createDataFrame([("b", "z")], "entity_id string, target string")

    def ends(compat):
        return {x["relation_id"]: (x["source_entity"], x["target_entity"]) for x in linking.redirect_relations(r, t, compat).collect()}

    assert ends(False) == {"r1": ("a", "z"), "r2": ("z", "c"), "r3": ("z", "z")}
    assert ends(True)["r3"] == ("z", "b")


def test_extraction_edge_cases(spark):
    rows = [
        ("c1", "invalid json data"),
        ("c2", '```json\n{"entities":[{"name":"Cat"},{"name":"Hat","type":"WEIRD"},{"name":"Dog","type":"person","confidence":"0.4"}],'
               '"relations":[{"source":"Cat","target":"Dog"},{"source":"Cat","target":"Hat"}]}\n```'),
        ("c3", "{}"),
    ]
    df = spark.createDataFrame(rows, "chunk_id string, response string").select(
        "*", F.lit("v").alias("video_id"), F.lit(0.0).alias("start_time"), F.lit(30.0).alias("end_time")
    )
    parsed = extraction.parse_responses(df)
    e = extraction.entity_mentions(parsed).orderBy("chunk_id", "place").collect()
    assert [(x["name"], x["entity_type"], x["confidence"]) for x in e] == [("Cat", "OBJECT", 0.7), ("Dog", "PERSON", 0.4)]
    r = extraction.relation_mentions(parsed).collect()
    assert [(x["relation_type"], x["confidence"]) for x in r] == [("ASSOCIATED_WITH", 0.7)] and r[0]["source_entity"] == e[0]["entity_id"]


def test_build_and_link_graph(spark):
    from reelgraph.plans.knowledge import build_graph, entity_texts

    def body(name, text):
        return f'{{"entities":[{{"name":"{name}","type":"PERSON","description":"{text}"}},{{"name":"Park","type":"LOCATION"}}],"relations":[{{"source":"{name}","target":"Park","type":"LOCATED_IN"}}]}}'

    rows = [
        ("a1", "va", body("John Smith", "tall man with hat")), ("a2", "va", body("john smith", "tall man with hat")),
        ("b1", "vb", body("John Smithe", "tall man with hat")), ("b2", "vb", body("JOHN SMITHE", "tall man with hat")),
    ]
    df = spark.createDataFrame(rows, "chunk_id string, video_id string, response string").select(
        "*", F.lit(0.0).alias("start_time"), F.lit(30.0).alias("end_time")
    )
    plain, linked = build_graph(df, link=False), build_graph(df)
    assert plain.entities.count() == 3 and linked.entities.count() == 2
    assert linked.entity_videos.filter("video_id in ('va', 'vb')").count() == 4
    assert {r["name"] for r in linked.entities.collect()} >= {"Park"}
    assert linked.relations.select("source_entity").distinct().count() == 1
    assert entity_texts(linked).count() == 2


def test_whole_graph_components_against_union_find(spark, sf):
    """All relations count, CONTAINS too."""
    import __spark_entry__
    from reelgraph.sources import driver_tables as dt

    e = [x[0] for x in dt.entities(spark, sf).select("entity_id").collect()]
    r = [tuple(x) for x in dt.relations(spark, sf).select("source_entity", "target_entity", "relation_type").collect()]
    root = {v: v for v in [*e, *(x for pair in r for x in pair[:2])]}

    def find(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for a, b, _ in r:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {x.entity_id: x.component for x in __spark_entry__.queries()["whole_graph_components"](spark, sf).collect()}
    assert got == {v: find(v) for v in root}
    parts = {a if a.startswith("P") else b for a, b, kind in r if kind == "CONTAINS"}
    assert parts and all(got[v] != v for v in parts if find(v) != v) and len({got[v] for v in parts}) < len(parts)


def test_relations_are_dealt_before_they_are_ranked(spark):
    """No task sorts both ends of all the relations it read: they are dealt by their other end first, with the same result."""
    e = spark.createDataFrame([(f"n{i}", f"name {i}", "", 0.5) for i in range(40)], "entity_id string, name string, description string, confidence double")
    rows = [(f"r{i:04d}", f"n{i % 37}", f"n{i * i % 45}", "IS", (i * 7 % 11) / 10) for i in range(600)]
    r = spark.createDataFrame(rows, "relation_id string, source_entity string, target_entity string, relation_type string, confidence double")
    found = gs.related_entities(r, e, k=3, described=False)
    ends = [(a, b, c, i) for i, a, b, _, c in rows] + [(b, a, c, i) for i, a, b, _, c in rows if a != b]
    want = {}
    for a, b, c, i in sorted((x for x in ends if int(x[1][1:]) < 40), key=lambda x: (x[0], -x[2], x[1], x[3])):
        want.setdefault(a, []).append((b, i))
    got = {}
    for x in sorted(found.collect(), key=lambda x: x["place"]):
        got.setdefault(x["entity_id"], []).append((x["other_id"], x["relation_id"]))
    assert got == {a: b[:3] for a, b in want.items()}
    assert "hashpartitioning(other_id" in found._jdf.queryExecution().executedPlan().toString()


def test_responses_are_parsed_once(spark, sf):
    from reelgraph.plans.knowledge import graph_from_responses
    from reelgraph.workload import graphs

    g = graph_from_responses(graphs.responses(spark, sf))
    for rows in (g.entities, g.entity_videos, g.aliases, g.relations):
        assert "from_json" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert g.entities.count() > 0


def test_components_of_linked_stars_take_two_rounds(spark, monkeypatch):
    """Vertices smaller than all their neighbours join a tree too, in the first round."""
    rows = [(f"S{i}", f"P{i * 7 % 50 + j}") for i in range(30) for j in range(5)] + [(f"S{i}", f"N{i % 3}") for i in range(30)] + [("X", "Y")]
    r = spark.createDataFrame(rows, "source_entity string, target_entity string")
    v = r.select(F.col("source_entity").alias("entity_id")).union(r.select("target_entity")).union(spark.createDataFrame([("alone",)], "id string")).distinct()
    written, cut = [], ga.cut_lineage
    monkeypatch.setattr(ga, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    got = dict(map(tuple, ga.connected_components(v, r).collect()))
    root = {x: x for x in got}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in rows:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    assert got == {x: top(x) for x in got}
    assert sum(c == ["u", "v"] for c in written) == 3  # given, between the three trees of the first round, none


def test_confidence_of_versions_takes_no_outer_join(spark):
    rows = [("a", 3, 0.5), ("a", 1, 0.9), ("b", 2, 0.4)]
    versions = spark.createDataFrame(rows, "entity_id string, seq long, confidence double")
    chunks = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 3, "x"), ("a", 3, "z"), ("b", 7, "x")], "entity_id string, seq long, chunk_id string")
    made = rs.fold_confidence(versions, chunks)
    assert "LeftOuter" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {r.entity_id: round(r.confidence, 9) for r in made.collect()}
    assert got == {"a": round((0.9 * 1 + 0.5 * 2) / 3, 9), "b": 0.4}


def test_relations_of_few_entities_are_cut_below_their_grouping(spark, monkeypatch):
    e = spark.createDataFrame([(c, c, "", 0.5) for c in "abcd"], "entity_id string, name string, description string, confidence double")
    ends = [("a", "b"), ("a", "b"), ("b", "a"), ("a", "a"), ("c", "d"), ("d", "a"), (None, "a"), ("a", None), ("a", "x")]
    raw = spark.createDataFrame([(s, t, i / 10) for i, (s, t) in enumerate(ends)], "source_entity string, target_entity string, c double")
    r = raw.groupBy("source_entity", "target_entity").agg(F.max("c").alias("confidence")).select(
        "*", F.concat_ws("-", "source_entity", "target_entity").alias("relation_id"), F.lit("T").alias("relation_type")
    )
    of = e.filter("entity_id in ('a', 'd')").select("entity_id")

    def found():
        return gs.related_entities(r, e, of, 2)

    def rows():
        return sorted((x.entity_id, x.other_id, x.direction, x.strength, x.place) for x in found().collect())

    lines = found()._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = {i: len(line) - len(line.lstrip(" :+-")) for i, line in enumerate(lines)}
    grouped = [i for i, line in enumerate(lines) if "Aggregate [source_entity" in line]
    assert len(grouped) == 2 and all("Join LeftSemi" in lines[i + 1] and depth[i + 1] > depth[i] for i in grouped)
    few = rows()
    monkeypatch.setattr(gs, "FEW_ENTITIES", 0)
    assert few == rows() == [("a", "a", "out", 0.3, 2), ("a", "d", "in", 0.5, 1), ("d", "a", "out", 0.5, 1), ("d", "c", "in", 0.4, 2)]
