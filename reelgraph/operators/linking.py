"""Cross-video entity linking: similar pairs, a greedy merge order, and its effect on the graph.

Similarity is 0.4 * name + 0.2 * best alias pair + 0.4 * description.  Input entities have distinct
names within a type (``merge_mentions`` sees to that), so a pair without aliases on both sides cannot
reach a threshold of 0.8 or more.  Above 0.6 every linkable pair shares at least (threshold - 0.6) / 0.4 of
its description tokens, for names and aliases give 0.6 at most.  That makes the search an exact set-similarity join instead of all pairs of a type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from reelgraph.functions import text
from reelgraph.session import cut_lineage

BLOCK = 1024


def _signatures(entities: DataFrame) -> DataFrame:
    tokens = text.token_set(F.col("description"))
    return entities.withColumn("tokens", tokens).filter(F.size("tokens") > 0).withColumn(
        "sig", F.md5(F.concat_ws(" ", "entity_type", F.array_join("tokens", " ")))
    )


def description_pairs(entities: DataFrame, at_least: float) -> DataFrame:
    """Pairs of distinct description token sets of one type with Jaccard ``at_least`` or more.

    Prefix filtering: tokens are ordered rarest first, and two sets that similar must share a token in
    the prefix of the larger and the shorter indexing prefix of the smaller.  Common tokens fall outside
    the prefixes, so they are never joined on; equal descriptions are one set here.
    """
    sets = _signatures(entities).select("entity_type", "sig", "tokens").dropDuplicates(["sig"])
    flat = sets.select("entity_type", "sig", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    counts = flat.groupBy("entity_type", "token").agg(F.count("*").alias("df"))
    ranked = flat.join(counts, ["entity_type", "token"]).withColumn(
        "place", F.row_number().over(Window.partitionBy("sig").orderBy("df", "token"))
    )
    n, place = F.col("n"), F.col("place")
    probe = ranked.filter(place <= n - F.ceil(n * at_least - 1e-9) + 1).select(
        "entity_type", "token", F.col("sig").alias("big"), n.alias("n_big")
    )
    share = 2 * at_least / (1 + at_least)
    index = ranked.filter(place <= n - F.ceil(n * share - 1e-9) + 1).select(
        "entity_type", "token", F.col("sig").alias("small"), n.alias("n_small")
    )
    found = probe.join(index, ["entity_type", "token"]).filter(
        ((F.col("n_small") < F.col("n_big")) | ((F.col("n_small") == F.col("n_big")) & (F.col("small") < F.col("big"))))
        & (F.col("n_small") >= F.col("n_big") * at_least - 1e-9)
    ).select("entity_type", "small", "big").distinct()
    a = sets.select(F.col("sig").alias("small"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("sig").alias("big"), F.col("tokens").alias("tb"))
    scored = found.join(a, "small").join(b, "big").withColumn("description_similarity", text.jaccard(F.col("ta"), F.col("tb")))
    return scored.filter(F.col("description_similarity") >= at_least - 1e-9).select(
        "entity_type", F.col("small").alias("sig_a"), F.col("big").alias("sig_b"), "description_similarity"
    )


def _video_print(entity_videos: DataFrame) -> DataFrame:
    """A fixed-size fingerprint of each entity's set of videos."""
    return entity_videos.select("entity_id", "video_id").distinct().groupBy("entity_id").agg(
        F.concat_ws(
            ":", F.count("*"), F.bit_xor(F.xxhash64("video_id")), F.bit_xor(F.xxhash64(F.concat(F.lit("#"), "video_id")))
        ).alias("videos")
    )


def link_candidates(entities: DataFrame, aliases: DataFrame, entity_videos: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs of one type, from different sets of videos, with similarity ``threshold`` or more.

    ``primary`` is the smaller id.  Entities that share a description are cut into blocks and met block
    by block in cells, so one very common description is spread over many tasks, and a pair leaves its
    cell only if its names are close enough for the pair to count.
    """
    if not threshold > 0.6:
        raise ValueError("the candidate search is exact for thresholds above 0.6")
    known = aliases.select("entity_id", F.lower("alias").alias("alias")).distinct()
    described = _signatures(entities)
    if threshold >= 0.8:  # below it, entities without aliases can link as well
        described = described.join(known.select("entity_id").distinct(), "entity_id", "left_semi")
    members = (
        described.join(_video_print(entity_videos), "entity_id", "left").fillna("", ["videos"])
        .select("entity_id", "entity_type", F.lower("name").alias("name"), "sig", "videos")
    )
    at_least = (threshold - 0.6) / 0.4
    blocks = members.groupBy("entity_type", "sig").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = members.join(blocks, ["entity_type", "sig"]).withColumn(
        "block", F.pmod(F.xxhash64("entity_id"), F.col("blocks"))
    )
    same = blocks.filter("blocks > 0").select(
        "entity_type", F.col("sig").alias("sig_a"), F.col("sig").alias("sig_b"), F.lit(1.0).alias("description_similarity")
    )
    pairs = same.unionByName(description_pairs(entities, at_least))
    na = blocks.select(F.col("sig").alias("sig_a"), F.col("blocks").alias("na"))
    nb = blocks.select(F.col("sig").alias("sig_b"), F.col("blocks").alias("nb"))
    cells = (
        pairs.join(na, "sig_a").join(nb, "sig_b")
        .withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("na") - 1)))
        .withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
        .filter((F.col("sig_a") != F.col("sig_b")) | (F.col("i") <= F.col("j")))
        .select("sig_a", "sig_b", "i", "j", "description_similarity")
    )

    def side(sig: str, block: str, tag: str) -> DataFrame:
        rows = placed.select(
            F.col("sig").alias(sig), F.col("block").alias(block), F.col("entity_id").alias(f"id_{tag}"),
            F.col("name").alias(f"name_{tag}"), F.col("videos").alias(f"videos_{tag}"),
        )
        return cells.join(rows, [sig, block])

    left = side("sig_a", "i", "a")
    right = side("sig_b", "j", "b").drop("description_similarity")
    name_sim = text.string_similarity(F.col("name_a"), F.col("name_b"))
    met = left.join(right, ["sig_a", "sig_b", "i", "j"]).filter(
        (F.col("id_a") != F.col("id_b")) & (F.col("videos_a") != F.col("videos_b"))
        & ((F.col("sig_a") != F.col("sig_b")) | (F.col("i") != F.col("j")) | (F.col("id_a") < F.col("id_b")))
        & (name_sim * 0.4 + 0.2 + F.col("description_similarity") * 0.4 >= threshold - 1e-12)
    ).select(
        F.least("id_a", "id_b").alias("primary"), F.greatest("id_a", "id_b").alias("secondary"),
        name_sim.alias("name_similarity"), "description_similarity",
    )
    pa = known.select(F.col("entity_id").alias("primary"), F.col("alias").alias("alias_a"))
    sa = known.select(F.col("entity_id").alias("secondary"), F.col("alias").alias("alias_b"))
    alias_sim = F.max(text.string_similarity(F.col("alias_a"), F.col("alias_b")))
    best = met.join(pa, "primary", "left").join(sa, "secondary", "left").groupBy(*met.columns).agg(
        F.coalesce(alias_sim, F.lit(0.0)).alias("alias_similarity")
    )
    total = F.col("name_similarity") * 0.4 + F.col("alias_similarity") * 0.2 + F.col("description_similarity") * 0.4
    return best.withColumn("similarity", total).filter(F.col("similarity") >= threshold - 1e-12)


def _follow(links: DataFrame, rounds: int) -> tuple[DataFrame, int]:
    """Double (turn, to, odd) links until each points at a pair that waits for no single other; also the rounds left."""
    while rounds > 0:
        on = links.select(F.col("turn").alias("to"), F.col("to").alias("further"), F.col("odd").alias("more"))
        hopped = cut_lineage(
            links.join(on, "to", "left").select(
                "turn", F.coalesce("further", "to").alias("to"), (F.col("odd") != F.coalesce("more", F.lit(False))).alias("odd"),
                F.col("further").isNotNull().alias("moved"),
            )
        )
        links, rounds = hopped.select("turn", "to", "odd"), rounds - 1
        if hopped.filter("moved").isEmpty():
            return links, rounds
    raise RuntimeError("greedy merge not settled after the rounds allowed")


def greedy_merges(candidates: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """The pairs a greedy pass merges: best similarity first, then by ids, skipping dead entities.

    A pair kills its secondary; a threat to an entity is a pair that would kill it.  Only the first open threat to a secondary
    can be decided, and it is by the threats to its primary that come before it: none, and the pair merges; exactly one, and it
    merges if that one does not; more, and it waits.  Pairs with one such threat form chains, whose ends are found by doubling
    links that carry the parity of their length, so a chain of n pairs takes log2(n) rounds and not n.  Every round then drops
    the decided pairs and those that touch a dead entity after its death.  The result equals the one-by-one pass.  The rounds
    counted by ``max_rounds`` include those of the doubling.

    Pairs with a null id or similarity take no part.  Of equal rows one counts.
    """
    order = F.struct((-F.col("similarity")).alias("s"), F.col("primary").alias("p"), F.col("secondary").alias("q"))
    known = candidates.select("primary", "secondary", "similarity").dropna().distinct()
    open_pairs = cut_lineage(known.withColumn("turn", order))
    done = open_pairs.filter(F.lit(False))
    rounds, turns = max_rounds, 0
    by_turn = Window.partitionBy("secondary").orderBy("turn")
    while not open_pairs.isEmpty():
        if rounds <= 0:
            raise RuntimeError("greedy merge not settled after the rounds allowed")
        rounds, turns = rounds - 1, turns + 1
        if turns % 16 == 0:
            done = cut_lineage(done)
        two = open_pairs.select("secondary", "turn").withColumn("place", F.row_number().over(by_turn)).filter("place <= 2")
        threats = two.groupBy("secondary").agg(
            F.min(F.when(F.col("place") == 1, F.col("turn"))).alias("first"), F.min(F.when(F.col("place") == 2, F.col("turn"))).alias("second")
        )
        heads = open_pairs.join(threats.select("secondary", F.col("first").alias("turn")), ["secondary", "turn"])
        boss = threats.select(F.col("secondary").alias("primary"), "first", "second")
        before = lambda c: F.coalesce(F.col(c) < F.col("turn"), F.lit(False))
        heads = cut_lineage(heads.join(boss, "primary", "left").select(
            "primary", "secondary", "similarity", "turn", before("first").alias("one"), before("second").alias("two"), "first"
        ))
        free = heads.filter("not one")
        settled, decided = free.select(*done.columns), free.select("turn", "secondary")
        single = heads.filter("one and not two").select("turn", F.col("first").alias("to"), F.lit(True).alias("odd"))
        at_once, linked = heads.agg(F.count_if(~F.col("one")), F.count_if(F.col("one") & ~F.col("two"))).first()
        if linked > 4 * at_once:  # else the free pairs alone settle a fifth of what can be settled
            links, rounds = _follow(single, rounds)
            known_ends = free.select(F.col("turn").alias("to"))
            ended = heads.join(links.join(known_ends, "to", "left_semi").select("turn", "odd"), "turn")
            settled = cut_lineage(settled.unionByName(ended.filter("not odd").select(*done.columns)))
            decided = decided.unionByName(ended.select("turn", "secondary"))
        done = done.unionByName(settled)
        deaths = settled.select("secondary", F.col("turn").alias("death"))
        as_primary = settled.select(F.col("secondary").alias("primary"), F.col("turn").alias("boss_death"))
        open_pairs = cut_lineage(
            open_pairs.join(decided, ["secondary", "turn"], "left_anti").join(deaths, "secondary", "left_anti")
            .join(as_primary, "primary", "left")
            .filter(F.col("boss_death").isNull() | (F.col("turn") < F.col("boss_death"))).drop("boss_death")
        )
    return done


def final_targets(merges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Where every merged entity ends up after all merges: its last primary."""
    links = cut_lineage(merges.select(F.col("secondary").alias("entity_id"), F.col("primary").alias("target")))
    for _ in range(max_rounds):
        up = links.select(F.col("entity_id").alias("target"), F.col("target").alias("further"))
        hopped = cut_lineage(links.join(up, "target", "left").select("entity_id", F.coalesce("further", "target").alias("target"), F.col("further").isNotNull().alias("moved")))
        links = hopped.select("entity_id", "target")
        if hopped.filter("moved").isEmpty():
            return links
    raise RuntimeError(f"merge chains longer than 2^{max_rounds}")


def redirect(rows: DataFrame, targets: DataFrame, column: str = "entity_id") -> DataFrame:
    """Replace merged ids by their targets."""
    to = targets.select(F.col("entity_id").alias(column), "target")
    return rows.join(to, column, "left").withColumn(column, F.coalesce("target", column)).drop("target")


def redirect_relations(relations: DataFrame, targets: DataFrame, compat: bool = False) -> DataFrame:
    """Move relation ends to the merged entities; relation ids stay.

    With ``compat`` a self-loop of a merged entity moves its source end only.
    """
    s = targets.select(F.col("entity_id").alias("source_entity"), F.col("target").alias("_s"))
    t = targets.select(F.col("entity_id").alias("target_entity"), F.col("target").alias("_t"))
    rows = relations.join(s, "source_entity", "left").join(t, "target_entity", "left")
    loop = F.lit(compat) & (F.col("source_entity") == F.col("target_entity"))
    return rows.withColumn("_new", F.when(loop, F.col("target_entity")).otherwise(F.coalesce("_t", "target_entity"))).withColumn(
        "source_entity", F.coalesce("_s", "source_entity")
    ).withColumn("target_entity", F.col("_new")).drop("_s", "_t", "_new")


def merged_confidence(entities: DataFrame, chunks: DataFrame, merges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Confidence of the surviving entities, each merge weighing sources as in ``fold_confidence``.

    A primary is folded once all its secondaries are final; rounds follow the depth of merge chains.
    """
    from reelgraph.operators.resolution import fold_confidence

    current = entities.select("entity_id", "confidence")
    sources = chunks.select("entity_id", "chunk_id").distinct()
    left = cut_lineage(merges.select("primary", "secondary", "turn"))
    for _ in range(max_rounds):
        if left.isEmpty():
            return current
        waiting = left.select(F.col("primary").alias("secondary")).distinct()
        blocked = left.join(waiting, "secondary", "left_semi").select("primary").distinct()
        ready = cut_lineage(left.join(blocked, "primary", "left_anti"))
        # The survivor is version 0, its secondaries follow in merge order.
        later = ready.select(
            F.col("primary").alias("entity_id"), F.col("secondary").alias("from_id"),
            F.row_number().over(Window.partitionBy("primary").orderBy("turn")).alias("seq"),
        )
        heads = ready.select(F.col("primary").alias("entity_id")).distinct().select(
            "entity_id", F.col("entity_id").alias("from_id"), F.lit(0).alias("seq")
        )
        plan = heads.unionByName(later)
        conf = current.select(F.col("entity_id").alias("from_id"), "confidence")
        src = sources.select(F.col("entity_id").alias("from_id"), "chunk_id")
        folded = fold_confidence(plan.join(conf, "from_id").drop("from_id"), plan.join(src, "from_id").drop("from_id"))
        gone = ready.select(F.col("secondary").alias("entity_id"))
        current = cut_lineage(
            current.join(gone, "entity_id", "left_anti")
            .join(folded.withColumnRenamed("confidence", "_c"), "entity_id", "left")
            .select("entity_id", F.coalesce("_c", "confidence").alias("confidence"))
        )
        moved = ready.select(F.col("secondary").alias("entity_id"), F.col("primary").alias("target"))
        sources = cut_lineage(redirect(sources, moved).distinct())
        left = cut_lineage(left.join(ready.select("secondary"), "secondary", "left_anti"))
    raise RuntimeError(f"merge chains deeper than {max_rounds}")
