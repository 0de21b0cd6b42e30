"""Allow and block rules on URLs: a blocked Bloom filter of the listed canonical URLs, then an exact hash join.

A rule lists a host and the start of a path; it fits its host and all subdomains.  A page's URL is canonical as (host in lower case,
path).  The keys under which a rule for it could stand are its host and each parent domain, with the start of its path of each
length that occurs in the rules.

1. The rules' keys set bits in a blocked Bloom filter: one hash picks a 64-bit block, the others set ``HASHES`` bits in that block, so a
   test is one look-up.  The filter is an aggregate of the rules, (block, bits).
2. The pages' distinct (host, path) are probed: joined on the block, by a broadcast only when the filter is below ``BROADCAST_BLOCKS``
   blocks.  Keys whose bits are not all set can't be listed.
3. What passes goes to an exact hash join with the rules, which removes false positives.  The longest rule wins, of equally long ones
   the one with the longer host, then a blocking one.
Pages that no rule fits get the verdict for unlisted pages, ``allow``.

Nulls and edges: a null URL, or one without ``://``, has an empty host and path and fits no rule.  Rules with a null host, path or action
are ignored; of rules for the same host and path a blocking one wins.  Repeated rows each come back; columns other than page_id and url
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = 6
BITS_PER_KEY = 16
BROADCAST_BLOCKS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(url: Column) -> tuple[Column, Column]:
    """Host and path.  Query and fragment don't count."""
    mark = F.instr(url, "://")
    rest = F.when(mark > 0, F.substring(url, mark + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _block_and_bits(host: str, path: str, blocks: int) -> tuple[Column, Column]:
    key = F.concat_ws("\x00", host, path)
    first, second = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    bits = F.lit(0).cast("long")
    for i in range(HASHES):
        place = F.shiftright(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return F.pmod(first, F.lit(blocks)), bits


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, bits) of the listed (host, path)."""
    block, bits = _block_and_bits("host", "path", blocks)
    return listed.select(block.alias("block"), bits.alias("bits")).groupBy("block").agg(F.bit_or("bits").alias("bits"))


def judge(pages: DataFrame, rules: DataFrame, unlisted: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; ``rules`` has host, path and action (allow or block)."""
    host, path = canonical(F.col("url").cast("string"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    listed = (
        rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "action").where("host is not null and path is not null and action is not null")
        .groupBy("host", "path").agg(F.max("action").alias("action"))  # 'block' sorts after 'allow'
    )
    n_rules = listed.count()
    blocks = max(1, -(-n_rules * BITS_PER_KEY // 64))
    # as many numbers as the rules' paths have lengths
    lengths = F.array(*[F.lit(r["n"]) for r in listed.select(F.length("path").alias("n")).distinct().sort("n").collect()] or [F.lit(0)])
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = (
        seen.select("host", "path").where("host <> ''").distinct()
        .withColumn("domain", F.explode(domains))
        .withColumn("n", F.explode(F.filter(lengths, lambda n: n <= F.length("path"))))
        .select("host", "path", "domain", F.expr("substring(path, 1, n)").alias("start"))
    )
    block, bits = _block_and_bits("domain", "start", blocks)
    bloom = bloom_blocks(listed, blocks)
    if blocks <= BROADCAST_BLOCKS:
        bloom = F.broadcast(bloom)
    possible = (
        keys.withColumns({"block": block, "wanted": bits}).join(bloom, "block")
        .where(F.col("bits").bitwiseAND(F.col("wanted")) == F.col("wanted")).select("host", "path", "domain", "start")
    )
    exact = listed.select(F.col("host").alias("domain"), F.col("path").alias("start"), "action").hint("shuffle_hash" if n_rules > BROADCAST_BLOCKS else "broadcast")
    length = F.length("domain") + F.length("start")
    best = (
        possible.join(exact, ["domain", "start"]).groupBy("host", "path")
        .agg(F.max(F.struct(length.alias("n"), F.length("domain").alias("d"), "action", "domain", "start")).alias("r"))
        .select("host", "path", F.concat("r.domain", "r.start").alias("rule"), "r.action")
    )
    return seen.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("action", F.lit(unlisted)).alias("verdict")
    )
