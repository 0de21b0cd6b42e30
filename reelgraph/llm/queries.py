"""The corpus operators over their whole tables, one query each, with the SQL that states the result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgraph.llm import (
    dialog_repair, hilbert, jaccard_join, language, mixing, packing, pii, spelling, substring_dedup, syncmers, token_counts, url_filter,
    vptree,
)

Run = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken")).drop("segment")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", language.held_out())
    model = language.train(docs.where("not held_out"))
    return language.identify(docs, model, "doc_id", "held_out")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL4 = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, p, list_slice(w, p, p + 49) AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM words WHERE len(w) >= 50)
), firsts AS (
    SELECT s, min(doc_id) AS first_id FROM windows GROUP BY s
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM windows JOIN firsts USING (s) WHERE doc_id > first_id
), positions AS (
    SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM words
), kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM positions ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


RULES = (  # host, path, action
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return url_filter.judge(_table(spark, sf_dir, "pages"), rules)


SQL5 = r"""
WITH rules(rh, rp, action) AS (
    VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'),
           ('com', '/de/', 'block')
), rest AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
    SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path
    FROM (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS h FROM rest)
), urls AS (
    SELECT DISTINCT host, path FROM parts
), best AS (
    SELECT host, path, max_by(rh || rp, length(rh || rp)) AS rule, max_by(action, length(rh || rp)) AS action
    FROM urls JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM parts LEFT JOIN best USING (host, path)
"""


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


SQL6 = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
    SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN list_slice(w, 1, len(w)) ELSE list_slice(w, p, p + 4) END AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM words WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)
), reach AS (
    SELECT doc_id AS node, doc_id AS root FROM documents
    UNION
    SELECT CASE WHEN links.a = reach.node THEN links.b ELSE links.a END, reach.root
    FROM reach JOIN links ON links.a = reach.node OR links.b = reach.node
)
SELECT documents.doc_id, coalesce(sizes.n, 0) AS n_shingles, r.component_id, coalesce(k.n_links, 0) AS n_links
FROM documents LEFT JOIN sizes USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n_links FROM (SELECT a AS doc_id FROM links UNION ALL SELECT b FROM links) GROUP BY doc_id) k USING (doc_id)
JOIN (SELECT node, min(root) AS component_id FROM reach GROUP BY node) r ON r.node = documents.doc_id
"""


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edit_report(_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert.shards(_table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_vantage_point_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vptree.nearest(rows, rows.where("id % 20 = 0"))


SQL9 = r"""
WITH v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
    SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e)
    WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL10 = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           list_value(5.0, 2.0, 1.0)[(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS weight
    FROM sized GROUP BY source
), steps AS (
    SELECT *, 3.0 * source_size / weight AS ratio,
           (sum(source_size) OVER () - coalesce(sum(3.0 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM sources
), goals AS (
    SELECT source, source_size, target, floor(rate) AS whole, (rate - floor(rate)) * source_size AS more
    FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM (
        SELECT source, source_size, least(3.0 * source_size, weight * (SELECT level FROM steps WHERE level <= ratio ORDER BY ratio, source LIMIT 1)) AS target FROM steps))
), placed AS (
    SELECT s.doc_id, s.size, g.*,
           sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size / 2.0 AS half
    FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN more > 0 AND half <= more THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialog_repair.repair_report(dialog_repair.damaged(_table(spark, sf_dir, "conversations")))


def _sql_crc32(codes: str) -> str:
    """crc32 of a list of byte values, bit by bit."""
    step = "lambda x, i: xor(x >> 1, 3988292384 * (x & 1))"
    bits = f"list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda z: z::BIGINT)), {step})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {bits}), 4294967295)"


def _sql_edit(way: str, cost: str, letter: str, line: str = "") -> str:
    """A way of the repair, k being its cost in nine digits and its letters, with one edit more and the lines that it writes."""
    text = f"CASE WHEN {way}.t IS NULL THEN {line} ELSE {way}.t || chr(10) || {line} END" if line else f"{way}.t"
    key = f"lpad(CAST(CAST(left({way}.k, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || substr({way}.k, 10) || '{letter}'"
    return f"CASE WHEN {way} IS NOT NULL THEN {{'k': {key}, 't': {text}}} END"


def _sql_least(*ways: str) -> str:
    return f"list_min(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))"


def _sql_repair() -> str:
    keep, rerole = "CASE WHEN cut THEN 1 ELSE 0 END", "CASE WHEN cut THEN 3 ELSE 2 END"
    own = "m.role || ':' || m.text"

    def stay(way: str, initial: str, role: str) -> list[str]:
        kept = _sql_edit(f"d.{way}", keep, "K", own)
        changed = [_sql_edit(f"d.{way}", rerole, "R", f"'{role}:' || m.text")] if role else []
        return [f"CASE WHEN NOT gone AND c = '{initial}' THEN {kept} END", *(f"CASE WHEN NOT gone THEN {x} END" for x in changed)]

    def dropped(way: str) -> str:
        return _sql_edit(f"d.{way}", "3", "D")

    user = _sql_least(dropped("s2"), *(x for w in ("s0", "s1", "s3") for x in stay(w, "u", "user")))
    helper = _sql_least(dropped("s3"), *stay("s2", "a", "assistant"))
    first = _sql_least(dropped("s1"), *stay("s0", "s", ""))
    to_user = _sql_least("p2", *(_sql_edit(w, "2", "I", "'user:'") for w in ("p0", "p1", "p3")))
    to_helper = _sql_least("p3", _sql_edit("s2", "2", "I", "'assistant:'"))
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    fate = _sql_crc32(f"list_transform(string_split({key}, ''), lambda ch: ord(ch)::BIGINT)")
    return rf"""
WITH RECURSIVE raw AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {fate} % 20 AS fate FROM conversations
), damaged AS (
    SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
           CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM raw WHERE fate <> 0
), ordered AS (
    SELECT *, row_number() OVER w AS i, left(role, 1) AS c, lag(left(role, 1)) OVER w AS before,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
           NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open
    FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), marked AS (
    SELECT *, blank OR seen AS gone, NOT blank AND NOT seen AND open AS cut FROM ordered
), ways AS (
    SELECT conv_id, 0::BIGINT AS i, {{'k': '000000000', 't': NULL::VARCHAR}} AS s0, NULL::STRUCT(k VARCHAR, t VARCHAR) AS s1,
           {{'k': '000000002I', 't': 'user:'}} AS s2, {{'k': '000000004II', 't': 'user:' || chr(10) || 'assistant:'}} AS s3
    FROM (SELECT DISTINCT conv_id FROM marked)
    UNION ALL
    SELECT conv_id, i, p0, p1, s2, {to_helper} FROM (SELECT *, {to_user} AS s2 FROM (
        SELECT m.conv_id, m.i, {dropped("s0")} AS p0, {first} AS p1, {user} AS p2, {helper} AS p3
        FROM ways d JOIN marked m ON m.conv_id IS NOT DISTINCT FROM d.conv_id AND m.i = d.i + 1))
), counts AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (blank) AS blank, count(*) FILTER (seen AND NOT blank) AS duplicate, count(*) FILTER (cut) AS truncated,
           count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal
    FROM marked GROUP BY conv_id
), ended AS (
    SELECT c.*, {_sql_least("w.s0", "w.s3")} AS way FROM counts c JOIN ways w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(left(way.k, 9) AS BIGINT), 0) AS cost,
       coalesce(substr(way.k, 10), '') AS audit, sha256(coalesce(way.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


SQL11 = _sql_repair()


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents").select("doc_id", "text"))


_BYTES = """flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r, ''), lambda ch:
    CASE WHEN ord(ch) < 128 THEN [ord(ch)::BIGINT] ELSE [(192 | (ord(ch) >> 6))::BIGINT, (128 | (ord(ch) & 63))::BIGINT] END))"""

SQL12 = rf"""
WITH RECURSIVE runs AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents
), hashed AS (
    SELECT r, n, length(r) AS size, {_sql_crc32(_BYTES)} AS h
    FROM (SELECT doc_id, r, count(*) AS n FROM runs WHERE length(r) >= 5 GROUP BY doc_id, r)
), words AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n
    FROM (SELECT CASE WHEN h % 97 = 0 THEN left(r, h % size) || substr(r, h % size + 2) ELSE r END AS word, n FROM hashed)
    WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cut AS (
    SELECT word, n, p, left(word, p - 1) || substr(word, p + 1) AS rest
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)
), near AS (
    SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
    UNION
    SELECT cut.word, words.word, words.n FROM cut JOIN words ON cut.rest = words.word
    UNION
    SELECT words.word, cut.word, cut.n FROM cut JOIN words ON cut.rest = words.word
), best AS (
    SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word
), forms AS (
    SELECT words.word, CASE WHEN m >= 2 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN m END AS form_n
    FROM words LEFT JOIN best USING (word)
), walk AS (
    SELECT word, word AS root FROM forms
    UNION ALL
    SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.root AND forms.form IS NOT NULL
), last AS (
    SELECT walk.word, root FROM walk JOIN forms ON forms.word = walk.root AND forms.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN last USING (word)
"""


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"), pii.fit(pii.labelled_table(spark)))


QUERIES: dict[str, tuple[Run, str | None]] = {
    "op1_packing": (op1_packing, None),
    "op2_language_id": (op2_language_id, None),
    "op3_token_counts": (op3_token_counts, None),
    "op4_substring_dedup": (op4_substring_dedup, SQL4),
    "op5_url_filters": (op5_url_filters, SQL5),
    "op6_ngram_jaccard_join": (op6_ngram_jaccard_join, SQL6),
    "op7_document_fingerprints": (op7_document_fingerprints, None),
    "op8_sharding": (op8_sharding, None),
    "op9_vantage_point_trees": (op9_vantage_point_trees, SQL9),
    "op10_mixing": (op10_mixing, SQL10),
    "op11_conversation_repair": (op11_conversation_repair, SQL11),
    "op12_spelling_variants": (op12_spelling_variants, SQL12),
    "op13_pii": (op13_pii, None),
}
