"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgraph.functions import clock, ids, text
from reelgraph.sources import driver_tables as dt
from reelgraph.workload.registry import query

STOP_SQL = ", ".join(f"'{w}'" for w in text.STOPWORDS)
RUNS_SQL = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
KEYWORDS_SQL = (
    "list_filter(" + RUNS_SQL + ", lambda w: regexp_full_match(w, '[a-z]{{3,}}') AND w NOT IN (" + STOP_SQL + "))"
)
SQUEEZE_SQL = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
NORMAL_SQL = r"regexp_replace(" + SQUEEZE_SQL + r", '[^\p{{L}}\p{{N}}_\s.,!?\-]', '', 'g')"
WORDS_SQL = r"list_filter(string_split(" + SQUEEZE_SQL + r", ' '), lambda w: w <> '')"
TOKENS_SQL = "list_distinct(list_filter(string_split(" + NORMAL_SQL.replace("{0}", "lower({0})") + ", ' '), lambda w: w <> ''))"


def relevance_sql(query_text: str, column: str, keywords: list[str]) -> str:
    """Text relevance written out in SQL for one constant query."""
    low = f"lower({column})"
    q = query_text.lower()
    hits = " + ".join(f"contains({low}, '{k}')::INT" for k in keywords) or "0"
    share = f"(({hits}) / {len(keywords)}::DOUBLE * 0.6)" if keywords else "0.0"
    const = "[" + ", ".join(f"'{w}'" for w in sorted(set(q.split()))) + "]"
    words = f"list_distinct({WORDS_SQL.format(low)})"
    inter = f"len(list_intersect({const}, {words}))"
    union = f"(len({const}) + len({words}) - {inter})"
    return (
        f"CASE WHEN coalesce(length({column}), 0) = 0 THEN 0.0 ELSE least(1.0, greatest("
        f"CASE WHEN contains({low}, '{q}') THEN 0.8 ELSE 0.0 END, {share} + {inter} / {union}::DOUBLE * 0.4)) END::DOUBLE"
    )


@query("normalize_text", "SCA1", sql=f"SELECT doc_id, {NORMAL_SQL.format('text')} AS normalized FROM documents")
def normalize_text(spark, sf_dir):
    return dt.table(spark, sf_dir, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("normalized"))


@query(
    "extract_keywords", "SCA2",
    sql=f"""
    WITH tok AS (SELECT doc_id, unnest({KEYWORDS_SQL.format('text')}) AS word,
                        generate_subscripts({KEYWORDS_SQL.format('text')}, 1) AS pos FROM documents),
         cnt AS (SELECT doc_id, word, count(*) AS n, min(pos) AS pos FROM tok GROUP BY ALL),
         top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS r FROM cnt)
    SELECT d.doc_id, coalesce(string_agg(word, ',' ORDER BY r), '') AS keywords
    FROM documents d LEFT JOIN top t ON d.doc_id = t.doc_id AND r <= 10 GROUP BY d.doc_id""",
)
def extract_keywords(spark, sf_dir):
    return dt.table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(text.extract_keywords(F.col("text"), 10), ",").alias("keywords")
    )


@query(
    "text_relevance", "SCA10",
    sql=f"""SELECT doc_id, round({relevance_sql('with the nd', 'text', ['with', 'tion'])}, 6) AS relevance
            FROM documents""",
)
def text_relevance(spark, sf_dir):
    return dt.table(spark, sf_dir, "documents").select(
        "doc_id", F.round(text.text_relevance("with the nd", F.col("text"), ["with", "tion"]), 6).alias("relevance")
    )


def _any(words, low="lower(text)"):
    return "(" + " OR ".join(f"contains({low}, '{w}')" for w in words) + ")"


@query(
    "query_type", "SCA12",
    sql=f"""SELECT conv_id, turn,
              CASE WHEN {_any(text.VISUAL_WORDS)} THEN 'visual' WHEN {_any(text.ENTITY_WORDS)} THEN 'entity'
                   WHEN {_any(text.TEMPORAL_WORDS)} THEN 'temporal'
                   WHEN least(len(list_distinct({KEYWORDS_SQL.format('text')})), 10) > 3 THEN 'hybrid'
                   ELSE 'text' END AS query_type
            FROM conversations""",
)
def query_type(spark, sf_dir):
    t = F.col("text")
    return dt.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.query_type(t, text.keyword_count(t, 10)).alias("query_type")
    )


@query(
    "temporal_constraints", "SCA13",
    sql="""SELECT conv_id, turn,
             CASE WHEN contains(lower(text), 'beginning') OR contains(lower(text), 'start') THEN 'early'
                  WHEN contains(lower(text), 'end') OR contains(lower(text), 'ending') THEN 'late'
                  WHEN contains(lower(text), 'middle') THEN 'middle' END AS time_preference,
             CASE WHEN contains(lower(text), 'long') THEN 'long'
                  WHEN contains(lower(text), 'short') OR contains(lower(text), 'brief') THEN 'short' END
               AS duration_preference
           FROM conversations""",
)
def temporal_constraints(spark, sf_dir):
    t = F.col("text")
    return dt.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn",
        text.time_preference(t).alias("time_preference"), text.duration_preference(t).alias("duration_preference"),
    )


@query(
    "seconds_to_timestamp", "SCA4",
    sql="""WITH t AS (SELECT o_orderkey, o_totalprice AS s, floor(o_totalprice / 3600)::BIGINT AS h,
                             floor((o_totalprice % 3600) / 60)::BIGINT AS m, o_totalprice % 60 AS r FROM orders)
           SELECT o_orderkey,
                  CASE WHEN h > 0 THEN printf('%02d:%02d:%06.3f', h, m, r) ELSE printf('%02d:%06.3f', m, r) END AS stamp,
                  printf('%02d:%02d:%06.3f', h, m, r) AS long_stamp
           FROM t""",
)
def seconds_to_timestamp(spark, sf_dir):
    s = F.col("o_totalprice")
    return dt.table(spark, sf_dir, "orders").select(
        "o_orderkey", clock.seconds_to_timestamp(s).alias("stamp"),
        clock.seconds_to_timestamp(s, always_hours=True).alias("long_stamp"),
    )


@query(
    "timestamp_to_seconds", "SCA3",
    sql="""SELECT o_orderkey, round(CASE o_orderkey % 5
               WHEN 0 THEN (o_custkey % 24) * 3600.0 + (o_orderkey % 60) * 60.0 + (o_custkey % 60)
               WHEN 1 THEN (o_custkey % 60) * 60.0 + (o_orderkey % 60) + 0.25
               WHEN 2 THEN o_totalprice ELSE 0.0 END::DOUBLE, 6) AS seconds
           FROM orders""",
)
def timestamp_to_seconds(spark, sf_dir):
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    kind = o % 5
    stamp = (
        F.when(kind == 0, F.format_string("%02d:%02d:%02d", c % 24, o % 60, c % 60))
        .when(kind == 1, F.format_string("%d:%05.2f", c % 60, (o % 60) + F.lit(0.25)))
        .when(kind == 2, F.col("o_totalprice").cast("string"))
        .when(kind == 3, F.format_string("%d:1:2:3", c))
        .otherwise(F.concat(F.lit("at "), c.cast("string")))
    )
    return dt.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.round(clock.timestamp_to_seconds(stamp), 6).alias("seconds")
    )


@query(
    "entity_ids", "SCA14",
    sql=f"""SELECT entity_id AS key, substr(md5(entity_type || '_' || {NORMAL_SQL.format('lower(name)')}), 1, 16) AS entity_id
            FROM entities""",
    views="entities",
)
def entity_ids(spark, sf_dir):
    return dt.entities(spark, sf_dir).select(
        F.col("entity_id").alias("key"), ids.entity_id(F.col("name"), F.col("entity_type")).alias("entity_id")
    )


@query(
    "string_similarity", "SCA7",
    sql="""SELECT p_partkey, round(CASE WHEN p_name = lower(p_type) THEN 1.0
              ELSE 1.0 - levenshtein(p_name, lower(p_type))::DOUBLE / greatest(length(p_name), length(p_type)) END, 6)
              AS similarity
           FROM part""",
)
def string_similarity(spark, sf_dir):
    return dt.table(spark, sf_dir, "part").select(
        "p_partkey", F.round(text.string_similarity(F.col("p_name"), F.lower("p_type")), 6).alias("similarity")
    )


@query(
    "jaccard_text", "SCA8",
    sql=f"""WITH t AS (SELECT conv_id, turn, {TOKENS_SQL.format('text')} AS w FROM conversations)
            SELECT a.conv_id, a.turn,
                   round(CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0 ELSE
                     len(list_intersect(a.w, b.w))
                       / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::DOUBLE END, 6) AS similarity
            FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1""",
)
def jaccard_text(spark, sf_dir):
    """Similarity of each conversation turn to the turn before it."""
    t = dt.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.token_set(F.col("text")).alias("w"))
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("w").alias("prev"))
    return t.join(before, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(text.jaccard(F.col("w"), F.col("prev")), 6).alias("similarity")
    )


@query(
    "json_fields", "SCA15",
    sql="""SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k,
                  '{"type":"' || event_type || '","k":' || coalesce(json_extract_string(props, '$.k'), '-1') || '}' AS dumped
           FROM events""",
)
def json_fields(spark, sf_dir):
    """Parse a JSON column, with a default where it is absent or broken, and write JSON back."""
    k = F.coalesce(F.from_json("props", "k bigint")["k"], F.lit(-1))
    return dt.table(spark, sf_dir, "events").select(
        "event_id", k.alias("k"), F.to_json(F.struct(F.col("event_type").alias("type"), k.alias("k"))).alias("dumped")
    )


@query(
    "cache_keys", "SCA21",
    sql="""SELECT conv_id, turn,
             substr(md5(role || '|' || text || '|' || turn), 1, 16) AS short_key,
             substr(sha256(role || '|' || text), 1, 16) AS content_key
           FROM conversations""",
)
def cache_keys(spark, sf_dir):
    return dt.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn",
        ids.cache_key(F.col("role"), F.col("text"), F.col("turn").cast("string")).alias("short_key"),
        ids.content_key(F.col("role"), F.col("text")).alias("content_key"),
    )


@query(
    "frame_descriptions", "SCA19",
    sql="""SELECT frame_id, 'Frame ID: ' || frame_id || chr(10) || 'Video: ' || video_id || chr(10)
             || printf('Timestamp: %.2fs', timestamp) || chr(10) || 'Visual Content: ' || caption
             || CASE WHEN confidence <> 0 THEN chr(10) || printf('Analysis Confidence: %.2f', confidence) ELSE '' END
               AS description
           FROM frames""",
    views="frames",
)
def frame_descriptions(spark, sf_dir):
    f = dt.frames(spark, sf_dir)
    return f.select(
        "frame_id", text.frame_description(*[F.col(c) for c in ("frame_id", "video_id", "timestamp", "caption", "confidence")])
        .alias("description"),
    )


@query(
    "numbered_descriptions", "CH5",
    sql=r"""
    WITH src AS (SELECT doc_id, '1. ' || replace(text, chr(10), chr(10) || chr(10) || '2: ') || chr(10) || 'more' AS r FROM documents),
         ln AS (SELECT doc_id, trim(unnest(string_split(r, chr(10)))) AS line,
                       generate_subscripts(string_split(r, chr(10)), 1) AS pos FROM src),
         fl AS (SELECT *, (line[1] BETWEEN '0' AND '9' AND (contains(line, ': ') OR contains(line, '. '))) AS opens
                FROM ln WHERE line <> ''),
         gr AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS item FROM fl)
    SELECT doc_id, item::BIGINT - 1 AS item,
           string_agg(CASE WHEN NOT opens THEN line
                           WHEN contains(line, ': ') THEN substr(line, strpos(line, ': ') + 2)
                           ELSE substr(line, strpos(line, '. ') + 2) END, ' ' ORDER BY pos) AS description
    FROM gr GROUP BY doc_id, item""",
)
def numbered_descriptions(spark, sf_dir):
    """Number every line of a document, then read the numbered listing back into its items."""
    listing = F.concat(F.lit("1. "), F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n2: ")), F.lit("\nmore"))
    return dt.table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(text.numbered_descriptions(listing)).alias("item", "description")
    ).withColumn("item", F.col("item").cast("bigint"))
