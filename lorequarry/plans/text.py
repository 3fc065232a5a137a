"""Queries on scalar text functions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from lorequarry.functions import text as tx
from lorequarry.sources.tables import table


def _chunk(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunk")


def normalize_text(spark, folder):
    return _chunk(spark, folder).select("row_id", tx.normalize_text(F.col("page_content")).alias("normalized"))


def content_hash(spark, folder):
    return _chunk(spark, folder).select("row_id", tx.content_hash(F.col("page_content")).alias("hash"))


def stable_chunk_id(spark, folder):
    rows = _chunk(spark, folder).where("page_content is not null").withColumn("section", F.coalesce("section_path", F.lit("")))
    seen = W.partitionBy("source", tx.content_hash(F.col("page_content"))).orderBy("chunk_index", "row_id")
    numbered = rows.withColumn("occurrence", F.row_number().over(seen) - 1)
    made = tx.stable_chunk_id(F.col("source"), F.col("section"), F.col("page_content"), F.col("occurrence"))
    return numbered.select("row_id", "occurrence", made.alias("stable_id"))


def derive_chunk_id(spark, folder):
    section = F.coalesce("section_path", F.lit(""))
    stored = F.when(F.col("start_index").isNotNull(), F.col("chunk_id"))
    made = tx.derive_chunk_id(stored, F.col("source"), section, F.coalesce("page_content", F.lit("")))
    return _chunk(spark, folder).select("row_id", made.alias("derived_id"))


def char_trigrams(spark, folder):
    grams = tx.char_trigrams(F.coalesce("page_content", F.lit("")))
    sets = _chunk(spark, folder).select("row_id", grams.alias("grams"))
    return sets.select("row_id", F.size("grams").alias("n_grams"), F.md5(F.array_join(F.array_sort("grams"), "|")).alias("digest"))


def tokenize(spark, folder):
    words = _chunk(spark, folder).select("row_id", tx.tokens(F.coalesce("page_content", F.lit(""))).alias("t"))
    return words.select(
        "row_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_terms"), F.md5(F.array_join("t", " ")).alias("digest")
    )


def slugify(spark, folder):
    title = F.element_at(F.split(F.coalesce("section_path", F.lit("")), " > "), -1)
    return _chunk(spark, folder).select(
        "row_id", tx.slug(title).alias("slug"), tx.slug(F.concat(F.lit("12. "), title), 40, drop_number=True).alias("numbered_slug")
    )


def normalize_bool(spark, folder):
    roles = table(spark, folder, "conversations").select(F.col("role").alias("raw"))
    runs = table(spark, folder, "e2e").select(F.col("abstained").cast("string").alias("raw"))
    return roles.unionByName(runs).groupBy("raw").agg(F.count(F.lit(1)).alias("n")).select("raw", "n", tx.normalize_bool(F.col("raw")).alias("flag"))


def principal_of(spark, folder):
    owners = table(spark, folder, "conversations").groupBy("owner").agg(F.count(F.lit(1)).alias("n"))
    return owners.select("owner", tx.principal(F.col("owner")).alias("principal"), "n")


def thread_key(spark, folder):
    threads = table(spark, folder, "conversations").groupBy("owner", "thread_id").agg(F.count(F.lit(1)).alias("n"))
    return threads.select(tx.thread_key(F.col("owner"), F.col("thread_id")).alias("thread_key"), "n")


def validate_thread(spark, folder):
    rows = table(spark, folder, "conversations").select("thread_id").distinct()
    long = rows.select(F.repeat("thread_id", F.lit(4)).alias("thread_id"))
    return rows.unionByName(long).select("thread_id", tx.valid_thread(F.col("thread_id")).alias("valid"))


def json_props(spark, folder):
    props = F.from_json("props", "k bigint")
    return table(spark, folder, "events").select("event_id", props["k"].alias("k"))


def json_unfence(spark, folder):
    rows = _chunk(spark, folder).where("page_content is not null")
    fenced = F.concat(F.lit("```json\n"), F.regexp_replace("page_content", "```", ""), F.lit("\n```"))
    return rows.select("row_id", tx.unfence(F.col("page_content")).alias("plain"), tx.unfence(fenced).alias("unfenced"))


def sse_parse(spark, folder):
    said = table(spark, folder, "conversations").where("content is not null")
    line = F.concat(F.lit("data: "), F.regexp_replace("content", "[\\r\\n]+", " "))
    stream = F.concat(F.lit(": ping\n"), line, F.lit("\n\ndata: end of turn\n\ndata: [DONE]\n\ndata: after\n"))
    return said.select("id", F.array_join(tx.sse_payload(stream), "").alias("text"))


def user_messages(spark, folder):
    runs = table(spark, folder, "e2e").select(F.coalesce("generation_error", "judge_error", F.lit("none")).alias("kind"))
    counted = runs.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("kind", "n", tx.user_message(F.col("kind"), F.lit(None).cast("int")).alias("message"))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_text, content_hash, stable_chunk_id, derive_chunk_id, char_trigrams, tokenize, slugify, normalize_bool,
        principal_of, thread_key, validate_thread, json_props, json_unfence, sse_parse, user_messages,
    )
}

#: Collapsed and trimmed text, as DuckDB writes it.
NORMAL = r"trim(regexp_replace({}, '[\s\x0b\x1c-\x1f\x85\p{{Z}}]+', ' ', 'g'))"
_NORMAL = NORMAL.format("page_content")
_SLUG = r"substr(regexp_replace(trim(regexp_replace({}, '[^\p{{L}}\p{{N}}_\s-]', '', 'g')), '\s+', '_', 'g'), 1, {})"
_TITLE = "split(coalesce(section_path, ''), ' > ')[-1]"
_TOKENS = r"regexp_extract_all(lower(coalesce(page_content, '')), '[\p{L}\p{N}_]+')"

ORACLE_SQL = {
    "normalize_text": f"SELECT row_id, {_NORMAL} AS normalized FROM chunk",
    "content_hash": f"SELECT row_id, sha1({_NORMAL}) AS hash FROM chunk",
    "stable_chunk_id": f"""
        WITH t AS (SELECT row_id, source, coalesce(section_path, '') AS section, {_NORMAL} AS body,
                          row_number() OVER (PARTITION BY source, sha1({_NORMAL}) ORDER BY chunk_index, row_id) - 1 AS occurrence
                   FROM chunk WHERE page_content IS NOT NULL)
        SELECT row_id, occurrence, substr(sha1(source || chr(0) || section || chr(0) || body || chr(0) || occurrence), 1, 16) AS stable_id FROM t""",
    "derive_chunk_id": f"""
        SELECT row_id, coalesce(CASE WHEN start_index IS NOT NULL THEN nullif(chunk_id, '') END,
               substr(sha1(source || chr(0) || coalesce(section_path, '') || chr(0) || coalesce({_NORMAL}, '') || chr(0) || '0'), 1, 16)) AS derived_id
        FROM chunk""",
    "char_trigrams": r"""
        WITH t AS (SELECT row_id, regexp_replace(coalesce(page_content, ''), '[\s\x0b\x1c-\x1f\x85\p{Z}]+', '', 'g') AS x FROM chunk),
        g AS (SELECT row_id, list_sort(list_distinct(list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3)))) AS grams FROM t)
        SELECT row_id, len(grams) AS n_grams, md5(array_to_string(grams, '|')) AS digest FROM g""",
    "tokenize": f"""
        SELECT row_id, len({_TOKENS}) AS n_tokens, len(list_distinct({_TOKENS})) AS n_terms,
               md5(array_to_string({_TOKENS}, ' ')) AS digest FROM chunk""",
    "slugify": f"""
        SELECT row_id, {_SLUG.format(_TITLE, 50)} AS slug,
               {_SLUG.format(f"regexp_replace('12. ' || {_TITLE}, '^[0-9]+[.][[:space:]]*', '')", 40)} AS numbered_slug FROM chunk""",
    "normalize_bool": """
        WITH r AS (SELECT role AS raw FROM conversations UNION ALL SELECT abstained::varchar FROM e2e),
        c AS (SELECT raw, count(*) AS n, lower(trim(raw)) AS p FROM r GROUP BY raw)
        SELECT raw, n, CASE WHEN p IN ('true', 'yes', '是') THEN true WHEN p IN ('false', 'no', '否') THEN false
                            WHEN try_cast(p AS double) IS NOT NULL THEN try_cast(p AS double) <> 0 END AS flag FROM c""",
    "principal_of": "SELECT owner, substr(sha256(owner), 1, 16) AS principal, count(*) AS n FROM conversations GROUP BY owner",
    "thread_key": """SELECT substr(sha256(owner), 1, 16) || ':' || thread_id AS thread_key, count(*) AS n
        FROM conversations GROUP BY owner, thread_id""",
    "validate_thread": """
        WITH t AS (SELECT DISTINCT thread_id FROM conversations), u AS (SELECT thread_id FROM t UNION ALL SELECT repeat(thread_id, 4) FROM t)
        SELECT thread_id, coalesce(length(thread_id) BETWEEN 1 AND 48, false) AS valid FROM u""",
    "json_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS bigint) AS k FROM events",
    "json_unfence": """
        SELECT row_id,
          CASE WHEN starts_with(trim(page_content, ' '), '```')
               THEN trim(regexp_replace(split(trim(page_content, ' '), '```')[2], '^json', ''), ' ') ELSE trim(page_content, ' ') END AS plain,
          trim(regexp_replace(chr(10) || replace(page_content, '```', '') || chr(10), '^json', ''), ' ') AS unfenced
        FROM chunk WHERE page_content IS NOT NULL""",
    "sse_parse": r"""SELECT id, regexp_replace(content, '[\r\n]+', ' ', 'g') || 'end of turn' AS text
        FROM conversations WHERE content IS NOT NULL""",
    "user_messages": """
        WITH k AS (SELECT coalesce(generation_error, judge_error, 'none') AS kind FROM e2e)
        SELECT kind, count(*) AS n,
          CASE kind WHEN 'timeout' THEN 'The service took too long, try again later.' WHEN 'connection' THEN 'The service cannot be reached.'
                    WHEN 'rate_limit' THEN 'Too many requests, try again later.' WHEN 'auth' THEN 'Access was denied.'
                    ELSE 'The request failed.' END AS message
        FROM k GROUP BY kind""",
}
