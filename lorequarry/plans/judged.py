"""Queries on judged runs and serving, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lorequarry.operators import judged as jd, labels as lb, models as md, serving as sv
from lorequarry.sources.tables import table


def _runs(spark, folder) -> DataFrame:
    return table(spark, folder, "e2e")


def effective_refusal(spark, folder):
    flag = jd.effective_refusal(F.col("generation_error"), F.col("answer"), F.col("judge"))
    return _runs(spark, folder).select("row_id", flag.alias("refusal"))


def e2e_summary(spark, folder):
    return jd.rates(jd.run_flags(_runs(spark, folder)))


def hit_faithful_matrix(spark, folder):
    return jd.hit_faithful(_runs(spark, folder))


def latency_quantiles(spark, folder):
    long = _runs(spark, folder).select("retrieval_ms", "generation_ms", "judge_ms").unpivot([], ["retrieval_ms", "generation_ms", "judge_ms"], "measure", "ms")
    return jd.latencies(long)


def token_usage(spark, folder):
    return _runs(spark, folder).groupBy("kind").agg(
        F.sum("usage.answer.prompt_tokens").alias("answer_prompt"), F.sum("usage.answer.completion_tokens").alias("answer_completion"),
        F.sum("usage.judge.prompt_tokens").alias("judge_prompt"), F.sum("usage.judge.completion_tokens").alias("judge_completion"),
    )


def jsonl_last_wins(spark, folder):
    return jd.last_runs(_runs(spark, folder).select("item_id", "row_id", "run_at", "kind")).select("item_id", "row_id", "kind")


def _questions(spark, folder) -> DataFrame:
    items = table(spark, folder, "test_set").select(F.concat(F.lit("answerable-"), F.col("item_id").cast("string")).alias("item_id"), "question").distinct()
    negatives = table(spark, folder, "negatives").select(F.concat(F.lit("negative-"), F.col("neg_id").cast("string")).alias("item_id"), "question")
    return items.withColumn("kind", F.lit("answerable")).unionByName(negatives.withColumn("kind", F.lit("negative")))


def union_items(spark, folder):
    return _questions(spark, folder)


def pending_items(spark, folder):
    return jd.pending(_questions(spark, folder), _runs(spark, folder)).select("item_id", "kind")


def fallback_questions(spark, folder):
    return jd.fallback_questions(table(spark, folder, "test_set"))


def index_drift(spark, folder):
    chunk = table(spark, folder, "chunk")
    gold = table(spark, folder, "test_set").select(F.explode("gold_chunk_ids").alias("chunk_id"))
    return jd.index_drift(chunk.where("deleted_at is null"), gold)


def build_context(spark, folder):
    lists = _runs(spark, folder).select("row_id", F.col("retrieved_ids").alias("ids"), F.col("retrieved_sources").alias("sources"))
    return jd.build_context(lists, lb.chunk_texts(table(spark, folder, "chunk")))


def extract_json(spark, folder):
    return jd.extract_json(table(spark, folder, "chunk"), "row_id", "page_content")


def parse_judge(spark, folder):
    said = F.concat(F.lit("```json\n"), F.to_json("judge"), F.lit("\n```"))
    rows = _runs(spark, folder).where("judge is not null").select("row_id", jd.parse_verdict(said).alias("v"))
    return rows.select("row_id", *(F.col(f"v.{c}") for c in jd.VERDICTS), F.size("v.unsupported_claims").alias("claims"), "v.reason", "v.valid")


def seeded_sample(spark, folder):
    return jd.seeded_sample(table(spark, folder, "documents").select("doc_id", "source"), "doc_id", 100)


def stratified_sample(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("lang", F.lit("unknown")).alias("stratum"))
    return jd.stratified_sample(docs, "stratum", "doc_id", 100)


def history(spark, folder):
    return sv.history(table(spark, folder, "conversations")).select("owner", "thread_id", "role", "content", "created_at", "place")


def rate_limit(spark, folder):
    events = table(spark, folder, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return sv.rate_limit(events, 2, 6 * 3600).select(F.col("key").cast("long").alias("key"), "id", "count", "allowed")


def stream_filter(spark, folder):
    rows = table(spark, folder, "conversations").where("created_at is not null").select(
        F.concat_ws("/", "owner", "thread_id").alias("thread"), F.struct("created_at", "id").alias("seq"),
        F.when(F.lower(F.trim("role")) == "tool", "tool").otherwise("ai").alias("type"), "content",
    )
    return sv.stream_filter(rows).select("thread", F.col("seq.id").alias("id"), "content")


def embed_stub(spark, folder):
    return md.embed(table(spark, folder, "documents"), "doc_id", "text")


def answer_stub(spark, folder):
    runs = _runs(spark, folder).select("row_id", "question")
    return md.answer(runs.join(build_context(spark, folder), "row_id"), md.first_sentence)


def rule_verdicts(spark, folder):
    return md.rule_verdict(_runs(spark, folder).select("row_id", "kind").join(build_context(spark, folder), "row_id"))


QUERIES = {
    f.__name__: f
    for f in (
        effective_refusal, e2e_summary, hit_faithful_matrix, latency_quantiles, token_usage, jsonl_last_wins, union_items,
        pending_items, fallback_questions, index_drift, build_context, extract_json, parse_judge, seeded_sample,
        stratified_sample, history, rate_limit, stream_filter, embed_stub, answer_stub, rule_verdicts,
    )
}

_WS = r"'[\s\x0b\x1c-\x1f\x85\p{Z}]+'"
_RUNS = rf"""WITH runs AS (SELECT *, CASE WHEN coalesce(generation_error <> '', false) OR coalesce(regexp_replace(answer, {_WS}, '', 'g') = '', true) THEN true
    WHEN judge IS NULL THEN false ELSE coalesce(judge.context_sufficient = false AND judge.refusal_appropriate, false) END AS refusal FROM e2e)"""
_ANSWERED = "(kind = 'answerable' AND judge IS NOT NULL AND NOT refusal)"
_FLAGS = {
    "answered": f"CASE WHEN kind = 'answerable' THEN {_ANSWERED} END",
    "abstained": "CASE WHEN kind = 'answerable' THEN refusal END",
    "faithful": f"CASE WHEN {_ANSWERED} THEN judge.faithful END",
    "relevant": f"CASE WHEN {_ANSWERED} THEN judge.relevant END",
    "unsupported_claims": f"CASE WHEN {_ANSWERED} THEN coalesce(len(judge.unsupported_claims) > 0, false) END",
    "refusal_correct": "CASE WHEN kind = 'negative' AND judge IS NOT NULL THEN judge.refusal_appropriate END",
    "judge_error": "judge_error IS NOT NULL",
    "generation_error": "generation_error IS NOT NULL",
}
_Z = "1.96::double"
_HALF = f"{_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4.0 * n * n)) / (1 + {_Z} * {_Z} / n)"
_MID = f"(p + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n)"
_QUESTIONS = """SELECT DISTINCT 'answerable-' || item_id AS item_id, question, 'answerable' AS kind FROM test_set
    UNION ALL SELECT 'negative-' || neg_id, question, 'negative' FROM negatives"""
_QUANTILE = """SELECT '{0}' AS measure, count({0}) AS n, median({0}) AS p50, (list({0} ORDER BY {0}) FILTER (WHERE {0} IS NOT NULL))[floor(0.95 * (count({0}) - 1))::int + 1] AS p95 FROM e2e"""
_CONTEXT = """WITH texts AS (SELECT chunk_id, arg_min(page_content, row_id) AS text FROM chunk WHERE page_content IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1),
        x AS (SELECT row_id, retrieved_ids AS ids, retrieved_sources AS srcs, unnest(range(1, greatest(len(retrieved_ids), len(retrieved_sources)) + 1)) AS i FROM e2e
              WHERE retrieved_ids IS NOT NULL AND retrieved_sources IS NOT NULL),
        j AS (SELECT row_id, i, coalesce(srcs[i], '?') AS source, chunk_id, text, row_number() OVER (PARTITION BY row_id ORDER BY i) AS n FROM x JOIN texts ON chunk_id = ids[i]),
        c AS (SELECT row_id, string_agg('[' || n || '] ' || source || '#' || chunk_id || chr(10) || text, chr(10) || chr(10) ORDER BY n) AS context FROM j GROUP BY 1)"""
ORACLE_SQL = {
    "answer_stub": _CONTEXT
    + f""" SELECT row_id, CASE WHEN trim(coalesce(context, ''), ' ') = '' THEN '{md.NO_CONTEXT_ANSWER}' ELSE string_split(context, chr(10))[2] END AS answer,
        NULL::varchar AS error FROM e2e LEFT JOIN c USING (row_id)""",
    "embed_stub": r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^\s\x0b\x1c-\x1f\x85\p{Z}]+')) AS word FROM documents),
        m AS (SELECT doc_id, ('0x' || substr(md5(word), 1, 8))::bigint AS mark FROM w),
        s AS (SELECT doc_id, mark % 64 AS place, sum(CASE WHEN mark >= 2147483648 THEN 1 ELSE -1 END)::double AS v FROM m GROUP BY ALL),
        n AS (SELECT doc_id, greatest(sqrt(sum(v * v)), 1e-12) AS norm FROM s GROUP BY 1),
        g AS (SELECT d.doc_id, p.place, coalesce(s.v, 0.0) / coalesce(n.norm, 1e-12) AS v FROM documents d CROSS JOIN range(64) p(place)
              LEFT JOIN s ON s.doc_id = d.doc_id AND s.place = p.place LEFT JOIN n ON n.doc_id = d.doc_id)
        SELECT doc_id, list(v::float ORDER BY place) AS embedding FROM g GROUP BY 1""",
    "effective_refusal": _RUNS + " SELECT row_id, refusal FROM runs",
    "e2e_summary": _RUNS
    + ", long AS ("
    + " UNION ALL ".join(f"SELECT '{name}' AS metric, {flag} AS v FROM runs" for name, flag in _FLAGS.items())
    + f"""), s AS (SELECT metric, count(*) FILTER (WHERE v) AS hits, count(v) AS n, (count(*) FILTER (WHERE v))::double / nullif(count(v), 0) AS p FROM long GROUP BY 1)
      SELECT metric, round(p, 9) AS value, hits, n, CASE WHEN n > 0 THEN round(greatest(0, {_MID} - {_HALF}), 9) ELSE 0.0 END AS low,
             CASE WHEN n > 0 THEN round(least(1, {_MID} + {_HALF}), 9) ELSE 0.0 END AS high FROM s""",
    "hit_faithful_matrix": _RUNS
    + f" SELECT coalesce(retrieval_hit, false) AS hit, coalesce(judge.faithful, false) AS faithful, count(*) AS n FROM runs WHERE {_ANSWERED} GROUP BY 1, 2",
    "latency_quantiles": " UNION ALL ".join(_QUANTILE.format(c) for c in ("retrieval_ms", "generation_ms", "judge_ms")),
    "token_usage": """SELECT kind, sum(usage.answer.prompt_tokens)::bigint AS answer_prompt, sum(usage.answer.completion_tokens)::bigint AS answer_completion,
        sum(usage.judge.prompt_tokens)::bigint AS judge_prompt, sum(usage.judge.completion_tokens)::bigint AS judge_completion FROM e2e GROUP BY 1""",
    "jsonl_last_wins": """SELECT item_id, row_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY run_at DESC NULLS LAST, row_id DESC) AS r
        FROM e2e WHERE item_id IS NOT NULL) WHERE r = 1""",
    "union_items": _QUESTIONS,
    "pending_items": f"SELECT item_id, kind FROM ({_QUESTIONS}) WHERE item_id NOT IN (SELECT item_id FROM e2e WHERE item_id IS NOT NULL)",
    "fallback_questions": """WITH n AS (SELECT item_id, unnest(list_distinct(expected_sources)) AS source, question, coalesce(len(evidence_chunk_ids) > 0, false) AS ok FROM test_set)
        SELECT DISTINCT f.item_id, f.source, p.question FROM n f JOIN n p ON p.source = f.source AND p.ok AND NOT f.ok
        WHERE f.source IS NOT NULL AND p.question IS NOT NULL""",
    "index_drift": """WITH a AS (SELECT DISTINCT chunk_id FROM chunk WHERE deleted_at IS NULL AND chunk_id IS NOT NULL),
        b AS (SELECT DISTINCT chunk_id FROM (SELECT unnest(gold_chunk_ids) AS chunk_id FROM test_set) WHERE chunk_id IS NOT NULL)
        SELECT (SELECT count(*) FROM a) AS n_index, (SELECT count(*) FROM b) AS n_docs,
               (SELECT count(*) FROM a ANTI JOIN b USING (chunk_id)) AS only_index, (SELECT count(*) FROM b ANTI JOIN a USING (chunk_id)) AS only_docs""",
    "build_context": _CONTEXT
    + """
        SELECT row_id, coalesce(context, '') AS context FROM e2e LEFT JOIN c USING (row_id)""",
    "rule_verdicts": """WITH texts AS (SELECT DISTINCT chunk_id FROM chunk WHERE page_content IS NOT NULL),
        full_rows AS (SELECT DISTINCT row_id FROM (SELECT row_id, unnest(retrieved_ids) AS chunk_id FROM e2e WHERE retrieved_sources IS NOT NULL) JOIN texts USING (chunk_id))
        SELECT row_id, false AS context_sufficient, true AS faithful, true AS relevant, true AS refusal_appropriate
        FROM e2e WHERE kind = 'negative' AND row_id NOT IN (SELECT row_id FROM full_rows)""",
    "extract_json": """WITH c AS (SELECT row_id, page_content AS t, instr(page_content, '{') AS b, string_split(page_content, '') AS x FROM chunk),
        s AS (SELECT row_id, t, b, i, sum(CASE x[i] WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY i) AS open
              FROM (SELECT *, unnest(range(b, len(x) + 1)) AS i FROM c WHERE b > 0)),
        e AS (SELECT row_id, min(i) AS e FROM s WHERE open = 0 GROUP BY 1)
        SELECT row_id, substr(t, b, e - b + 1) AS json FROM c LEFT JOIN e USING (row_id)""",
    "parse_judge": """SELECT row_id, judge.context_sufficient AS context_sufficient, judge.faithful AS faithful, judge.relevant AS relevant, judge.refusal_appropriate AS refusal_appropriate,
        coalesce(len(judge.unsupported_claims), 0)::int AS claims, coalesce(judge.reason, '') AS reason,
        judge.context_sufficient IS NOT NULL AND judge.faithful IS NOT NULL AND judge.relevant IS NOT NULL AND judge.refusal_appropriate IS NOT NULL AS valid
        FROM e2e WHERE judge IS NOT NULL""",
    "seeded_sample": "SELECT doc_id, source FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100",
    "stratified_sample": """SELECT doc_id, stratum, turn::int AS turn FROM (SELECT doc_id, coalesce(lang, 'unknown') AS stratum,
        row_number() OVER (PARTITION BY coalesce(lang, 'unknown') ORDER BY md5('42:' || doc_id), doc_id) AS turn FROM documents) ORDER BY turn, stratum LIMIT 100""",
    "history": """SELECT owner, thread_id, role, content, created_at, place::int AS place FROM (SELECT *,
        row_number() OVER (PARTITION BY owner, thread_id ORDER BY created_at DESC NULLS LAST, id DESC) AS place FROM conversations) WHERE place <= 20""",
    "rate_limit": """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        r AS (SELECT user_id, event_id, ts, n, ts AS opened, 1::bigint AS c FROM e WHERE n = 1
              UNION ALL SELECT e.user_id, e.event_id, e.ts, e.n, CASE WHEN e.ts >= r.opened + INTERVAL 6 HOUR THEN e.ts ELSE r.opened END,
                               CASE WHEN e.ts >= r.opened + INTERVAL 6 HOUR THEN 1 ELSE r.c + 1 END
              FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
        SELECT user_id AS key, event_id AS id, c AS count, c <= 2 AS allowed FROM r""",
    "stream_filter": f"""WITH p AS (SELECT concat_ws('/', owner, thread_id) AS thread, created_at, id, lower(trim(role, ' ')) = 'tool' AND role IS NOT NULL AS tool, content FROM conversations WHERE created_at IS NOT NULL),
        f AS (SELECT *, coalesce(sum(tool::int) OVER (PARTITION BY thread ORDER BY created_at, id ROWS UNBOUNDED PRECEDING), 0) AS seen, bool_or(tool) OVER (PARTITION BY thread) AS any_tool FROM p),
        s AS (SELECT thread, id, content FROM f WHERE NOT tool AND content <> '' AND (seen > 0 OR NOT any_tool))
        SELECT thread, id, content FROM s UNION ALL SELECT DISTINCT thread, NULL::bigint, '{sv.FALLBACK}' FROM p WHERE thread NOT IN (SELECT thread FROM s)""",
}
