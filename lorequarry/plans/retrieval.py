"""Retrieval queries: every embedding is the corpus, those whose id is divisible by 20 are the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lorequarry.operators import fusion, lexical, vector
from lorequarry.shared import scratch_path
from lorequarry.sources import files
from lorequarry.sources.tables import table

GATE, POOL = 1.25, 20


def corpus(spark, folder) -> DataFrame:
    """Embeddings with the text of the document of the same id."""
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source")
    return vectors.join(texts, "chunk_id")


def questions(spark, folder) -> DataFrame:
    """Query vectors with the question of the test item of the same id, if there is one."""
    asked = table(spark, folder, "test_set").groupBy(F.col("item_id").alias("query_id")).agg(F.min("question").alias("text"))
    vectors = table(spark, folder, "embeddings").where("vec_id % 20 = 0")
    return vectors.select(F.col("vec_id").alias("query_id"), "embedding", "label").join(asked, "query_id", "left")


def all_documents(spark, folder) -> DataFrame:
    """Every document, indexed or not: lexical search needs no vector."""
    return table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def all_questions(spark, folder) -> DataFrame:
    """Every test item whose id is divisible by 20, with a vector or not."""
    asked = table(spark, folder, "test_set").where("item_id % 20 = 0")
    return asked.groupBy(F.col("item_id").alias("query_id")).agg(F.min("question").alias("text"))


def _dist(df: DataFrame) -> DataFrame:
    return df.withColumn("dist", F.round("dist", 6))


def _score(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def knn_l2(spark, folder):
    return _dist(vector.nearest(corpus(spark, folder), questions(spark, folder), 3))


def knn_cosine(spark, folder):
    return _dist(vector.nearest(corpus(spark, folder), questions(spark, folder), 10, "cosine"))


def best_distance(spark, folder):
    return _dist(vector.best_distance(corpus(spark, folder), questions(spark, folder)))


def distance_gate(spark, folder):
    hits = vector.nearest(corpus(spark, folder), questions(spark, folder), 9)
    return vector.distance_gate(hits, GATE).withColumn("best", F.round("best", 6))


def mmr(spark, folder):
    return vector.marginal_relevance(corpus(spark, folder), questions(spark, folder), 3)


def mmr_diverse(spark, folder):
    return vector.diverse_relevance(corpus(spark, folder), questions(spark, folder), 3)


def bm25_scores(spark, folder):
    return _score(lexical.bm25_scores(corpus(spark, folder), questions(spark, folder)))


def bm25_topk(spark, folder):
    return _score(lexical.bm25_top(corpus(spark, folder), questions(spark, folder), 60, True))


def bm25_scores_all(spark, folder):
    return _score(lexical.bm25_scores(all_documents(spark, folder), all_questions(spark, folder)))


def bm25_topk_all(spark, folder):
    # item ids and document ids are not of one kind, so no document is a query's own
    return _score(lexical.bm25_top(all_documents(spark, folder), all_questions(spark, folder), 60))


def rrf_fuse(spark, folder):
    c, q = corpus(spark, folder), questions(spark, folder)
    return fusion.fuse_ranks(vector.nearest(c, q, 60), lexical.bm25_top(c, q, 60, True))


def dedup_content(spark, folder):
    c, q = corpus(spark, folder), questions(spark, folder)
    ranked = vector.nearest(c, q, 60).withColumn("score", F.round(-F.col("dist"), 6))
    return fusion.dedup_content(ranked, c)


def hybrid_search(spark, folder):
    return fusion.hybrid_search(corpus(spark, folder), questions(spark, folder), POOL, max_distance=GATE)


def index_search(spark, folder):
    """The hybrid strategy on an index that is stored and opened again."""
    place = scratch_path(spark, "index")
    files.store_index(corpus(spark, folder), place)
    chunks, lexicon = files.open_index(spark, place)
    return fusion.hybrid_search(chunks, questions(spark, folder), POOL, max_distance=GATE, lexical_index=lexicon)


def hybrid_no_dedup(spark, folder):
    return fusion.hybrid_search(corpus(spark, folder), questions(spark, folder), POOL, max_distance=GATE, dedupe=False)


def rerank(spark, folder):
    c, q = corpus(spark, folder), questions(spark, folder)
    return _score(fusion.rerank(vector.nearest(c, q, POOL), q, c))


def hybrid_rerank(spark, folder):
    return _score(fusion.hybrid_rerank(corpus(spark, folder), questions(spark, folder), POOL, 3, max_distance=GATE))


QUERIES = {
    f.__name__: f
    for f in (
        knn_l2, knn_cosine, best_distance, distance_gate, mmr, mmr_diverse, bm25_scores, bm25_topk, bm25_scores_all,
        bm25_topk_all, rrf_fuse, dedup_content, hybrid_search, index_search, hybrid_no_dedup, rerank, hybrid_rerank,
    )
}

_DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::double * {b}[i]::double))"
_SQ = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i]::double - {b}[i]::double) * ({a}[i]::double - {b}[i]::double)))"
_L2 = _SQ.format(a="q.embedding", b="c.embedding")
_COS = "{} / sqrt({} * {})".format(
    _DOT.format(a="q.embedding", b="c.embedding"), _DOT.format(a="q.embedding", b="q.embedding"), _DOT.format(a="c.embedding", b="c.embedding")
)
_NORMAL = r"trim(regexp_replace(coalesce(text, ''), '[\s\x0b\x1c-\x1f\x85\p{Z}]+', ' ', 'g'))"
_TOKENS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+')"

_INPUT = """
WITH corpus AS (SELECT vec_id AS chunk_id, embedding, label, text, source FROM embeddings JOIN documents ON doc_id = vec_id),
asked AS (SELECT item_id AS query_id, min(question) AS text FROM test_set GROUP BY 1),
queries AS (SELECT vec_id AS query_id, embedding, label, text FROM embeddings LEFT JOIN asked ON query_id = vec_id WHERE vec_id % 20 = 0)
"""
_DIST = (
    _INPUT
    + f""", dist AS (SELECT query_id, chunk_id, round({_L2}, 9) AS dist FROM queries q, corpus c WHERE query_id <> chunk_id),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, chunk_id) - 1 AS rank FROM dist)
"""
)
_BM25 = (
    _DIST
    + f""", words AS (SELECT chunk_id, {_TOKENS.format("text")} AS bag FROM corpus),
post AS (SELECT token, chunk_id, count(*) AS tf, any_value(dl) AS dl
         FROM (SELECT chunk_id, len(bag) AS dl, unnest(bag) AS token FROM words) GROUP BY 1, 2),
raw AS (SELECT token, ln((SELECT count(*) FROM corpus) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post GROUP BY 1),
idf AS (SELECT token, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
ask AS (SELECT query_id, token, count(*) AS times
        FROM (SELECT query_id, unnest({_TOKENS.format("text")}) AS token FROM queries) GROUP BY 1, 2),
scores AS (SELECT query_id, chunk_id,
             round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(len(bag)) FROM words)))), 9) AS score
           FROM ask JOIN idf USING (token) JOIN post USING (token) GROUP BY 1, 2),
allscores AS (SELECT query_id, c.chunk_id, coalesce(score, 0.0) AS score
              FROM queries q CROSS JOIN corpus c LEFT JOIN scores s USING (query_id, chunk_id) WHERE query_id <> c.chunk_id),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM allscores)
"""
)
_BM25_ALL = """
WITH corpus AS (SELECT doc_id AS chunk_id, text FROM documents),
queries AS (SELECT item_id AS query_id, min(question) AS text FROM test_set WHERE item_id % 20 = 0 GROUP BY 1)
""" + _BM25.removeprefix(_DIST).replace(" WHERE query_id <> c.chunk_id", "")
_FUSED = (
    _BM25
    + """, fused AS (
  SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, v NULLS LAST, x NULLS LAST, chunk_id) - 1 AS rank
  FROM (SELECT coalesce(n.query_id, l.query_id) AS query_id, coalesce(n.chunk_id, l.chunk_id) AS chunk_id, n.rank AS v, l.rank AS x,
               round(coalesce(0.7::double / (60 + n.rank), 0) + coalesce(0.3::double / (60 + l.rank), 0), 12) AS score
        FROM (SELECT * FROM near WHERE rank < 60) n
        FULL JOIN (SELECT * FROM lex WHERE rank < 60) l ON n.query_id = l.query_id AND n.chunk_id = l.chunk_id))
"""
)
_GATED = _FUSED + """, passed AS (SELECT query_id FROM dist GROUP BY 1 HAVING min(dist) <= 1.25)"""
_DEDUPED = f"""SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS rank
  FROM (SELECT f.*, row_number() OVER (PARTITION BY query_id, {_NORMAL} ORDER BY rank) AS seen FROM {{}} f JOIN corpus USING (chunk_id))
  WHERE seen = 1"""
_HYBRID = _GATED + f""", deduped AS ({_DEDUPED.replace("{" + "}", "fused")}),
found AS (SELECT * FROM deduped WHERE rank < 20 AND query_id IN (SELECT query_id FROM passed))
"""
_RERANK = """, rescored AS (
  SELECT query_id, chunk_id, f.rank AS before,
         CASE WHEN len(a) > 0 THEN round(len(list_intersect(a, b))::double / len(a), 9) ELSE 0.0 END AS score
  FROM {} f JOIN (SELECT query_id, list_distinct({}) AS a FROM queries) USING (query_id)
       JOIN (SELECT chunk_id, list_distinct({}) AS b FROM corpus) USING (chunk_id)),
reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) - 1 AS rank FROM rescored)
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM reranked WHERE rank < 3"""
_TK = _TOKENS.format("text")
_MMR = (
    _DIST
    + f""", cand AS (SELECT n.query_id, n.chunk_id, n.rank AS place, round({_COS}, 9) AS sim, c.embedding
                 FROM near n JOIN corpus c USING (chunk_id) JOIN queries q USING (query_id) WHERE n.rank < 10),
pairs AS (SELECT q.query_id, q.chunk_id AS a, c.chunk_id AS b, round({_COS}, 9) AS alike FROM cand q JOIN cand c USING (query_id)),
pick0 AS (SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, place) AS r FROM cand) WHERE r = 1)
"""
)


def _next_pick(n: int) -> str:
    taken = " UNION ALL ".join(f"SELECT * FROM pick{i}" for i in range(n))
    return f""", pick{n} AS (SELECT query_id, chunk_id FROM (
      SELECT c.query_id, c.chunk_id, row_number() OVER (PARTITION BY c.query_id ORDER BY round(0.5::double * any_value(sim) - 0.5::double * max(alike), 9) DESC, any_value(place)) AS r
      FROM cand c JOIN pairs p ON p.query_id = c.query_id AND p.a = c.chunk_id JOIN ({taken}) t ON t.query_id = c.query_id AND t.chunk_id = p.b
      WHERE NOT EXISTS (SELECT 1 FROM ({taken}) u WHERE u.query_id = c.query_id AND u.chunk_id = c.chunk_id)
      GROUP BY c.query_id, c.chunk_id) WHERE r = 1)"""


_PICKS = " UNION ALL ".join(f"SELECT query_id, chunk_id, {i} AS rank FROM pick{i}" for i in range(9))
_MMR9 = _MMR + "".join(_next_pick(i) for i in range(1, 9)) + f", picks AS ({_PICKS})"

ORACLE_SQL = {
    "knn_l2": _DIST + "SELECT query_id, chunk_id, round(dist, 6) AS dist, rank FROM near WHERE rank < 3",
    "knn_cosine": _INPUT
    + f"""SELECT query_id, chunk_id, round(dist, 6) AS dist, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, chunk_id) - 1 AS rank
      FROM (SELECT query_id, chunk_id, round(1 - {_COS}, 9) AS dist FROM queries q, corpus c WHERE query_id <> chunk_id)) WHERE rank < 10""",
    "best_distance": _DIST
    + """SELECT q.query_id, coalesce(round(min(dist), 6), 'infinity'::double) AS dist
         FROM queries q LEFT JOIN dist d ON d.query_id = q.query_id GROUP BY 1""",
    "distance_gate": _DIST + "SELECT query_id, round(min(dist), 6) AS best FROM dist GROUP BY 1 HAVING min(dist) <= 1.25",
    "mmr": _MMR + "".join(_next_pick(i) for i in (1, 2)) + "".join(
        f"{' UNION ALL ' if i else ''} SELECT query_id, chunk_id, {i} AS rank FROM pick{i}" for i in range(3)),
    "mmr_diverse": _MMR9
    + """SELECT query_id, chunk_id, rank, source FROM (
      SELECT query_id, chunk_id, source, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS rank FROM (
        SELECT p.*, source, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS s FROM picks p JOIN corpus USING (chunk_id)) WHERE s = 1)
      WHERE rank < 3""",
    "bm25_scores": _BM25 + "SELECT query_id, chunk_id, round(score, 6) AS score FROM scores",
    "bm25_topk": _BM25 + "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM lex WHERE rank < 60",
    "bm25_scores_all": _BM25_ALL + "SELECT query_id, chunk_id, round(score, 6) AS score FROM scores",
    "bm25_topk_all": _BM25_ALL + "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM lex WHERE rank < 60",
    "rrf_fuse": _FUSED + "SELECT query_id, chunk_id, score, rank FROM fused",
    "dedup_content": _DIST
    + ", top AS (SELECT query_id, chunk_id, round(-dist, 6) AS score, rank FROM near WHERE rank < 60) " + _DEDUPED.replace("{}", "top"),
    "hybrid_search": _HYBRID + "SELECT query_id, chunk_id, score, rank FROM found",
    "index_search": _HYBRID + "SELECT query_id, chunk_id, score, rank FROM found",
    "hybrid_no_dedup": _GATED
    + "SELECT query_id, chunk_id, score, rank FROM fused WHERE rank < 20 AND query_id IN (SELECT query_id FROM passed)",
    "rerank": _DIST + ", top AS (SELECT * FROM near WHERE rank < 20)" + _RERANK.format("top", _TK, _TK),
    "hybrid_rerank": _HYBRID + _RERANK.format("found", _TK, _TK),
}
