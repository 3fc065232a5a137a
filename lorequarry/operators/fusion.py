"""Weighted reciprocal-rank fusion, the hybrid strategy and the rerank stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lorequarry.functions.text import normalize_text, tokens
from lorequarry.operators.lexical import LexicalIndex, bm25_top
from lorequarry.operators.vector import distance_gate, nearest
from lorequarry.shared import materialize


def fuse_ranks(
    vector_hits: DataFrame, lexical_hits: DataFrame, vector_weight: float = 0.7, lexical_weight: float = 0.3, rrf_k: int = 60
) -> DataFrame:
    """``(query_id, chunk_id, score, rank)`` of two ranked lists; ranks count from 0, also in the score.

    Ties go to the better vector rank, then the better lexical rank, then the id.
    """
    keys = ["query_id", "chunk_id"]
    both = vector_hits.select(*keys, F.col("rank").alias("v")).join(
        lexical_hits.select(*keys, F.col("rank").alias("x")), keys, "full"
    )
    score = F.coalesce(vector_weight / (rrf_k + F.col("v")), F.lit(0.0)) + F.coalesce(
        lexical_weight / (rrf_k + F.col("x")), F.lit(0.0)
    )
    scored = both.withColumn("score", F.round(score, 12))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("v"), F.asc_nulls_last("x"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order) - 1).select(*keys, "score", "rank")


def dedup_content(ranked: DataFrame, corpus: DataFrame) -> DataFrame:
    """Ranked hits without those that repeat the normalised text of a better one; ranks are closed up."""
    texts = corpus.select("chunk_id", F.md5(normalize_text(F.coalesce("text", F.lit("")))).alias("print"))
    first = W.partitionBy("query_id", "print").orderBy("rank")
    order = W.partitionBy("query_id").orderBy("rank")
    kept = ranked.join(texts, "chunk_id").withColumn("seen", F.row_number().over(first)).where("seen = 1")
    return kept.withColumn("rank", F.row_number().over(order) - 1).select("query_id", "chunk_id", "score", "rank")


def hybrid_search(
    corpus: DataFrame, queries: DataFrame, k: int = 3, rrf_k: int = 60, vector_weight: float = 0.7,
    lexical_weight: float = 0.3, max_distance: float = 0.96, dedupe: bool = True, exclude_self: bool = True,
    lexical_index: LexicalIndex | None = None,
) -> DataFrame:
    """``(query_id, chunk_id, score, rank)``: gate, two legs of 3k, fusion, content dedup, best k.

    With ``lexical_index``, a stored index of the corpus, its texts are not tokenised again.

    The gate drops whole queries before the lexical leg runs.
    """
    # read three times below; at most 3k rows a query
    hits = materialize(nearest(corpus, queries, 3 * k, exclude_self=exclude_self), "hits")
    passed = distance_gate(hits, max_distance).select("query_id")
    let_in = queries.join(passed, "query_id", "left_semi")
    lexical = bm25_top(lexical_index or corpus, let_in, 3 * k, exclude_self)
    ranked = fuse_ranks(hits.join(passed, "query_id", "left_semi"), lexical, vector_weight, lexical_weight, rrf_k)
    if dedupe:
        ranked = dedup_content(ranked, corpus)
    return ranked.where(F.col("rank") < k)


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that the text holds (stands in for a trained scorer)."""
    asked = F.array_distinct(tokens(F.coalesce(query, F.lit(""))))
    shared = F.size(F.array_intersect(asked, tokens(F.coalesce(text, F.lit("")))))
    return F.when(F.size(asked) > 0, F.round(shared / F.size(asked), 9)).otherwise(F.lit(0.0))


def rerank(
    candidates: DataFrame, queries: DataFrame, corpus: DataFrame, top_k: int = 3, scorer: Callable[[Column, Column], Column] = overlap_score
) -> DataFrame:
    """``(query_id, chunk_id, score, rank)``: candidates by the scorer, ties by their earlier rank."""
    pairs = candidates.select("query_id", "chunk_id", F.col("rank").alias("before"))
    pairs = pairs.join(queries.select("query_id", F.col("text").alias("asked")), "query_id").join(
        corpus.select("chunk_id", "text"), "chunk_id"
    )
    scored = pairs.withColumn("score", scorer(F.col("asked"), F.col("text")))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "before")
    ranked = scored.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < top_k)
    return ranked.select("query_id", "chunk_id", "score", "rank")


def hybrid_rerank(
    corpus: DataFrame, queries: DataFrame, recall_k: int = 20, final_k: int = 3, enabled: bool = True, **search
) -> DataFrame:
    """Hybrid search over ``recall_k``, then the rerank stage; without it, the head of the first stage."""
    found = hybrid_search(corpus, queries, recall_k, **search)
    return rerank(found, queries, corpus, final_k) if enabled else found.where(F.col("rank") < final_k)
