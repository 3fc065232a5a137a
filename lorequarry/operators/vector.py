"""Exact nearest neighbours, maximal marginal relevance and the distance gate.

Queries and rows are packed into blocks, each block of queries meets each block of
rows, and the best k of such a pair leave it: a block join of a stated query set
with all rows.  Neither side reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from lorequarry.shared import materialize

#: Distances are ranked at this many decimals, so that engines agree on ties.
DECIMALS = 9


#: Rows and queries of a block: with them a pair of blocks takes some 70 MB.
ROW_BLOCK, QUERY_BLOCK = 8192, 1024


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as a matrix, from the flat values of the list array."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def _packed(size: int):
    """Rows ``(id, vector)`` as blocks ``(ids, values)`` of raw numbers; vectors of other lengths than the first are an error."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids = rows.column(0).to_numpy().astype(np.int64)
            values = _matrix(rows.column(1).combine_chunks())
            parts = range(0, len(ids), size)
            return pa.RecordBatch.from_arrays(
                [pa.array([ids[a : a + size].tobytes() for a in parts], pa.binary()), pa.array([values[a : a + size].tobytes() for a in parts], pa.binary())],
                names=["ids", "values"],
            )

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= size:
                yield block()
                held, n = [], 0
        if n:
            yield block()

    return pack


def _distances(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    dots = queries @ rows.T
    squares_q, squares_r = (queries**2).sum(1), (rows**2).sum(1)
    if metric == "cosine":
        return 1 - dots / np.sqrt(np.maximum(np.outer(squares_q, squares_r), 1e-300))
    squared = np.maximum(squares_q[:, None] + squares_r[None, :] - 2 * dots, 0)
    return squared if metric == "l2sq" else np.sqrt(squared)


def _search(k: int, metric: str, exclude_self: bool):
    """Of pairs of blocks ``(ids, values, asked, targets)``: the best k rows of each query, and ties with the last of them."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, values, asked, targets in zip(*(c.to_pylist() for c in batch.columns)):
                rows, queries = np.frombuffer(ids, np.int64), np.frombuffer(asked, np.int64)
                far = np.round(_distances(np.frombuffer(targets).reshape(len(queries), -1), np.frombuffer(values).reshape(len(rows), -1), metric), DECIMALS)
                if exclude_self:
                    far[queries[:, None] == rows[None, :]] = np.inf
                last = min(k, len(rows)) - 1
                edge = np.partition(far, last, axis=1)[:, last]
                q, c = np.nonzero((far <= edge[:, None]) & np.isfinite(far))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(queries[q]), pa.array(rows[c]), pa.array(far[q, c])], names=["query_id", "chunk_id", "dist"]
                )

    return search


def nearest(corpus: DataFrame, queries: DataFrame, k: int = 3, metric: str = "l2sq", exclude_self: bool = True) -> DataFrame:
    """``(query_id, chunk_id, dist, rank)``: the k nearest rows of each query, rank from 0, ties by id.

    ``corpus`` has ``chunk_id, embedding`` and ``queries`` ``query_id, embedding``;
    rows without an embedding are left out.  ``metric`` is ``l2sq``, ``l2`` or ``cosine``.
    """
    block = "ids binary, values binary"
    rows = corpus.where("embedding is not null").select(F.col("chunk_id").cast("long"), "embedding").mapInArrow(_packed(ROW_BLOCK), block)
    asked = queries.where("embedding is not null").select(F.col("query_id").cast("long"), "embedding").mapInArrow(_packed(QUERY_BLOCK), block)
    # read again for every block of rows
    asked = materialize(asked.toDF("asked", "targets"), "query-blocks")
    hits = rows.crossJoin(asked).mapInArrow(_search(k, metric, exclude_self), "query_id long, chunk_id long, dist double")
    order = W.partitionBy("query_id").orderBy("dist", "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def best_distance(corpus: DataFrame, queries: DataFrame, metric: str = "l2sq") -> DataFrame:
    """``(query_id, dist)``: distance to the nearest other row, infinity where there is none."""
    best = nearest(corpus, queries, 1, metric).select("query_id", "dist")
    return queries.select("query_id").join(best, "query_id", "left").select(
        "query_id", F.coalesce("dist", F.lit(float("inf"))).alias("dist")
    )


def distance_gate(hits: DataFrame, max_distance: float = 0.96) -> DataFrame:
    """Queries whose nearest hit is at most ``max_distance`` away (equality passes)."""
    return hits.groupBy("query_id").agg(F.min("dist").alias("best")).where(F.col("best") <= max_distance)


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.round(1 - _distances(a, b, "cosine"), DECIMALS)


def marginal_relevance(
    corpus: DataFrame, queries: DataFrame, k: int = 3, fetch_k: int = 10, weight: float = 0.5
) -> DataFrame:
    """``(query_id, chunk_id, rank)``: from the ``fetch_k`` nearest, greedily the most relevant and least alike.

    The first pick is the most similar one; then the first maximum of
    ``weight * similarity to the query - (1 - weight) * largest similarity to a pick``.
    A query's group has at most ``fetch_k`` rows.
    """
    hits = nearest(corpus, queries, fetch_k)
    rows = hits.join(corpus.select("chunk_id", "embedding"), "chunk_id").join(
        queries.select("query_id", F.col("embedding").alias("target")), "query_id"
    )

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        vectors = np.array([np.asarray(v, np.float64) for v in group["embedding"]])
        target = np.asarray(group["target"].iloc[0], np.float64)[None, :]
        relevance, alike = _cosine(target, vectors)[0], _cosine(vectors, vectors)
        chosen = [int(np.argmax(relevance))]
        while len(chosen) < min(k, len(group)):
            score = np.round(weight * relevance - (1 - weight) * alike[:, chosen].max(axis=1), DECIMALS)
            score[chosen] = -np.inf
            chosen.append(int(np.argmax(score)))
        ids = group["chunk_id"].to_numpy()[chosen]
        return pd.DataFrame({"query_id": group["query_id"].iloc[0], "chunk_id": ids, "rank": np.arange(len(ids), dtype=np.int32)})

    return rows.groupBy("query_id").applyInPandas(pick, "query_id long, chunk_id long, rank int")


def diverse_relevance(corpus: DataFrame, queries: DataFrame, k: int = 3, fetch_k: int = 10) -> DataFrame:
    """Marginal relevance over 3k picks, then the first chunk of each source until k; ``corpus`` also has ``source``."""
    picks = marginal_relevance(corpus, queries, 3 * k, fetch_k).join(corpus.select("chunk_id", "source"), "chunk_id")
    first = W.partitionBy("query_id", "source").orderBy("rank")
    order = W.partitionBy("query_id").orderBy("rank")
    kept = picks.withColumn("of_source", F.row_number().over(first)).where("of_source = 1")
    return (
        kept.withColumn("place", F.row_number().over(order) - 1)
        .where(F.col("place") < k)
        .select("query_id", "chunk_id", F.col("place").alias("rank"), "source")
    )
