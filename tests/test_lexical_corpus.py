"""Lexical search has every document as its corpus and every test item of the sample as a query."""

from __future__ import annotations

import pytest
from parity import compare

from lorequarry.plans import registry

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["bm25_scores_all", "bm25_topk_all"])
def test_documents_without_a_vector_are_ranked(spark, name):
    query = registry.queries()[name]
    compare(spark, FOLDER, query, registry.oracle_sql()[name])
    read = lambda t: spark.read.parquet(f"{FOLDER}/{t}.parquet")
    found = query(spark, FOLDER).cache()
    asked = read("test_set").where("item_id % 20 = 0").selectExpr("item_id AS query_id").distinct()
    if name == "bm25_topk_all":  # a question that shares no token with a document has no score, but a list
        assert asked.join(found, "query_id", "left_anti").count() == 0
    vectors = read("embeddings").selectExpr("vec_id AS chunk_id")
    assert found.join(vectors, "chunk_id", "left_anti").count() > 0
