"""An index for one use scores chunks where they are read and sends no score that is not returned."""

from __future__ import annotations

import random

import pytest

from lorequarry.operators import lexical


@pytest.fixture
def tables(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    bag = lambda n: " ".join(rng.choices(words, weights=range(60, 0, -1), k=n))
    corpus = [(i, bag(rng.randint(0, 30)) if i % 17 else None) for i in range(400)]
    asked = [(i, bag(rng.randint(1, 6))) for i in range(0, 40)] + [(90, "nothing"), (91, None), (92, "w59 w59 w58"), (93, "w0")]
    return spark.createDataFrame(corpus, "chunk_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")


def test_no_pair_is_shuffled(tables):
    plan = lexical.bm25_scores(*tables)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("self", [False, True])
def test_passes_and_parts_agree_with_a_stored_index(spark, tables, tmp_path, monkeypatch, self):
    monkeypatch.setattr(lexical, "PASS_TOKENS", 40, raising=True)
    corpus, queries = tables
    lexical.store_lexical_index(corpus, str(tmp_path))
    stored = lexical.open_lexical_index(spark, str(tmp_path))
    plain = lambda df: sorted(map(tuple, df.select("query_id", "chunk_id", "score").collect()))
    assert plain(lexical.bm25_scores(corpus, queries)) == [(*r[:2], pytest.approx(r[2], abs=2e-9)) for r in plain(lexical.bm25_scores(stored, queries))]
    top = lambda x: sorted(map(tuple, lexical.bm25_top(x, queries, 20, self).select("query_id", "rank", "chunk_id").collect()))
    assert top(corpus) == top(stored)
