"""Negative scores, a stored index, and the postings that a query looks at."""

from __future__ import annotations

from lorequarry.operators.lexical import bm25_scores, bm25_top, open_lexical_index, store_lexical_index

DOCS = [(i, "common" if i < 12 else f"other{i}") for i in range(20)]


def frames(spark):
    corpus = spark.createDataFrame(DOCS, "chunk_id long, text string")
    return corpus, spark.createDataFrame([(100, "common"), (101, None), (102, "other13 common")], "query_id long, text string")


def test_chunks_without_a_score_outrank_negative_ones(spark):
    corpus, asked = frames(spark)
    top = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in bm25_top(corpus, asked, 3).collect()}
    # the idf of a token that all but a few chunks hold is a share of the mean idf, here above 0
    scores = {(r.query_id, r.chunk_id): r.score for r in bm25_scores(corpus, asked).collect()}
    want = {}
    for q in (100, 101, 102):
        best = sorted(range(20), key=lambda c: (-scores.get((q, c), 0.0), c))[:3]
        want |= {(q, n): (c, scores.get((q, c), 0.0)) for n, c in enumerate(best)}
    assert top == want


def test_the_mean_idf_may_be_negative(spark):
    corpus = spark.createDataFrame([(i, "common") if i < 12 else (i, "") for i in range(20)], "chunk_id long, text string")
    asked = spark.createDataFrame([(100, "common")], "query_id long, text string")
    rows = bm25_top(corpus, asked, 3).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in rows] == [(12, 0.0), (13, 0.0), (14, 0.0)]
    own = bm25_top(corpus, spark.createDataFrame([(13, "common")], "query_id long, text string"), 3, True).orderBy("rank").collect()
    assert [r.chunk_id for r in own] == [12, 14, 15]


def test_a_stored_index_answers_alike(spark, tmp_path):
    corpus, asked = frames(spark)
    store_lexical_index(corpus, str(tmp_path / "index"))
    stored = open_lexical_index(spark, str(tmp_path / "index"))
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "chunk_id", "score", "rank").collect())
    assert rows(bm25_top(stored, asked, 4)) == rows(bm25_top(corpus, asked, 4))
    none = spark.createDataFrame([], "chunk_id long, text string")
    assert bm25_top(none, asked, 3).count() == 0


def test_documents_to_search_by_a_stored_index(spark, tmp_path):
    from lorequarry.operators.fusion import hybrid_search
    from lorequarry.operators.models import embed
    from lorequarry.sources.files import build_index, index_check, load_or_build_index, open_index

    docs = spark.createDataFrame([(0, "a.md", "# One\n\nred apples grow here"), (1, "b.md", "# Two\n\nblue boats sail there"), (2, "c.md", "plain words")], "doc_id long, source string, text string")
    path = str(tmp_path / "index")
    build_index(docs, path)
    assert index_check(load_or_build_index(spark, docs, path)).first() == (3, 0, 0, 0)
    chunks, lexicon = open_index(spark, path, "chunk_index")
    asked = spark.createDataFrame([(100, "blue boats")], "query_id long, text string")
    asked = asked.join(embed(asked, "query_id", "text"), "query_id")
    found = hybrid_search(chunks, asked, 2, max_distance=9.0, exclude_self=False, lexical_index=lexicon)
    best = found.join(chunks, "chunk_id").orderBy("rank").first()
    assert (best.source, best.section_path) == ("b.md", "Two") and len(best.name) == 16
