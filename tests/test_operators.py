from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from lorequarry.functions import text as tx
from lorequarry.operators import chunking as ck, fusion, judged, metrics as mt, models as md, scans, vector


def one(spark, **columns):
    row = spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()
    return tuple(row)


def ids(*values):
    return F.array(*(F.lit(v) for v in values)).cast("array<string>")


def test_metric_goldens(spark):
    a, b = ids("a"), ids("a", "b")
    assert one(
        spark, any1=mt.recall_any(b, ids("b", "c")), any2=mt.recall_any(a, ids("b")), any3=mt.recall_any(ids(), a),
        all1=mt.recall_all(ids("a", "b", "x"), b), all2=mt.recall_all(a, b), all3=mt.recall_all(a, ids()),
        cov1=mt.coverage(b, ids("a", "c")), cov2=mt.coverage(ids(), a), cov3=mt.coverage(a, ids()),
        p1=mt.precision_at(ids("a", "x", "b"), b, 3), p2=mt.precision_at(ids("x", "a"), a, 3), p0=mt.precision_at(a, a, 0),
        m1=mt.reciprocal_rank(ids("x", "a"), a), m2=mt.reciprocal_rank(ids("x"), a), m3=mt.reciprocal_rank(ids("x", None, "a"), a),
        n1=mt.ndcg_at(a, a, 3), n2=mt.ndcg_at(ids("x", "a"), a, 3), n3=mt.ndcg_at(ids("x"), a, 3), n4=mt.ndcg_at(ids(), a, 3), n5=mt.ndcg_at(a, ids(), 3),
    ) == (1, 0, 0, 1, 0, 0, 0.5, 0, 0, pytest.approx(2 / 3), pytest.approx(1 / 3), 0, 0.5, 0, pytest.approx(1 / 3), 1, pytest.approx(1 / math.log2(3)), 0, 0, 0)


@pytest.mark.parametrize(
    "hits, n, low, high", [(0, 0, 0, 0), (66, 66, 0.944996, 1), (65, 66, 0.919039, 0.997320), (20, 20, 0.838870, 1), (0, 66, 0, 0.055004)]
)
def test_wilson_goldens(spark, hits, n, low, high):
    lo, hi = mt.wilson(F.lit(hits), F.lit(n))
    assert one(spark, lo=lo, hi=hi) == (pytest.approx(low, abs=1e-6), pytest.approx(high, abs=1e-6))


def test_paired_bootstrap(spark):
    pairs = spark.createDataFrame([(i, a, 0.0) for i, a in enumerate([1.0, 1.0, 1.0, 0.0, 1.0])], "key long, a double, b double")
    r = mt.paired_bootstrap(pairs, 300).first()
    assert r.mean_diff == pytest.approx(0.8) and r.low <= 0.8 <= r.high and 0 <= r.p_value <= 1
    with pytest.raises(Exception, match="unequal"):
        mt.paired_bootstrap(spark.createDataFrame([(0, 1.0, None)], "key long, a double, b double"), 10).collect()


def test_chunk_ids_and_text(spark):
    made = lambda s, o, t="x  y": tx.stable_chunk_id(F.lit(s), F.lit("h"), F.lit(t), F.lit(o))
    a, same, source, occurrence = one(spark, a=made("s", 0), b=made("s", 0, " x y "), c=made("t", 0), d=made("s", 1))
    assert len(a) == 16 and a == same and len({a, source, occurrence}) == 3
    assert one(spark, a=tx.derive_chunk_id(F.lit("fixed"), F.lit("s"), F.lit("h"), F.lit("x")))[0] == "fixed"
    assert one(
        spark, n=tx.normalize_text(F.lit(" a　 b\x1cc\n")), g=tx.char_trigrams(F.lit("a b")), g2=tx.char_trigrams(F.lit("ab cabc")),
        j=tx.jaccard(ids(), ids()), y=tx.normalize_bool(F.lit(" YES ")), no=tx.normalize_bool(F.lit("0")), q=tx.normalize_bool(F.lit("maybe")),
        t=tx.valid_thread(F.lit("x" * 49)), t0=tx.valid_thread(F.lit("")), u=tx.unfence(F.lit('```json\n{"a":1}\n```')),
    ) == ("a b c", [], ["abc", "bca", "cab"], 0, True, False, None, False, False, '\n{"a":1}\n')


def test_headings_skip_fences():
    text = "# Root\n\n```\n# no heading\n```\n\n## Real ##\nbody"
    assert ck.heading_list(text) == [(0, 1, "Root"), (text.index("## Real"), 2, "Real")]
    assert ck.path_at(text, text.index("body")) == "Root > Real"
    assert ck.path_at(text, -1) == "" and ck.path_at("plain", 3) == ""
    assert [p for _, p in ck.path_list([(0, 2, "a"), (1, 3, "b"), (2, 1, "c"), (3, 3, "d")])] == ["a", "a > b", "c", "c > d"]


def test_recursive_pieces_cover_the_text():
    text = ("First sentence here. " * 20 + "\n\n") * 3 + "，".join("句子" * 30 + "。" for _ in range(20)) + "x" * 700
    pieces = ck.recursive_pieces(text)
    assert all(len(p) <= 300 and text[s : s + len(p)] == p for s, p in pieces)
    seen = set().union(*(range(s, s + len(p)) for s, p in pieces))
    assert all(i in seen for i, c in enumerate(text) if not c.isspace())
    assert ck.recursive_pieces("") == [] and ck.recursive_pieces("  \n") == [] and ck.recursive_pieces("short") == [(0, "short")]


def test_duplicates_in_a_source_get_their_own_ids(spark):
    rows = [(1, "s", 0, "T", "same"), (1, "s", 1, "T", "same"), (2, "s", 0, "T", " same "), (3, "t", 0, "T", "same")]
    made = ck.enrich(spark.createDataFrame(rows, "doc_id long, source string, piece int, section_path string, text string")).collect()
    assert len({r.chunk_id for r in made}) == 4
    assert sorted((r.chunk_index, r.occurrence) for r in made) == [(0, 0), (1, 1), (2, 2), (3, 0)]


def _corpus(spark, vectors):
    rows = [(i, v, t, s) for i, (v, t, s) in enumerate(vectors)]
    return spark.createDataFrame(rows, "chunk_id long, embedding array<float>, text string, source string")


def test_hybrid_dedup_and_gate(spark):
    corpus = _corpus(spark, [([1.0, 0.0], "alpha  beta", "a"), ([0.9, 0.1], "alpha beta", "b"), ([0.5, 0.5], "gamma", "c")])
    asked = spark.createDataFrame([(100, [1.0, 0.0], "nothing shared")], "query_id long, embedding array<float>, text string")
    run = lambda **kw: {r.chunk_id for r in fusion.hybrid_search(corpus, asked, 3, **kw).collect()}
    assert run(dedupe=False) == {0, 1, 2} and run() == {0, 2}
    assert run(max_distance=-1.0) == set()
    lexical = spark.createDataFrame([(100, [9.0, 9.0], "gamma")], "query_id long, embedding array<float>, text string")
    assert fusion.hybrid_search(corpus, lexical, 3).count() == 0
    off = fusion.hybrid_rerank(corpus, asked, 3, 2, enabled=False, dedupe=False)
    assert off.count() == 2
    on = fusion.hybrid_rerank(corpus, lexical, 3, 3, max_distance=1e9).orderBy("rank").collect()
    assert on[0].chunk_id == 2 and on[0].score == 1.0


def test_mmr_and_infinite_distance(spark):
    corpus = _corpus(spark, [([1.0, 0.0], "a", "s"), ([0.99, 0.05], "b", "s"), ([0.0, 1.0], "c", "t")])
    asked = spark.createDataFrame([(100, [1.0, 0.02], "q")], "query_id long, embedding array<float>, text string")
    picks = [r.chunk_id for r in vector.marginal_relevance(corpus, asked, 3).orderBy("rank").collect()]
    assert picks[0] == 0 and sorted(picks) == [0, 1, 2]
    assert [r.source for r in vector.diverse_relevance(corpus, asked, 2).orderBy("rank").collect()] == ["s", "t"]
    none = corpus.where("chunk_id < 0")
    assert vector.best_distance(none, asked).first().dist == math.inf


def test_lexical_legs_never_outrank_small_vector_legs():
    assert all(0.7 / (60 + 3 * k - 1) > 0.3 / 60 for k in range(1, 27)) and 0.7 / (60 + 3 * 27 - 1) <= 0.3 / 60


def test_rank_picks_with_ties(spark):
    rows = [("a", float(v)) for v in [5, 1, 1, 3, 9, 9, 9, 2]] + [("b", 4.0), ("c", None)]
    picked = scans.pick_by_rank(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"mid": F.floor(F.col("_n") / 2), "last": F.col("_n") - 1})
    assert {r.k: (r.mid, r.last) for r in picked.collect()} == {"a": (5.0, 9.0), "b": (4.0, 4.0)}


def test_verdicts_and_objects(spark):
    assert judged.balanced_object('x {"a": {"b": 1}} y}') == '{"a": {"b": 1}}'
    assert judged.balanced_object("{ {") is None and judged.balanced_object(None) is None and judged.balanced_object("}") is None
    good = '```json\n{"context_sufficient": "yes", "faithful": 1, "relevant": true, "refusal_appropriate": "否"}\n```'
    bad = '{"context_sufficient": "yes", "faithful": "perhaps"}'
    v, w = one(spark, a=judged.parse_verdict(F.lit(good)), b=judged.parse_verdict(F.lit(bad)))
    assert (v.valid, v.faithful, v.refusal_appropriate, v.unsupported_claims, v.reason) == (True, True, False, [], "") and not w.valid


def test_model_rules(spark):
    rows = spark.createDataFrame([(1, "q", "src\nfirst line", "answerable"), (2, "q", "  ", "negative"), (3, "fail", "src\nx", "negative"), (4, "q", None, "negative")], "row_id long, question string, context string, kind string")

    def model(question, context):
        if question == "fail":
            raise TimeoutError("slow")
        return md.first_sentence(question, context)

    made = {r.row_id: (r.answer, r.error) for r in md.answer(rows, model, attempts=2, wait=0.0).collect()}
    assert made == {1: ("first line", None), 2: (md.NO_CONTEXT_ANSWER, None), 3: (None, "TimeoutError: slow"), 4: (md.NO_CONTEXT_ANSWER, None)}
    assert sorted(r.row_id for r in md.rule_verdict(rows).collect()) == [2, 4]
    picks = spark.createDataFrame([(1, [2, 0, 2, 5, -1, None], 3)], "row_id long, picked array<int>, n int")
    assert md.valid_evidence(picks).first().evidence == [0, 2]
    vectors = [r.embedding for r in md.embed(rows, "row_id", "context").orderBy("row_id").collect()]
    assert len(vectors[0]) == 64 and sum(x * x for x in vectors[0]) == pytest.approx(1, abs=1e-5) and not any(vectors[3])


def test_retry_doubles_the_pause():
    pauses, calls = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError
        return x

    assert md.with_retry(flaky, 3, 1.0, pauses.append)(7) == 7 and pauses == [1.0, 2.0]
