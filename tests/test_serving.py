from __future__ import annotations

import datetime as dt
import json

import pytest

from lorequarry.operators.serving import FALLBACK, history, rate_limit, stream_filter
from lorequarry.sources import files
from lorequarry.streaming.serving import fail_open, filter_tokens, limit_requests

NOON = dt.datetime(2024, 5, 1, 12)


def test_limits_by_window_and_tenant(spark):
    calls = [("a", NOON + dt.timedelta(seconds=s), i) for i, s in enumerate([0, 1, 2, 3, 61, 62])] + [("b", NOON, 9), (None, NOON, 10)]
    rows = rate_limit(spark.createDataFrame(calls, "key string, at timestamp_ntz, id long"), 3, 60).collect()
    assert {(r.id, r["count"], r.allowed) for r in rows} == {(0, 1, True), (1, 2, True), (2, 3, True), (3, 4, False), (4, 1, True), (5, 2, True), (9, 1, True)}


def test_a_hot_caller_is_cut_into_slices(spark):
    import random

    rng = random.Random(4)
    calls = sorted(("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", NOON + dt.timedelta(seconds=rng.randrange(4000) // 7 * 3), i) for i in range(1500))
    want, state = {}, {}
    for key, at, i in calls:
        opened, count = state.get(key, (None, 0))
        if opened is None or at >= opened + dt.timedelta(seconds=60):
            opened, count = at, 0
        state[key] = opened, count + 1
        want[i] = count + 1
    frame = spark.createDataFrame(calls, "key string, at timestamp_ntz, id long")
    for slices in (1, 7, 40):
        assert {r.id: r["count"] for r in rate_limit(frame, 3, 60, slices).collect()} == want
    assert rate_limit(frame.where("false"), 3, 60).count() == 0


def test_stream_limit_equals_batch(spark, tmp_path):
    calls = [("k%d" % (i % 3), i * 7000, i) for i in range(60)]
    spark.createDataFrame(calls, "key string, at_ms long, id long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, at_ms long, id long").parquet(str(tmp_path / "in"))
    query = limit_requests(stream, 2, 60, expire=False).writeStream.format("memory").queryName("limited").trigger(availableNow=True).start()
    query.awaitTermination()
    streamed = {(r.id, r["count"], r.allowed) for r in spark.table("limited").collect()}
    batch = spark.createDataFrame([(k, NOON + dt.timedelta(milliseconds=m), i) for k, m, i in calls], "key string, at timestamp_ntz, id long")
    assert streamed == {(r.id, r["count"], r.allowed) for r in rate_limit(batch, 2, 60).collect()}


def test_token_filter_batch_and_stream(spark, tmp_path):
    said = [
        ("t", 1, "ai", "early"), ("t", 2, "tool", "x"), ("t", 3, "ai", "shown"), ("t", 4, "tool", "y"), ("t", 5, "ai", ""), ("t", 6, "ai", "too"), ("t", 7, "done", None),
        ("plain", 1, "ai", "a"), ("plain", 2, "ai", "b"), ("plain", 3, "done", None), ("silent", 1, "ai", "early"), ("silent", 2, "tool", "x"), ("silent", 3, "done", None),
    ]
    schema = "thread string, seq long, type string, content string"
    batch = stream_filter(spark.createDataFrame([s for s in said if s[2] != "done"], schema)).collect()
    want = {("t", "shown"), ("t", "too"), ("plain", "a"), ("plain", "b"), ("silent", FALLBACK)}
    assert {(r.thread, r.content) for r in batch} == want
    spark.createDataFrame(said, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = filter_tokens(stream).writeStream.format("memory").queryName("shown").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.thread, r.content) for r in spark.table("shown").collect()} == want


def test_history_is_clamped_and_scoped(spark):
    rows = [(i, "o%d" % (i % 2), "t", "user", str(i), NOON) for i in range(250)]
    messages = spark.createDataFrame(rows, "id long, owner string, thread_id string, role string, content string, created_at timestamp")
    got = history(messages, 500, "o1", "t").orderBy("place").collect()
    assert len(got) == 100 and got[0].id == 249 and {r.owner for r in got} == {"o1"}
    assert history(messages, 0, "o1", "t").count() == 1


def test_fail_open_logs():
    said = []
    fail_open(lambda batch, n: 1 / 0, said.append)(None, 7)
    assert len(said) == 1 and "batch 7" in said[0]


def test_files(spark, tmp_path):
    docs = tmp_path / "docs"
    (docs / "sub").mkdir(parents=True)
    (docs / "b.md").write_text("# B\n\nsecond text", encoding="utf-8")
    (docs / "sub" / "a.md").write_text("第一\n篇", encoding="utf-8")
    (docs / "skip.txt").write_text("no")
    read = files.read_markdown(spark, str(docs))
    assert [(r.doc_id, r.source, r.text) for r in read.orderBy("doc_id").collect()] == [(0, "b.md", "# B\n\nsecond text"), (1, "sub/a.md", "第一\n篇")]
    index = files.load_or_build_index(spark, read, str(tmp_path / "index"))
    assert {(r.source, r.section_path) for r in index.collect()} == {("b.md", "B"), ("sub/a.md", "")}
    assert files.load_or_build_index(spark, read.where("false"), str(tmp_path / "index")).count() == index.count()

    (tmp_path / "items.json").write_text(json.dumps([{"question": "q", "expected_sources": ["s"]}]))
    item = files.read_items(spark, str(tmp_path / "items.json")).first()
    assert (item.gold_sources, item.evidence_chunk_ids, item.evidence_coverage_mode) == (["s"], [], "any")
    for n, shape in enumerate((["a", {"question": "b"}], {"description": "d", "questions": ["a", "b"]})):
        (tmp_path / f"q{n}.json").write_text(json.dumps(shape))
        assert sorted(r.question for r in files.read_questions(spark, str(tmp_path / f"q{n}.json")).collect()) == ["a", "b"]

    (tmp_path / "log.jsonl").write_text('{"item_id":"x","n":1}\nbroken{\n{"item_id":"x","n":2}\n{"item_id":"y","n":3}\n')
    log = files.read_run_log(spark, str(tmp_path / "log.jsonl"), "item_id string, n int")
    assert {(r.item_id, r.n) for r in log.collect()} == {("x", 2), ("y", 3)}
    files.append_run_log(log, str(tmp_path / "more"))
    files.append_run_log(log, str(tmp_path / "more"))
    assert spark.read.json(str(tmp_path / "more")).count() == 4
    files.write_report(log, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2


@pytest.fixture
def warehouse(spark):
    spark.sql("DROP TABLE IF EXISTS talks")
    yield "talks"
    spark.sql("DROP TABLE IF EXISTS talks")


def test_conversation_table(spark, warehouse):
    files.ensure_conversations(spark, warehouse)
    files.ensure_conversations(spark, warehouse)
    row = (1, "o", "t", "user", "hi", NOON)
    files.append_conversations(spark.createDataFrame([row], files.CONVERSATION_SCHEMA), warehouse)
    assert spark.table(warehouse).select("id", "owner").collect() == [(1, "o")]


def test_scratch_tables_survive_and_can_be_removed(spark):
    from lorequarry.shared import materialize, remove_scratch

    kept = materialize(spark.range(5), "numbers")
    assert kept.count() == 5 and "numbers-" in kept.inputFiles()[0]
    remove_scratch(spark)
    with pytest.raises(Exception):
        spark.read.parquet(kept.inputFiles()[0])


def test_the_last_append_wins(spark, tmp_path):
    path = str(tmp_path / "runs")
    row = lambda n, size: spark.createDataFrame([("x", n, "y" * size)], "item_id string, n int, pad string")
    for n, size in ((1, 10), (2, 200_000), (3, 5), (4, 50_000), (5, 1)):
        files.append_run_log(row(n, size), path)
        assert files.read_run_log(spark, path, "item_id string, n int").first().n == n


def test_resumed_runs_know_whether_they_abstained(spark, tmp_path):
    lines = [
        {"item_id": "a", "answer": "yes", "judge": {"context_sufficient": True, "refusal_appropriate": False}},
        {"item_id": "b", "answer": "  ", "judge": None}, {"item_id": "c", "answer": "no", "judge": {"context_sufficient": False, "refusal_appropriate": True}},
        {"item_id": "d", "answer": "x", "generation_error": "timeout", "abstained": False},
    ]
    (tmp_path / "log.jsonl").write_text("\n".join(map(json.dumps, lines)))
    schema = "item_id string, answer string, generation_error string, judge struct<context_sufficient boolean, refusal_appropriate boolean>"
    runs = files.resume_runs(spark, str(tmp_path / "log.jsonl"), schema).collect()
    assert {r.item_id: r.abstained for r in runs} == {"a": False, "b": True, "c": True, "d": True}


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from lorequarry.shared import shared_dir

    def session(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master))

    assert shared_dir(session("spark://host:7077", "file:///shared/")) == "file:///shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session("local-cluster[3,2,1024]", None))
