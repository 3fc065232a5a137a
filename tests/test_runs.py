"""Judged runs with injected models, generated questions, memory of a conversation, and smaller parts."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lorequarry.functions.text import known_key, normalize_text
from lorequarry.operators import chunking as ck, metrics as mt, models as md
from lorequarry.operators.judged import pending
from lorequarry.sources import files
from lorequarry.streaming.serving import conversation_memory

GOOD = json.dumps({"context_sufficient": True, "faithful": "yes", "relevant": 1, "refusal_appropriate": False, "unsupported_claims": [], "reason": "fine"})


ITEMS = [("a", "answerable", "q", "src\nthe answer"), ("b", "negative", "q", " "), ("c", "answerable", "odd", "src\nx"), ("d", "answerable", "down", "src\ny")]


def test_runs_are_judged_logged_and_resumed(spark, tmp_path):
    good = GOOD

    def verdict(question, context, answer):
        if question == "odd":
            return "no json"
        if question == "down":
            raise TimeoutError("slow")
        return f"```json\n{good}\n```"

    items = spark.createDataFrame(ITEMS, "item_id string, kind string, question string, context string")
    made = {r.item_id: r for r in md.run_items(items, md.first_sentence, verdict, attempts=2, wait=0.0).collect()}
    assert made["a"].judge.faithful and made["a"].judge.source == "model" and made["a"].judge_error is None and not made["a"].abstained
    assert made["b"].judge.source == "rule" and made["b"].abstained and made["b"].answer == md.NO_CONTEXT_ANSWER
    assert made["c"].judge is None and made["c"].judge_error == "the verdict cannot be read"
    assert made["d"].judge is None and made["d"].judge_error == "TimeoutError: slow"
    path = str(tmp_path / "log")
    files.append_run_log(md.run_items(items.where("item_id < 'c'"), md.first_sentence, verdict, wait=0.0), path)
    done = files.resume_runs(spark, path, "item_id string, answer string, generation_error string, judge struct<context_sufficient boolean, refusal_appropriate boolean>")
    assert {r.item_id: r.abstained for r in done.collect()} == {"a": False, "b": True}
    assert {r.item_id for r in pending(items, done).collect()} == {"c", "d"}


def test_questions_of_the_longest_chunks(spark):
    rows = [(1, "s", 0, "c1", "long text " * 5), (2, "s", 1, "c2", "longer text " * 9), (3, "s", 2, "c3", "short"), (4, "t", 0, "c4", "alone")]
    chunks = spark.createDataFrame(rows, "row_id long, source string, chunk_index int, chunk_id string, page_content string")
    said = [{"question": " What? ", "evidence": [1, 0, 1, 7]}, {"question": "", "evidence": [0]}, {"question": "None?", "evidence": []}]
    made = md.generated_questions(chunks, lambda shown: json.dumps(said) if "[0]" in shown else "", wait=0.0).collect()
    assert [(r.source, r.question, r.evidence_chunk_ids) for r in made] == [("s", "What?", ["c2", "c1"])]


def test_memory_keeps_the_last_messages_of_a_thread(spark, tmp_path):
    rows = [("p:t", n, "user" if n % 2 else "ai", f"m{n}") for n in range(6)] + [("q:t", 9, "user", "other")]
    schema = "thread string, seq long, role string, content string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = conversation_memory(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), keep=3)
    stream.writeStream.format("memory").queryName("memory").trigger(availableNow=True).start().awaitTermination()
    seen = {(r.thread, r.seq): [m.content for m in r.history] for r in spark.table("memory").collect()}
    assert seen["p:t", 5] == ["m3", "m4", "m5"] and seen["p:t", 1] == ["m0", "m1"] and seen["q:t", 9] == ["other"]


def test_offsets_of_normalised_text(spark):
    for raw in ("  a  b\n\nc ", "", "   ", "x", "a　b"):
        body, offsets = ck.mapped_text(raw)
        assert body == spark.range(1).select(normalize_text(F.lit(raw))).first()[0] and len(body) == len(offsets)
        assert all(raw[o] == c or c == " " for c, o in zip(body, offsets))


def test_keys_and_statistics(spark):
    keys = spark.createDataFrame([("k1",), ("K1",), ("",), (None,), ("k2",)], "k string")
    assert [r[0] for r in keys.select(known_key(F.col("k"), ["k1", "k2", ""])).collect()] == [True, False, False, False, True]
    values = spark.createDataFrame([(i, float(i)) for i in range(40)], "key long, v double")
    top = mt.bootstrap_interval(values, 50, statistic=lambda v, times: F.max(v)).first()
    mean = mt.bootstrap_interval(values, 50).first()
    assert top.high == 39.0 and top.low > mean.high and mean.low < 19.5 < mean.high
    with pytest.raises(Exception):
        md.generated_questions(values, lambda s: s)
