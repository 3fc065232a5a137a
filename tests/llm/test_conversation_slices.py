"""A thread with all its rows on one day is cut into slices of bounded size, and judged as before."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lorequarry.llm.conversations import MESSAGE_SCHEMA, Replay, dropped_threads, sound_turns


def test_one_day_of_one_thread_is_sliced(spark, tmp_path):
    start, n = dt.datetime(2024, 5, 1), 600
    at = lambda i: start + dt.timedelta(seconds=i // 7)
    said = ("user", "assistant")
    rows = [(i, "o", "hot", said[i % 2], f"m{i}", at(i)) for i in range(n)]
    rows += [(n + i, "o", "hot", said[i % 2], f"m{i}", at(i)) for i in range(0, n, 5)]  # delivered again
    rows += [(5000 + i, "o", "twice", said[i % 2] if i != 301 else "user", f"m{i}", at(i)) for i in range(n)]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, MESSAGE_SCHEMA).write.parquet(path)
    sizes = Replay(spark, path, slices=8).sliced().groupBy("owner", "thread_id", "slice").agg(F.count(F.lit(1)).alias("n")).collect()
    assert sum(r.n for r in sizes) == 2 * n and max(r.n for r in sizes) < n / 2
    for slices in (1, 8, 97):
        # two users in a row leave two assistants apart
        assert [(r.thread_id, r.defect) for r in dropped_threads(spark, path, slices).collect()] == [("twice", "no_reply")]
        turns = sound_turns(spark, path, slices).orderBy("turn").collect()
        assert [(r.thread_id, r.turn, r.id, r.role) for r in turns] == [("hot", i, i, said[i % 2]) for i in range(n)]
