"""Conversations in three batches: late messages within and beyond the watermark, closure by timeout and by the end of the stream."""

from __future__ import annotations

import datetime as dt

from lorequarry.llm.conversations import MESSAGE_SCHEMA, Replay, dropped_threads, sound_turns

START = dt.datetime(2024, 5, 1)


def day(n: float) -> dt.datetime:
    return START + dt.timedelta(days=n)


def verdicts(run):
    return {(r.thread_id, r.defect) for r in run.threads().collect()}


def add(spark, folder, rows):
    spark.createDataFrame(rows, MESSAGE_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_three_batches(spark, tmp_path):
    folder, place = str(tmp_path / "in"), f"file://{tmp_path}/place"
    run = lambda final: Replay(spark, folder, place, slices=3, lateness="3 days", idle="10 days", final=final)
    add(spark, folder, [(1, "o", "a", "user", "q", day(0)), (2, "o", "b", "user", "q", day(0)), (3, "o", "c", "user", "q", day(0)), (4, "o", "d", "user", "q", day(5)), (5, "o", "e", "user", "x", None)])
    first = run(False)
    assert verdicts(first) == {("e", "broken")} and first.late_messages().first().late == 0
    # a's reply is late within the watermark, b's beyond it (newest seen: day 5)
    add(spark, folder, [(6, "o", "a", "assistant", "r", day(2.5)), (7, "o", "b", "assistant", "r", day(0.1)), (8, "o", "d", "assistant", "r", day(30))])
    second = run(False)
    assert second.late_messages().first().late == 1
    # a second message of c after its conversation was closed by timeout
    add(spark, folder, [(9, "o", "c", "assistant", "r", day(40)), (10, "o", "f", "user", "q", day(60))])
    third = run(False)
    assert ("b", "no_reply") in verdicts(third) and ("a", None) in verdicts(third) and "f" not in {t for t, _ in verdicts(third)}
    last = run(True)
    assert verdicts(last) == {("a", None), ("b", "no_reply"), ("c", None), ("d", None), ("e", "broken"), ("f", "no_reply")}


def test_files_one_by_one_end_last(spark, tmp_path):
    folder = str(tmp_path / "in")
    for n in range(3):
        add(spark, folder, [(2 * n, "o", "t", "user", f"q{n}", day(n)), (2 * n + 1, "o", "t", "assistant", f"r{n}", day(n + 0.1))])
    run = Replay(spark, folder, files_each=1, slices=2)
    assert verdicts(run) == {("t", None)} and run.parts().agg({"turns": "sum"}).first()[0] == 6 and run.late == 0


def test_far_times_are_times(spark, tmp_path):
    far = lambda y: dt.datetime(y, 6, 1)
    rows = [(1, "o", "alone", "user", "q", far(9999)), (2, "o", "pair", "user", "q", far(9000)), (3, "o", "pair", "ai", "r", far(9500)), (4, "o", "old", "user", "q", far(1970))]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, MESSAGE_SCHEMA).coalesce(1).write.parquet(path)
    assert {(r.thread_id, r.defect) for r in dropped_threads(spark, path).collect()} == {("alone", "no_reply"), ("old", "no_reply")}
    assert [(r.turn, r.id) for r in sound_turns(spark, path).orderBy("turn").collect()] == [(0, 2), (1, 3)]


def test_a_file_is_read_without_its_neighbours(spark, tmp_path):
    import pathlib
    import shutil

    add(spark, str(tmp_path / "made"), [(1, "o", "t", "user", "q", day(0))])
    part = next(pathlib.Path(tmp_path / "made").glob("part-*.parquet"))
    for name in ("conversations.parquet", "conversations.parquet.old", "conversations.parquet2"):
        shutil.copy(part, tmp_path / name)
    add(spark, str(tmp_path / "other.parquet"), [(2, "o", "u", "user", "q", day(0))])
    assert [r.thread_id for r in dropped_threads(spark, str(tmp_path / "conversations.parquet")).collect()] == ["t"]
