from __future__ import annotations

import datetime as dt
import random

from lorequarry.operators.references import contiguous_runs, match_runs, orphan_references, orphan_report

DAY = dt.datetime(2024, 5, 1)
ITEMS = "item_id long, evidence_chunk_ids array<string>, gold_chunk_ids array<string>, created_at timestamp_ntz, reason string"
CHUNKS = "chunk_id string, indexed_at timestamp_ntz, deleted_at timestamp_ntz, item_id long"


def day(n):
    return DAY + dt.timedelta(days=n)


def found(spark, items, chunks):
    rows = orphan_references(spark.createDataFrame(items, ITEMS), spark.createDataFrame(chunks, CHUNKS)).collect()
    return {(r.item_id, r.field_name, r.chunk_id, r.reason) for r in rows}


def test_reasons_spelling_and_repeats(spark):
    a, b, c, d = (x * 16 for x in "abcd")
    chunks = [
        (a, day(0), None, 1), (a, day(0), None, 2),          # delivered again
        (b, day(0), day(2), 1), (b, day(5), None, 1),        # deleted, then indexed again
        (c, day(9), None, 1),
        ("odd-name", day(0), None, 1),
        (None, day(0), None, 1), (d, None, None, 1),
    ]
    items = [
        (1, [a.upper(), f" {a}　", None, "", "  ", b], [b, c, "e" * 16, "odd-name", "other"], day(3), "x"),
        (1, [a.upper(), f" {a}　", None, "", "  ", b], [b, c, "e" * 16, "odd-name", "other"], day(3), "x"),
        (2, [b], [b, d], day(2), "x"),   # deleted at that very time
        (3, None, [], day(3), "x"),
        (4, [b, c], None, day(1), "x"),
        (5, [b, c], None, None, "x"),    # no time: judged at the end of time
    ]
    ev, gold = "evidence_chunk_ids", "gold_chunk_ids"
    assert found(spark, items, chunks) == {
        (1, ev, b, "deleted"), (1, gold, b, "deleted"), (1, gold, c, "late"), (1, gold, "e" * 16, "missing"), (1, gold, "other", "missing"),
        (2, ev, b, "deleted"), (2, gold, b, "deleted"), (2, gold, d, "late"), (4, ev, c, "late"),
    }


def test_empty_tables(spark):
    assert found(spark, [], []) == set()
    assert found(spark, [(1, ["a" * 16], None, day(0), "x")], []) == {(1, "evidence_chunk_ids", "a" * 16, "missing")}
    assert found(spark, [], [("a" * 16, day(0), None, 1)]) == set()


def test_runs_compress_and_match(spark):
    keys = [*range(10, 30), 5, 31, 2**63 - 1, -(2**63), 12, 12]
    parents = spark.createDataFrame([(k,) for k in keys] + [(None,)], "key long")
    runs = contiguous_runs(parents, 1)
    assert {(r.run_start, r.run_end) for r in runs.collect()} == {(5, 5), (10, 29), (31, 31), (2**63 - 1, 2**63 - 1), (-(2**63), -(2**63))}
    rng = random.Random(3)
    probes = [rng.randrange(-5, 60) for _ in range(200)] + [2**63 - 1, -(2**63), 2**63 - 2]
    matched = match_runs(spark.createDataFrame([(p,) for p in probes], "key long"), parents, 7).collect()
    assert {r.key: r.known for r in matched} == {p: p in keys for p in probes}


def test_hot_key_and_report(spark):
    hot = "f" * 16
    chunks = [(hot, day(n), day(n + 1), n) for n in range(0, 200, 2)]
    items = [(n, [hot] * 3, [hot], day(n) + dt.timedelta(hours=1), "x") for n in range(200)]
    rows = found(spark, items, chunks)
    assert rows == {(n, f, hot, "deleted") for n in range(1, 200, 2) for f in ("evidence_chunk_ids", "gold_chunk_ids")}
    orphans = orphan_references(spark.createDataFrame(items, ITEMS), spark.createDataFrame(chunks, CHUNKS))
    report = orphan_report(orphans).collect()
    assert sum(r.references for r in report) == 200 and {r.reason for r in report} == {"deleted"}


def test_an_outlier_leaves_the_keys_spread(spark):
    parents = spark.range(100_000).unionAll(spark.createDataFrame([(2**62,)], "id long")).withColumnRenamed("id", "key")
    runs = contiguous_runs(parents, 16).collect()
    sizes = {}
    for r in runs:
        sizes[r.slice] = sizes.get(r.slice, 0) + r.run_end - r.run_start + 1
    assert len(sizes) > 8 and max(sizes.values()) < 20_000 and sum(sizes.values()) == 100_001


def test_a_hot_key_is_judged_over_slices(spark):
    hot = "f" * 16
    chunks = [(hot, day(n), day(n + 1), n) for n in range(0, 60, 2)]
    items = [(n * 10 + i, [hot], None, day(n) + dt.timedelta(hours=1), "x") for n in range(60) for i in range(5)]
    frame = orphan_references(spark.createDataFrame(items, ITEMS), spark.createDataFrame(chunks, CHUNKS), slices=13)
    assert {r.item_id for r in frame.collect()} == {n * 10 + i for n in range(1, 60, 2) for i in range(5)}
