"""Alike chunks are joined in rounds on the rare trigrams of each text, and none is lost."""

from __future__ import annotations

import random
from pathlib import Path

from lorequarry.operators import labels
from lorequarry.shared import scratch_path


def _grams(text: str) -> set[str]:
    bare = "".join(text.split())
    return {bare[i : i + 3] for i in range(len(bare) - 2)}


def _texts(rng: random.Random, n: int, length: int) -> list[tuple[str, str]]:
    letters = "abcdefghijklmnopqrstuvwxyz 的是了一不𝄞𝒳"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, length))) for _ in range(n)]
    for text in texts[:]:
        changed = list(text)
        for _ in range(len(text) // 60):
            changed[rng.randrange(len(changed))] = rng.choice(letters)
        texts.append("".join(changed)[: rng.randint(int(0.94 * len(text)), len(text))])
    return [(f"c{i:03d}", t) for i, t in enumerate(texts)]


def test_rounds_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(labels, "ROUND_ROWS", 5_000, raising=True)
    texts = _texts(random.Random(3), 60, 300)
    right = spark.createDataFrame(texts, "chunk_id string, text string")
    found = labels.similar_pairs(right.where("chunk_id < 'c040'"), right).collect()
    sets = {i: s for i, t in texts if (s := _grams(t))}
    want = {
        (a, b): len(x & y) / len(x | y) for a, x in sets.items() if a < "c040" for b, y in sets.items() if a != b and len(x & y) / len(x | y) >= 0.8
    }
    assert len(want) > 10
    assert {(r.a, r.b): r.similarity for r in found} == want


def test_what_is_kept_follows_the_texts(spark):
    """Before, all trigrams of all texts were written as strings and sent twice."""
    texts = _texts(random.Random(4), 300, 2_000)
    root = Path(scratch_path(spark, "none").removeprefix("file://")).parent
    size = lambda: sum(p.stat().st_size for p in root.rglob("*.parquet"))
    before, df = size(), spark.createDataFrame(texts, "chunk_id string, text string")
    labels.similar_pairs(df, df).collect()
    assert size() - before < 3 * sum(len(t.encode()) for _, t in texts)


def test_sources_are_read_without_texts(spark):
    """The sources of added chunks are looked up without sending a text; counts of the labels follow."""
    text = "an evidence text that is long enough to have many trigrams"
    chunks = spark.createDataFrame(
        [(1, "a", "s1", text), (2, "b", "s2", text + "s"), (3, "b", "s3", "later row"), (4, "c", "s4", "unlike all else")],
        "row_id long, chunk_id string, source string, page_content string",
    )
    items = spark.createDataFrame([(7, ["a"], ["s1"]), (8, ["c"], ["s4"])], "item_id long, evidence_chunk_ids array<string>, expected_sources array<string>")
    grown = labels.expand_gold(items, chunks)
    assert "min_by(struct" not in grown._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, grown.collect())) == [(7, ["a", "b"], 1, 1, True), (8, ["c"], 0, 0, False)]
    assert tuple(labels.label_stats(grown).first()) == (2, 1, 0.5, 1, 1)
