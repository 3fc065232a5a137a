"""The full bootstrap queries draw the 2,000 repetitions of the reference."""

from __future__ import annotations

import hashlib

import pytest

from lorequarry.operators import metrics as mt
from lorequarry.plans import evaluation, registry


def test_full_interval_is_that_of_2000_draws(spark, monkeypatch):
    own = [0.0, 0.25, 0.5, 1.0, 0.0, 1.0, 0.75]
    values = spark.createDataFrame(list(enumerate(own)), "key long, v double")
    monkeypatch.setattr(evaluation, "_values", lambda *_: values)
    got = registry.queries()["bootstrap_ci_full"](spark, "")
    draw = lambda r, i: own[int(hashlib.md5(f"42:{r}:{i}".encode()).hexdigest()[:8], 16) % len(own)]
    means = sorted(sum(draw(r, i) for i in range(len(own))) / len(own) for r in range(2000))
    assert tuple(got.first()) == (pytest.approx(means[50], abs=1e-8), pytest.approx(means[1950], abs=1e-8))


def test_full_paired_query_draws_2000(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(evaluation, "_paired", lambda *_: spark.createDataFrame([(0, 1.0, 0.0)], "query_id long, a double, b double"))
    monkeypatch.setattr(mt, "paired_bootstrap", lambda pairs, reps: seen.append(reps))
    registry.queries()["paired_bootstrap_full"](spark, "")
    assert seen == [2000]
