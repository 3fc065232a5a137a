"""Draws of many numbers at once are those of the portable hash."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from lorequarry.operators import metrics as mt
from lorequarry.operators.draws import digit_blocks, md5_heads


@pytest.mark.parametrize("prefix", [b"42:0:", b"42:1999:", b"-7:12:", b"123456789012345678:1:"])
def test_heads_are_those_of_md5(prefix):
    got = np.concatenate([md5_heads(prefix, digits) for digits, _ in digit_blocks(20_001)])
    assert got.tolist() == [int(hashlib.md5(prefix + str(i).encode()).hexdigest()[:8], 16) for i in range(20_001)]


def test_means_shuffle_nothing_and_agree_with_the_general_way(spark):
    values = spark.range(1_203).selectExpr("id as key", "(id * 37 % 101) / 7 as v")
    means = mt._resampled_means(values, 40, 42)
    assert "Exchange" not in means._jdf.queryExecution().executedPlan().toString()
    general = mt._resampled_means(values, 40, 42, lambda v, times: mt.weighted_mean(v, times))
    of = lambda df: {r.rep: pytest.approx(r["mean"], abs=1e-11) for r in df.collect()}
    assert of(means) == {r.rep: r["mean"] for r in general.collect()}
