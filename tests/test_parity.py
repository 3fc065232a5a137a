"""Every core query that SQL can express agrees with it."""

from __future__ import annotations

import pytest
from parity import compare

from lorequarry.plans import registry

FOLDER = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, name):
    compare(spark, FOLDER, registry.queries()[name], SQL[name])


def test_entry_has_every_query(spark):
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "chunk_id", "score", "rank"]
