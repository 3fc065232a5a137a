"""Quotes of every kind are held on the stack; keys of records have no bound."""

from __future__ import annotations

import time

import pytest

from lorequarry.llm.dressed import dressed_copies, is_record, same_content
from lorequarry.llm.truncation import examine


@pytest.mark.parametrize(
    "text, cut",
    [
        ('She answered "go now.', True), ('She answered "go now."', False), ("Il dit « bonjour.", True), ("Il dit « bonjour ».", False),
        ("Er sagt „so ist es“ und geht.", False), ("Er sagt „so ist es.", True), ("»Ja« sagt er.", False), ('A 5" pipe and a 7" pipe.', False),
        ('He said "take the 5" pipe.', False), ('First "one.\n\nThen the end.', False),
    ],
)
def test_open_quotes(text, cut):
    assert (examine(text).reason is not None) == cut


def test_long_keys_are_keys(spark):
    key, other = "very long name of a field " * 6 + "one", "very long name of a field " * 6 + "two"
    assert is_record(f"{key}: 1\n{other}: 2") and same_content(f"{key}: 1\n{other}: 2", f"{other}=2; {key}=1")
    rows = [(1, f"{key}: 1\n{other}: 2"), (2, f"{other}: 2\n{key}: 1"), (3, "http://a.b\nhttp://c.d"), (4, "http://c.d\nhttp://a.b")]
    found = dressed_copies(spark.createDataFrame(rows, "row_id long, page_content string")).collect()
    assert [tuple(r) for r in found] == [(1, 2)]


def test_records_are_told_in_linear_time():
    began = time.process_time()
    for piece in ("a ", "a b", "  ", "'", "-", "a: ", "a:  ,", "a. "):
        is_record((piece * 300_000) + "\n" + piece * 300_000)
    assert time.process_time() - began < 30
