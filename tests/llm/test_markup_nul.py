"""A text with NUL or any other mark character is read like all others."""

from __future__ import annotations

import pytest

from lorequarry.llm.markup import clean_markup, scan_any


@pytest.mark.parametrize("odd", ["\x00", "\x000\x00", "﷐\x00", "".join(map(chr, [0, *range(0xFDD0, 0xFDF0)])), "\U000f0000\x00"])
def test_odd_characters_hide_no_markup(odd):
    scan, plain = scan_any(f"# Title\n\n`a_b` <b>bold</b> {odd} [[Page|shown]] end"), scan_any("# Title\n\n`a_b` <b>bold</b> ODD [[Page|shown]] end")
    assert scan.kinds == plain.kinds == {"markdown", "html", "wiki"}
    assert scan.text == plain.text.replace("ODD", odd)


def test_rows_with_nul_are_found(spark):
    rows = spark.createDataFrame([(1, "\x00 <b>x</b>")], "row_id long, page_content string")
    assert [(r.markups, r.clean_text) for r in clean_markup(rows).collect()] == [(["html"], "\x00 x")]
