"""The scan is linear in the text, and density decides what of a page is content."""

from __future__ import annotations

import time

import pytest

from lorequarry.llm.markup import Scan, scan_any

HOSTILE = {
    "pre": "<pre> x ", "environment": "\\begin{equation} ", "comment": "<!-- ", "code": "<code> x ", "span": "`a ", "doctype": "<!DOCTYPE x ",
    "external": "[http://x", "underlined": " __a", "quotes": " ''a 'b ", "heading": "# a   ## ", "wiki heading": "== a     ", "item": "\\item [",
    "verbatim": "\\begin{verbatim} x ", "dollars": "$$ a $ ", "tags": "<div>x", "fields": "a b: ",
}


def seconds(text: str) -> float:
    began = time.process_time()
    scan_any(text)
    return time.process_time() - began


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_ten_times_the_text_takes_ten_times_as_long(name):
    piece = HOSTILE[name]
    small, large = ((piece * (n // len(piece) + 1))[:n] for n in (50_000, 500_000))
    assert seconds(large) < 30 * max(min(seconds(small), seconds(small)), 0.02)


@pytest.mark.parametrize("name", ["pre", "environment", "comment", "code"])
def test_four_million_characters(name):
    assert seconds((HOSTILE[name] * 800_000)[:4_000_000]) < 120


PROSE = "A long paragraph of real prose that says something of note. " * 6
FOOTER = "<footer><span>Copyright 2020</span><span>All rights reserved</span><span>Imprint</span></footer>"
SIDE = "<aside><div>Newest first</div><div>Tags</div><div>Archive</div></aside>"


def test_footer_and_side_block_are_dropped_and_the_article_is_kept():
    page = f"<html><body><article><h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p><ul><li>one</li><li>two</li></ul></article>{SIDE}{FOOTER}</body></html>"
    clean = Scan(page).text
    assert "Copyright" not in clean and "Archive" not in clean
    assert clean.count("real prose") == 12 and "# Title" in clean and "- one\n" in clean
    kept = Scan(f"<div><p>{PROSE}</p><p>{PROSE}</p></div><div><h2>Short</h2></div><div>see <code>x = 1</code></div>").text
    assert "## Short" in kept and "`x = 1`" in kept


def test_parts_of_a_line_stay_apart():
    assert Scan("<p><span>Copyright 2020</span><span>All rights</span> H<sub>2</sub>O</p>").text == "Copyright 2020 All rights H2O"


def test_blocks_end_at_the_first_sign_of_their_name():
    scan = Scan("<pre>a</pre><code>b</CODE> <pre><code>c\nd</code></pre> <pre>open")
    assert scan.kinds == {"html"} and scan.text.startswith("```\na\n```") and "`b`" in scan.text and "```\nc\nd\n```" in scan.text
    assert Scan("x <!-- a --> y <!-- open").text == "x  y  open"
    assert Scan("$$a$$ and $$ open").text == "$$ a $$ and $$ open"
    assert Scan("say __this one__ and a__b__c __open").text == "say this one and a__b__c __open"
