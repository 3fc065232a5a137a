"""Texts cut off by a field limit or a broken transfer (problem 10).

Method: a structural completeness check with a stack automaton, and missing
terminators judged against the baseline of each source.  The automaton reads a
text once and keeps a stack of what is open: fenced blocks, comments, tags,
environments, brackets and quotes.  Lines that exporters put under a text
(signatures, page marks, tag lists, links, rules) are set aside first; they do
not make a cut text whole.  What is left must end in nothing open, no broken
character or escape, and a terminator, unless its own block or its source goes
without terminators.

Whole texts are read, in one Arrow pass whose narrow result is written once; the
baselines are counts over all texts, aggregated map-side to one row a source.
Only texts whose one fault is a missing terminator look the baseline up.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lorequarry.shared import materialize

_CLOSERS = "\"'”’»」』）)］】〉》*_`~>]}"
_TERMINATORS = ".!?。！？｡؟।"
_TRAILING = " \t\r\n\f\v\x00​‌‍⁠﻿　 "
_FENCE = re.compile(r"[ \t]{0,3}(```|~~~)")
_ELLIPSIS = re.compile(r"(?:…|\.\.\.|\[(?:…|\.\.\.)\])$")
_BROKEN = re.compile(r"(?:�|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|\\|&#?[A-Za-z0-9]{1,8}|%[0-9A-Fa-f]?|[\ud800-\udfff])$")
_TABLE = re.compile(r"\s*\|")
_LIST = re.compile(r"\s*(?:[-*+•]|\d{1,4}[.)]|>)\s+")
_HEADING = re.compile(r"\s*(?:#{1,6}\s+\S|={2,6}[^=]+={2,6}\s*$)")
_UNDERLINE = re.compile(r"\s*(?:={3,}|-{3,})\s*$")
_URL = re.compile(r"\s*<?(?:https?|ftp)://\S+>?\s*$")
_SIGNATURE = re.compile(r"\s*(?:--|—|–)\s?\S.{0,80}$")
_ASIDE = re.compile(r"\s*(?:\([^()]{1,120}\)|\[[^\[\]]{1,120}\]|\[\s*\d+\s*/\s*\d+\s*\][^.!?。！？]{0,80}[.。]?|\*\*\*.{0,60}\*\*\*)\s*$")
_LABELS = re.compile(r"\s*[^\W\d][\w \-'’]{0,24}\s?[:：]\s*[\w./#@+-]+(?:\s?[,，、;|]\s?[\w./#@+-]+)*\s*$")
_COUNTER = re.compile(r"\s*[^\W\d_]{1,12}\.?\s*\d{1,6}\s*(?:[/|]|[^\W\d_]{1,6})\s*\d{1,6}\s*[.]?$")
_RULE = re.compile(r"\s*(?:[-*_=]\s*){3,}$")
_SHORT_MARK = re.compile(r"\s*\S.{0,48}\d{2,4}\s*[.。]?\s*$")

_TOKEN = re.compile(
    r"(?P<open_comment><!--)|(?P<close_comment>-->)"
    r"|\\begin\{(?P<begin>[\w*]+)\}|\\end\{(?P<end>[\w*]+)\}"
    r"|<(?P<tag>div|table|ul|ol|pre|code|details|section|article|blockquote|script|style|math)\b[^<>]*>"
    r"|</(?P<close>div|table|ul|ol|pre|code|details|section|article|blockquote|script|style|math)\s*>"
    r"|(?P<half><[A-Za-z/][^<>\n]*\Z)"
    r"|(?P<table>^\{\|)|(?P<table_end>^\|\})|(?P<template>\{\{)|(?P<template_end>\}\})"
    r"|(?P<dollars>\$\$)",
    re.MULTILINE,
)
_PAIRS = {")": "(", "]": "[", "}": "{", "）": "（", "】": "【", "」": "「", "』": "『", "》": "《", "”": "“"}
#: Quotes that open and close alike, or either way round by language; those of one value are a pair.
_EITHER_WAY = {"«": "«", "»": "«", '"': '"'}
_BRACKET = re.compile(r"[()\[\]{}（）【】「」『』《》“”„`«»]|(?<![\d\\])\"|(?<=\d)\"(?=[\s.,;:!?)]|$)")


class Ending(NamedTuple):
    """Why a text looks cut (None if whole; ``no_terminator`` waits for the baseline), and its inner paragraphs."""

    reason: str | None
    paragraphs: int
    terminated: int


def ends_sentence(line: str) -> bool:
    bare = line.rstrip(_TRAILING).rstrip(_CLOSERS + _TRAILING)
    return bare.endswith(tuple(_TERMINATORS))


def _is_footer(line: str) -> bool:
    if not any(c.isalnum() for c in line):
        return not _FENCE.match(line) and not _TABLE.match(line) and not line.strip().startswith(("<!--", "-->", "|}"))
    return bool(_URL.match(line) or _SIGNATURE.match(line) or _ASIDE.match(line) or _LABELS.match(line) or _COUNTER.match(line))


def without_footers(lines: list[str]) -> list[str]:
    """The lines without what stands under the text; never all of them."""
    end = len(lines)
    while end > 1:
        line = lines[end - 1]
        if not line.strip():
            end -= 1
        elif _is_footer(line):
            end -= 1
        elif end > 2 and _SHORT_MARK.match(line) and _RULE.match(lines[end - 2]):
            end -= 2
        else:
            break
    kept = lines[:end]
    return kept if any(any(c.isalnum() for c in x) for x in kept) else lines


def open_block(body: str) -> str | None:
    """What the automaton still holds open at the end of the text: blocks only."""
    stack, held = [], Counter()
    prose, fence = [], None
    for line in body.split("\n"):
        mark = _FENCE.match(line)
        if mark and (fence is None or fence == mark[1]):
            fence = mark[1] if fence is None else None
        elif fence is None:
            prose.append(line)
    if fence:
        return "fence"
    text = "\n".join(prose)
    if "<" not in text and "\\" not in text and "{" not in text and "$$" not in text:
        return None
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if stack and stack[-1] == "comment" and kind != "close_comment":
            continue
        if kind == "half":
            return "tag"
        if kind == "dollars":
            _close(stack, held, kind) if stack and stack[-1] == kind else _open(stack, held, kind)
        elif kind in ("open_comment", "begin", "tag", "table", "template"):
            names = {"open_comment": "comment", "begin": f"env:{m['begin']}", "tag": f"tag:{m['tag']}"}
            _open(stack, held, names.get(kind, kind))
        else:
            opener = {
                "close_comment": "comment", "end": f"env:{m['end']}", "close": f"tag:{m['close']}",
                "table_end": "table", "template_end": "template",
            }[kind]
            _close(stack, held, opener)
    return stack[-1].partition(":")[0] if stack else None


def _open(stack: list[str], held: Counter, what: str) -> None:
    stack.append(what)
    held[what] += 1


def _close(stack: list[str], held: Counter, what: str) -> None:
    """Close the last ``what`` with all that was opened after it; nothing where none is open."""
    while held[what]:
        top = stack.pop()
        held[top] -= 1
        if top == what:
            return


def open_bracket(paragraph: str) -> bool:
    """Whether a bracket or quote of the paragraph is open at its end."""
    stack, held = [], Counter()
    for m in _BRACKET.finditer(paragraph):
        c = m[0]
        in_code = bool(stack) and stack[-1] == "`"
        if c == "`" and in_code:
            _close(stack, held, c)
        elif in_code:
            continue
        elif (either := _EITHER_WAY.get(c)) is not None:
            if held[either]:
                _close(stack, held, either)
            elif c != '"' or m.start() == 0 or not paragraph[m.start() - 1].isdigit():  # no inches
                _open(stack, held, either)
        elif c == "“" and held["„"]:
            _close(stack, held, "„")
        elif c in _PAIRS:
            _close(stack, held, _PAIRS[c])
        else:
            _open(stack, held, c)
    return bool(stack)


def _kind(line: str) -> str:
    if _TABLE.match(line):
        return "table"
    if _LIST.match(line):
        return "list"
    return "prose"


def _blocks(lines: list[str]) -> list[list[str]]:
    """Runs of lines outside fences, parted by blank lines, headings and fences."""
    blocks, block, fence = [], [], None
    for line in lines:
        mark = _FENCE.match(line)
        if mark and (fence is None or fence == mark[1]):
            fence = mark[1] if fence is None else None
        if mark or fence or not line.strip() or _HEADING.match(line) or _UNDERLINE.match(line):
            if block:
                blocks.append(block)
                block = []
        else:
            if block and _kind(block[-1]) != _kind(line):
                blocks.append(block)
                block = []
            block.append(line)
    if block:
        blocks.append(block)
    return blocks


def examine(text: str) -> Ending:
    """Judge one text that is not blank."""
    body = text.rstrip(_TRAILING)
    lines = without_footers(body.split("\n"))
    body = "\n".join(lines).rstrip(_TRAILING)
    blocks = _blocks(lines)
    inner = [b for b in blocks[:-1] if _kind(b[-1]) != "table" and not _is_footer(b[-1])]
    seen = Ending(None, len(inner), sum(ends_sentence(b[-1]) for b in inner))
    last = lines[-1]
    if _BROKEN.search(body):
        return seen._replace(reason="broken_character")
    if still := open_block(body):
        return seen._replace(reason=f"open_{still}")
    if _FENCE.match(last) or _HEADING.match(last) or _UNDERLINE.match(last) or not blocks:
        return seen
    block = blocks[-1]
    if _kind(last) == "table":
        cells = [x.count("|") for x in block]
        cut = not last.rstrip().endswith("|") and len(block) > 1 and block[0].rstrip().endswith("|")
        cut = cut or len(block) > 1 and cells[-1] < cells[0]
        return seen._replace(reason="open_row" if cut else None)
    if _ELLIPSIS.search(body):
        return seen._replace(reason="ellipsis")
    if open_bracket("\n".join(block)):
        return seen._replace(reason="open_bracket")
    if ends_sentence(last):
        return seen
    siblings = block[:-1]
    if last.rstrip().endswith((",", ";", "，", "、", "；", "-", "–", "—")):
        return seen._replace(reason="mid_sentence")
    if siblings and sum(map(ends_sentence, siblings)) * 2 < len(siblings):
        return seen  # lines of this block go without terminators
    if not any(c.isalnum() for c in last[-3:]) and not last.rstrip().endswith((":", "：")):
        return seen  # ends in a mark of its own, such as an emoji
    return seen._replace(reason="no_terminator")


def examine_documents(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, reason, paragraphs, terminated)`` of every text that is not null or blank."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [examine(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array([e.reason for e in seen], pa.string()),
                    pa.array([e.paragraphs for e in seen], pa.int64()),
                    pa.array([e.terminated for e in seen], pa.int64()),
                ],
                names=["doc_id", "source", "reason", "paragraphs", "terminated"],
            )

    texts = documents.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text")
    )
    return texts.where(F.col("text").rlike(r"[^\s\p{Z}\p{C}]")).mapInArrow(
        look, "doc_id long, source string, reason string, paragraphs long, terminated long"
    )


def truncated_documents(
    documents: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", baseline: float = 0.5
) -> DataFrame:
    """``(doc_id, source, reason, cut)``: every text that is not blank, and whether it was cut.

    A missing terminator counts only where at least ``baseline`` of the inner
    paragraphs of the source end with one; a source without inner paragraphs is
    judged like the whole table.  A null source is a source of its own.  Null and
    blank texts are left out; repeated rows are judged each on their own.
    """
    seen = materialize(examine_documents(documents, text_col, id_col, source_col), "endings")
    rates = seen.groupBy("source").agg(F.sum("paragraphs").alias("p"), F.sum("terminated").alias("t"))
    overall = rates.agg((F.sum("t") / F.sum("p")).alias("overall"))  # one row
    strict = rates.crossJoin(F.broadcast(overall)).select(
        F.col("source").alias("of"),
        (F.coalesce(F.col("t") / F.when(F.col("p") > 0, F.col("p")), "overall", F.lit(1.0)) >= baseline).alias("strict"),
    )
    asked = seen.where("reason = 'no_terminator'").join(strict, seen["source"].eqNullSafe(strict["of"]))
    sure = seen.where("reason is null or reason <> 'no_terminator'")
    return sure.select("doc_id", "source", "reason", F.col("reason").isNotNull().alias("cut")).unionByName(
        asked.select("doc_id", "source", "reason", F.col("strict").alias("cut"))
    )


def truncation_report(judged: DataFrame) -> DataFrame:
    """``(source, texts, cut_texts, share)``: how often each source truncates."""
    return judged.groupBy("source").agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if("cut").alias("cut_texts"),
        (F.count_if("cut") / F.count(F.lit(1))).alias("share"),
    )
