"""Oversized texts cut into overlapping pieces at natural boundaries (problem 5).

Method: structure-tree packing.  A text is a tree of spans: sections by heading
level, blocks (a fenced block is one), lines and list items, sentences, clauses,
words, characters.  A node that fits is a leaf; only an oversized node is opened,
and the parts of its children are merged bottom-up while they fit.  Rows that fit
as they are never leave the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_FENCE = re.compile(r"^[ \t]{0,3}(```|~~~)")
_HEADING = re.compile(r"^(#{1,6})\s|^(={1,6})[^=\n].*\2\s*$|^\\(?:sub)*section\*?\{|^<h([1-6])\b", re.IGNORECASE)
_SENTENCE = re.compile(r"(?<![.!?])[.!?]+[\"'”’)\]]*\s+|[。！？]+[”’」』）]*\s*")
_CLAUSE = re.compile(r"[,;:.!?](?=\s)\s*|[，；：、]")
_WORD = re.compile(r"[\s.,;:!?。，；：！？、]+")
_LINE = re.compile(r"\n+")

Span = tuple[int, int]


def _between(text: str, span: Span, pattern: re.Pattern) -> list[Span]:
    """The span cut after every match of ``pattern``."""
    begin, end = span
    cuts = [m.end() for m in pattern.finditer(text, begin, end) if begin < m.end() < end]
    edges = [begin, *cuts, end]
    return list(zip(edges, edges[1:]))


def _lines(text: str, span: Span) -> Iterator[tuple[int, int, str, bool]]:
    """Start, end, line and whether it stands in a fenced block (its fences included)."""
    at, fence = span[0], None
    for line in text[span[0] : span[1]].splitlines(keepends=True):
        mark = _FENCE.match(line)
        inside = fence is not None or mark is not None
        if mark:
            fence = None if fence == mark[1] else fence or mark[1]
        yield at, at + len(line), line, inside
        at += len(line)


def _heading_level(line: str) -> int:
    m = _HEADING.match(line)
    if not m:
        return 0
    if m[1] or m[2]:
        return len(m[1] or m[2])
    return int(m[3]) if m[3] else 1 + line.lower().count("sub")


def _sections(text: str, span: Span) -> list[Span]:
    """Children by the highest heading level in the span (the span itself may start with it)."""
    heads = [(a, _heading_level(line)) for a, _, line, fenced in _lines(text, span) if not fenced and _heading_level(line)]
    inner = [(a, level) for a, level in heads if a > span[0]]
    if not inner:
        return [span]
    top = min(level for _, level in inner)
    edges = [span[0], *(a for a, level in inner if level == top), span[1]]
    return list(zip(edges, edges[1:]))


def _blocks(text: str, span: Span) -> list[Span]:
    """Children at blank lines outside fences, and around fenced blocks."""
    edges, fenced_before, blank_before = [span[0]], False, False
    for a, _, line, fenced in _lines(text, span):
        if a > span[0] and (fenced != fenced_before or (blank_before and line.strip() and not fenced)):
            edges.append(a)
        fenced_before, blank_before = fenced, not line.strip()
    edges.append(span[1])
    return list(zip(edges, edges[1:]))


_LEVELS = (
    _sections,
    _blocks,
    lambda t, s: _between(t, s, _LINE),
    lambda t, s: _between(t, s, _SENTENCE),
    lambda t, s: _between(t, s, _CLAUSE),
    lambda t, s: _between(t, s, _WORD),
)


def _pack(text: str, span: Span, level: int, budget: int, limit: int) -> list[tuple[int, int, bool]]:
    """Parts of a span as (start, end, ends by a hard cut)."""
    begin, end = span
    if end - begin <= budget:
        return [(begin, end, False)]
    if level == len(_LEVELS):
        # a word and the signs after it; only a longer one is cut inside
        word = len(text[begin:end].rstrip(" \t\r\n.,;:!?。，；：！？、　"))
        if end - begin <= limit:
            return [(begin, end, False)]
        if word <= limit and word < end - begin:
            tail = begin + max(word, 1)
            rest = [(a, min(a + budget, end), False) for a in range(tail, end, budget)]
            return ([(begin, tail, False)] if word else []) + rest
        return [(a, min(a + budget, end), a + budget < end) for a in range(begin, end, budget)]
    children = _LEVELS[level](text, span)
    if len(children) == 1:
        # a section that opens with its heading may hold deeper headings only
        return _pack(text, span, level + 1, budget, limit)
    again = level if level == 0 else level + 1
    parts = [p for child in children for p in _pack(text, child, again, budget, limit)]
    merged = [parts[0]]
    for begin, end, hard in parts[1:]:
        a, b, hard_before = merged[-1]
        if end - a <= budget and not hard_before:
            merged[-1] = (a, end, hard)
        else:
            merged.append((begin, end, hard))
    return merged


def split_text(text: str, limit: int = 600, overlap: int = 50) -> list[tuple[int, int, str]]:
    """Pieces as (start, end, kind of the cut at the end: ``end``, ``natural`` or ``hard``).

    Without their overlaps the pieces tile the text.  A piece starts ``overlap``
    characters before its own part; only a part of more than ``limit - overlap``
    characters without a boundary inside gets a shorter overlap, so that it stays whole.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    if len(text) <= limit:
        return [(0, len(text), "end")]
    parts = _pack(text, (0, len(text)), 0, limit - overlap, limit)
    return [
        (max(0, a - overlap, b - limit), b, "end" if b == len(text) else "hard" if hard else "natural")
        for a, b, hard in parts
    ]


def split_oversized(
    rows: DataFrame,
    text_col: str = "page_content",
    id_col: str = "row_id",
    carry: tuple[str, ...] = ("section_path",),
    limit: int = 600,
    overlap: int = 50,
) -> DataFrame:
    """``(id, *carry, piece_no, start, end, cut_kind, piece)``: every text in pieces of at most ``limit`` code points.

    ``cut_kind`` says how the piece ends: ``end`` of the text, a ``natural``
    boundary or a ``hard`` cut inside a run without one.  Null texts give no
    piece, an empty text one empty piece, a text that fits one piece.  Repeated
    rows are split each on their own.
    """
    base = rows.select(id_col, *carry, F.col(text_col).alias("piece")).where("piece is not null")
    kind = "array<struct<piece_no: int, start: int, end: int, cut_kind: string, piece: string>>"

    @F.arrow_udf(kind)
    def cut(texts: pa.Array) -> pa.Array:
        ends, rows_of = [0], []
        for text in texts:
            whole = text.as_py()
            if whole is not None:
                rows_of += [(n, a, b, how, whole[a:b]) for n, (a, b, how) in enumerate(split_text(whole, limit, overlap))]
            ends.append(len(rows_of))
        columns = list(zip(*rows_of)) or [()] * 5
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
        names = ["piece_no", "start", "end", "cut_kind", "piece"]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names))

    # one scan: texts that fit do not leave the JVM; deterministic, it would be run again for the filter that explode infers
    long = cut.asNondeterministic()(F.when(F.length("piece") > limit, F.col("piece")))
    nothing = F.lit(0)
    short = F.array(
        F.struct(
            nothing.alias("piece_no"), nothing.alias("start"), F.length("piece").alias("end"), F.lit("end").alias("cut_kind"), F.col("piece").alias("piece")
        )
    )
    pieces = base.withColumn("long", long).select(id_col, *carry, F.explode(F.when(F.length("piece") > limit, F.col("long")).otherwise(short)).alias("p"))
    return pieces.select(id_col, *carry, "p.*")


def oversized_rows(pieces: DataFrame, id_col: str = "row_id") -> DataFrame:
    """``(id, cut_kind)`` of the texts that were cut: ``hard`` if one of their cuts is."""
    return (
        pieces.where("cut_kind <> 'end'")
        .groupBy(id_col)
        .agg(F.when(F.max(F.col("cut_kind") == "hard"), "hard").otherwise("natural").alias("cut_kind"))
    )
