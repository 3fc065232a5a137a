"""Texts to chunks: windows, recursive splitting, headings, section paths and stable ids."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from lorequarry.functions.text import content_hash, normalize_text, stable_chunk_id
from lorequarry.operators.scans import start_offsets

SIZE, OVERLAP = 300, 50
#: Where a text is cut, from the coarsest place to the finest.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", " ", "")


def fixed_windows(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``(doc_id, source, piece, start, text)``: windows of ``size``, each ``overlap`` into the one before.

    The last window is left out where it would hold nothing but the overlap.
    Null and empty texts give no windows.
    """
    step = size - overlap
    last = F.greatest(F.ceil((F.length("text") - overlap) / step) - 1, F.lit(0))
    numbered = docs.where(F.length("text") > 0).select(
        "doc_id", "source", "text", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")
    )
    start = (F.col("piece") * step).cast("int")
    return numbered.select("doc_id", "source", F.col("piece").cast("int"), start.alias("start"), F.substring("text", start + 1, F.lit(size)).alias("text"))


def _cut(text: str, separator: str) -> list[str]:
    """Parts of a text, each but the first opening with the separator."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in (head, *(separator + r for r in rest)) if p]


def _gather(parts: list[str], size: int, overlap: int) -> Iterator[str]:
    """Join neighbouring parts up to ``size``, carrying whole parts of at most ``overlap`` over."""
    held: list[str] = []
    total = 0
    for part in parts:
        if held and total + len(part) > size:
            yield "".join(held)
            while held and (total > overlap or total + len(part) > size):
                total -= len(held.pop(0))
        held.append(part)
        total += len(part)
    if held:
        yield "".join(held)


def recursive_pieces(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, str]]:
    """Stripped pieces of at most ``size`` characters with their start, cut at the coarsest separator present.

    Parts that are still too long are cut again with the finer separators.
    """

    def split(part: str, level: int) -> Iterator[str]:
        while separators[level] and separators[level] not in part:
            level += 1
        fitting: list[str] = []
        for p in _cut(part, separators[level]):
            if len(p) < size or level + 1 == len(separators):
                fitting.append(p)
                continue
            yield from _gather(fitting, size, overlap)
            fitting = []
            yield from split(p, level + 1)
        yield from _gather(fitting, size, overlap)

    found, start, previous = [], 0, 0
    for piece in split(text, 0) if text else ():
        bare = piece.strip()
        if bare:
            start = text.find(bare, max(0, start + previous - overlap) if found else 0)
            found.append((start, bare))
            previous = len(bare)
    return found


def recursive_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``(doc_id, piece, start, text)`` by recursive splitting of whole texts, in one Arrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (doc, n, start, piece)
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for n, (start, piece) in enumerate(recursive_pieces(text or "", size, overlap))
            ]
            columns = list(zip(*rows)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "text"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start int, text string")


_BREAKS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
#: At the start of a line: an opening or closing fence, or a heading with its title.
_SIGNS = re.compile(
    rf"(?:\A|(?<=[{_BREAKS}]))(?:[^\S{_BREAKS}]*(?P<fence>```|~~~)|(?P<hashes>#{{1,6}})[^\S{_BREAKS}]+(?P<title>[^{_BREAKS}]*[^\s]))"
)


def _title(raw: str) -> str:
    """A title without its closing hashes; one made of hashes alone keeps the first of them."""
    return raw.rstrip("#").rstrip() or raw[:1]


def heading_list(text: str) -> list[tuple[int, int, str]]:
    """Headings outside fenced code as (offset, level, title)."""
    signs = list(_SIGNS.finditer(text))
    fences = accumulate((m["fence"] is not None for m in signs), initial=0)
    return [(m.start(), len(m["hashes"]), _title(m["title"])) for m, before in zip(signs, fences) if m["hashes"] and before % 2 == 0]


def path_list(headings: list[tuple[int, int, str]]) -> list[tuple[int, str]]:
    """The path of open headings at each heading, as (offset, titles joined)."""
    trail: dict[int, str] = {}
    paths = []
    for offset, level, title in headings:
        trail = {k: v for k, v in trail.items() if k < level} | {level: title}
        paths.append((offset, " > ".join(trail[k] for k in sorted(trail))))
    return paths


def _per_document(docs: DataFrame, rows_of: Callable[[str], list[tuple]], schema: str, names: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                {"doc_id": doc} | dict(zip(names, row))
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for row in rows_of(text or "")
            ]
            kinds = {"offset": pa.int32(), "level": pa.int32(), "doc_id": pa.int64()}
            arrays = [pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in ["doc_id", *names]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {schema}")


def headings(docs: DataFrame) -> DataFrame:
    """``(doc_id, offset, level, title)`` of the headings outside fenced code."""
    return _per_document(docs, heading_list, "offset int, level int, title string", ["offset", "level", "title"])


def section_list(docs: DataFrame) -> DataFrame:
    """``(doc_id, offset, path)``: the section path that each heading opens."""
    return _per_document(docs, lambda t: path_list(heading_list(t)), "offset int, path string", ["offset", "path"])


def path_at(text: str, offset: int) -> str:
    """Section path at an offset: empty before the first heading and for a negative offset."""
    paths = path_list(heading_list(text))
    n = bisect_right([o for o, _ in paths], offset)
    return paths[n - 1][1] if n and offset >= 0 else ""


def with_section_paths(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks with ``section_path``: an as-of match of each start to the document's headings."""
    opened = section_list(docs).select("doc_id", F.col("offset").alias("_at"), F.col("path").alias("_path"), F.lit(0).alias("_is_chunk"))
    both = chunks.withColumn("_at", F.col("start")).withColumn("_is_chunk", F.lit(1)).unionByName(opened, allowMissingColumns=True)
    # a group is one document; its texts are shuffled once
    before = W.partitionBy("doc_id").orderBy("_at", "_is_chunk").rowsBetween(W.unboundedPreceding, 0)
    path = F.coalesce(F.last("_path", ignorenulls=True).over(before), F.lit(""))
    return both.withColumn("section_path", path).where("_is_chunk = 1").drop("_at", "_path", "_is_chunk")


def enrich(chunks: DataFrame) -> DataFrame:
    """Chunks ``(doc_id, source, piece, section_path, text)`` with chunk_index, occurrence and chunk_id.

    The index runs over all documents in order of id; the occurrence counts equal
    normalised texts of a source.
    """
    counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    placed = chunks.join(start_offsets(counts, "doc_id", "n"), "doc_id").withColumn("chunk_index", F.col("offset") + F.col("piece"))
    seen = W.partitionBy("source", content_hash(F.col("text"))).orderBy("chunk_index")
    numbered = placed.withColumn("occurrence", F.row_number().over(seen) - 1)
    made = stable_chunk_id(F.col("source"), F.col("section_path"), F.col("text"), F.col("occurrence"))
    return numbered.select("doc_id", "piece", "chunk_index", "occurrence", "section_path", made.alias("chunk_id"))


_BLANK_RUN = re.compile(r"[\s\x1c-\x1f]+")


def mapped_text(text: str) -> tuple[str, list[int]]:
    """The normalised text and the offset in the raw text of each of its characters; a run of blanks counts where it begins."""
    parts: list[str] = []
    offsets: list[int] = []
    at = 0
    for m in (*_BLANK_RUN.finditer(text), None):
        end = m.start() if m else len(text)
        parts.append(text[at:end])
        offsets += range(at, end)
        if m:
            if offsets and m.end() < len(text):
                parts.append(" ")
                offsets.append(m.start())
            at = m.end()
    return "".join(parts), offsets


def mapped_texts(docs: DataFrame) -> DataFrame:
    """``(doc_id, body, offsets)``: normalised texts with the raw offset of each character; null texts as empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body, offsets = mapped_text(text or "")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc], pa.int64()), pa.array([body]), pa.array([offsets], pa.list_(pa.int32()))], names=["doc_id", "body", "offsets"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, body string, offsets array<int>")


def locate_raw(chunks: DataFrame, docs: DataFrame, probe: int = 120) -> DataFrame:
    """``(doc_id, piece, found)``: like ``locate``, but as an offset in the raw text; the cursor, a raw offset, where it is not found."""
    needle = F.substring(normalize_text(F.col("text")), 1, probe)
    rows = chunks.withColumn("needle", needle).join(mapped_texts(docs), "doc_id")
    # the first normalised character at or after the cursor
    ahead_of = F.size(F.filter("offsets", lambda o: o < F.col("cursor")))
    placed = rows.withColumn("from", ahead_of).withColumn("ahead", F.expr("locate(needle, body, from + 1)")).withColumn("any", F.expr("locate(needle, body)"))
    hit = F.when(F.col("ahead") > 0, F.col("ahead")).when(F.col("any") > 0, F.col("any"))
    raw = F.when((F.col("needle") != "") & hit.isNotNull(), F.get("offsets", hit - 1)).otherwise(F.col("cursor"))
    return placed.select("doc_id", "piece", raw.cast("int").alias("found"))


def locate(chunks: DataFrame, docs: DataFrame, probe: int = 120) -> DataFrame:
    """``(doc_id, piece, found)``: where a chunk's first normalised characters stand in its normalised document.

    Searched from the chunk's ``cursor``, then from the beginning; the cursor itself where they are not found.
    """
    whole = docs.select("doc_id", normalize_text(F.col("text")).alias("body"))
    needle = F.substring(normalize_text(F.col("text")), 1, probe)
    rows = chunks.withColumn("needle", needle).join(whole, "doc_id")
    ahead = F.expr("locate(needle, body, cursor + 1)")
    anywhere = F.expr("locate(needle, body)")
    place = F.when(F.col("needle") == "", F.col("cursor")).when(ahead > 0, ahead - 1).when(anywhere > 0, anywhere - 1).otherwise(F.col("cursor"))
    return rows.select("doc_id", "piece", place.cast("int").alias("found"))


def split_at_level(docs: DataFrame, level: int, keep_empty: bool = False) -> DataFrame:
    """``(doc_id, part, title, body)``: the text under each heading line of exactly ``level`` hashes, numbered from 1.

    A text without such a heading is one part titled ``full`` (level 2) or none.
    """
    mark = "#" * level
    blocks = F.split("text", rf"(?m)(?=^{mark} .)")
    inner = F.filter(blocks, lambda b: b.startswith(mark + " "))
    rows = docs.where("text is not null").select("doc_id", "text", F.posexplode_outer(inner).alias("pos", "block"))
    strip = lambda c: F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    line = F.regexp_extract("block", rf"^{mark} ([^\n]*)", 1)
    body = strip(F.regexp_replace("block", rf"^{mark} [^\n]*", ""))
    parts = rows.select(
        "doc_id",
        F.coalesce(F.col("pos") + 1, F.lit(1)).alias("part"),
        F.when(F.col("block").isNull(), "full").otherwise(strip(line)).alias("title"),
        F.when(F.col("block").isNull(), F.col("text")).otherwise(body).alias("body"),
        F.col("block").isNull().alias("whole"),
    )
    wanted = F.col("whole") if level == 2 else F.lit(False)
    kept = parts.where(~F.col("whole") | wanted)
    return (kept if keep_empty else kept.where("whole or body <> ''")).drop("whole")


def longest_chunks(chunks: DataFrame, per_source: int = 2) -> DataFrame:
    """``(source, row_id, size, place)``: the longest chunks of each source that has at least ``per_source``."""
    sized = chunks.where("page_content is not null").select("source", "row_id", "chunk_index", F.length("page_content").alias("size"))
    enough = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= per_source).select("source")
    order = W.partitionBy("source").orderBy(F.desc("size"), "chunk_index", "row_id")
    top = sized.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_source)
    return top.join(enough, "source", "left_semi").select("source", "row_id", "size", "place")
