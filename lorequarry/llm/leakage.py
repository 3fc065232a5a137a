"""Evaluation passages inside training documents (problem 9).

Method: prefix-filtered set join on character shingles.  A document leaks a
passage if both, reduced to lower-case letters and digits, share a run of at
least ``min_run`` characters.  Such a run holds every shingle of one window of
that size of the passage, so the window is fully contained and its prefix is a
single shingle: the rarest in the corpus.  The join therefore needs only the
rarest shingle of each window; every other shingle of the passages is left out.
Survivors keep to length and positional bounds (the overlap on the aligned
diagonal must fit a window) and are verified character by character.

Scale.  Both sides are tables and meet in an equi-join; neither reaches the
driver.  The corpus is read once, past a bit table of the passages' shingles
whose size has a bound (``MOST_BITS``): only hits that stand in as long a row as
the shortest window are written, with the bare text of their documents.  A full
bit table lets more hits pass, never fewer.  Nothing is sampled, cut or capped;
rarity is counted over the hits of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lorequarry.llm.codepoints import letters_and_digits, pieces, window_hashes
from lorequarry.shared import materialize

DOUBLINGS = 4
SHINGLE = 1 << DOUBLINGS
#: Bits of the table a shingle, and in all (128 MB, broadcast once).
BITS_EACH, MOST_BITS = 16, 1 << 30


def _texts(codes: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> pa.Array:
    return pa.array([codes[offsets[r] : offsets[r + 1]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass") for r in rows], pa.string())


def _bare_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ``(item_id, passage, run)``: the bare passages that reach their run."""
    for batch in pieces(batches, 1):
        codes, offsets = letters_and_digits(batch.column(1))
        rows = np.flatnonzero(np.diff(offsets) >= batch.column(2).to_numpy(zero_copy_only=False))
        kept = batch.take(pa.array(rows))
        yield pa.RecordBatch.from_arrays([kept.column(0), _texts(codes, offsets, rows), kept.column(2)], names=["item_id", "item", "run"])


def _inner_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points and offsets of bare texts; hash, text and place of each shingle that ends in its text."""
    codes, offsets = letters_and_digits(texts)
    h = window_hashes(codes, DOUBLINGS)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))[: len(h)]
    inside = np.flatnonzero(np.arange(len(h)) + SHINGLE <= offsets[owner + 1])
    return codes, offsets, h[inside], owner[inside], inside - offsets[owner[inside]]


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1):
        _, _, h, owner, place = _inner_shingles(batch.column(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), batch.column(0).take(pa.array(owner)), pa.array(place.astype(np.int32))], names=["hash", "pid", "place"]
        )


def _bit_table(shingles: DataFrame, bits_each: int) -> tuple[np.ndarray, int]:
    """Bits set at the top bits of every hash, as 64-bit words, and how many top bits; at most MOST_BITS in all."""
    n = shingles.count()
    top = min(max((bits_each * n - 1).bit_length(), 12), MOST_BITS.bit_length() - 1)
    slot = F.shiftrightunsigned("hash", 64 - top)
    words = shingles.groupBy(F.shiftrightunsigned(slot, 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))).alias("bits")
    )
    table = np.zeros(1 << (top - 6), np.uint64)
    for batch in words.toArrow().to_batches():  # MOST_BITS / 64 rows at most
        table[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    return table, top


def _rows_of_hits(at: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """Mask of the hits that stand in a row of at least ``least`` neighbouring places of one text."""
    new = np.r_[True, (np.diff(at) != 1) | (doc[1:] != doc[:-1])] if len(at) else np.zeros(0, bool)
    size = np.bincount(np.cumsum(new) - 1) if len(at) else np.zeros(0, np.int64)
    return size[np.cumsum(new) - 1] >= least


def _hits(table, top: int, least: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = table.value
        for batch in pieces(batches, 1):
            codes, offsets = letters_and_digits(batch.column(1))
            h = window_hashes(codes, DOUBLINGS)
            slot = h >> np.uint64(64 - top)
            at = np.flatnonzero(words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1))
            doc = np.searchsorted(offsets, at, side="right") - 1
            inside = at + SHINGLE <= offsets[doc + 1]
            at, doc = at[inside], doc[inside]
            good = _rows_of_hits(at, doc, least)
            at, doc = at[good], doc[good]
            rows, first = np.unique(doc, return_index=True)
            ends = pa.array(np.r_[first, len(doc)].astype(np.int32))
            place = (at - offsets[doc]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)), _texts(codes, offsets, rows),
                    pa.ListArray.from_arrays(ends, pa.array(h[at].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(place)),
                ],
                names=["doc_id", "text", "hashes", "places"],
            )

    return find


def rarest_per_window(hashes, owner, place, runs, frequency) -> np.ndarray:
    """Mask of the shingles that are the rarest of some window; ties go to the smaller hash, then place."""
    chosen = np.zeros(len(hashes), bool)
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else []
    for a, b in zip(starts, [*starts[1:], len(owner)]):
        order = np.lexsort((place[a:b], hashes[a:b], frequency[a:b]))
        rank = np.empty(b - a, np.int64)
        rank[order] = np.arange(b - a)
        wide = runs[owner[a]] - SHINGLE + 1
        windows = np.lib.stride_tricks.sliding_window_view(rank, wide)
        chosen[a + order[np.unique(windows.min(axis=1))]] = True
    return chosen


def longest_equal_run(equal: np.ndarray) -> int:
    edges = np.diff(np.r_[0, equal.astype(np.int8), 0])
    begins = np.flatnonzero(edges == 1)
    return int((np.flatnonzero(edges == -1) - begins).max()) if len(begins) else 0


def _prefixes(passage: pd.DataFrame) -> pd.DataFrame:
    """The shingles of one passage that are the rarest of a window and occur at all."""
    rows = passage.sort_values("place")
    docs = rows["docs"].to_numpy()
    chosen = rarest_per_window(
        rows["hash"].to_numpy(), np.zeros(len(rows), np.int64), rows["place"].to_numpy(), rows["run"].to_numpy(), docs
    )
    # a window whose rarest shingle occurs nowhere cannot be contained
    return rows.loc[chosen & (docs > 0), ["hash", "pid", "place"]]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ``(doc_id, item_id, run, shift, text, item)``: the longest equal run on the diagonal, where it is long enough."""
    for batch in pieces(batches, 4):
        need, shifts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        found = np.zeros(batch.num_rows, np.int32)
        for row, (text, item) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
            shift = shifts[row]
            begin, end = max(0, shift), min(len(text), shift + len(item))
            if end - begin >= need[row]:
                a, b = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (text[begin:end], item[begin - shift : end - shift]))
                found[row] = longest_equal_run(a == b)
        good = np.flatnonzero(found >= np.array(need, np.int64)) if len(need) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(good)), batch.column(1).take(pa.array(good)), pa.array(found[good])], names=["doc_id", "item_id", "run"]
        )


def leaked_passages(
    documents: DataFrame, heldout: DataFrame, min_run: int = 60, min_run_zh: int = 24, bits_each: int = BITS_EACH
) -> DataFrame:
    """``(doc_id, item_id, run)``: documents that share a run of enough characters with a passage.

    ``run`` is the longest such run.  Null or empty texts and passages shorter
    than their run match nothing; a repeated passage under two ids is reported
    for both; repeated documents are each reported.  Without passages or
    documents the result is empty.  Other columns are ignored.
    ``min_run`` values below the shingle width (16) are not supported.
    """
    if min(min_run, min_run_zh) < SHINGLE:
        raise ValueError(f"a run must be at least {SHINGLE} characters")
    need = F.when(F.lower(F.trim("lang")).startswith("zh"), min_run_zh).otherwise(min_run)
    rows = heldout.where("passage is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "passage", need.cast("int").alias("run"))
    bare = rows.distinct().mapInArrow(_bare_passages, "item_id long, item string, run int").distinct()
    passages = materialize(bare.select(F.monotonically_increasing_id().alias("pid"), "*"), "passages")
    shingles = materialize(passages.select("pid", "item").mapInArrow(_shingle_rows, "hash long, pid long, place int"), "shingles")

    words, top = _bit_table(shingles, bits_each)
    table = documents.sparkSession.sparkContext.broadcast(words)
    texts = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    find = _hits(table, top, min(min_run, min_run_zh) - SHINGLE + 1)
    found = materialize(texts.mapInArrow(find, "doc_id long, text string, hashes array<long>, places array<int>"), "hits")
    hits = found.select("doc_id", F.explode(F.arrays_zip("hashes", "places")).alias("h")).select("doc_id", F.col("h.hashes").alias("hash"), F.col("h.places").alias("at"))

    rarity = hits.select("doc_id", "hash").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("docs"))
    known = shingles.join(rarity, "hash", "left").join(passages.select("pid", "run"), "pid")
    prefixes = known.withColumn("docs", F.coalesce("docs", F.lit(0).cast("long"))).groupBy("pid").applyInPandas(_prefixes, "hash long, pid long, place int")
    aligned = hits.join(prefixes, "hash").select("doc_id", "pid", (F.col("at") - F.col("place")).alias("shift")).distinct()
    return (
        aligned.join(passages, "pid")
        .join(found.select("doc_id", "text"), "doc_id")
        .select("doc_id", "item_id", "run", "shift", "text", "item")
        .mapInArrow(_verify, "doc_id long, item_id long, run int")
        .groupBy("doc_id", "item_id")
        .agg(F.max("run").alias("run"))
    )
