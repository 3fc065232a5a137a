"""Sets of three-character substrings as numbers, for Arrow passes; every character costs a few NumPy operations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Slots whose hits order the grams from rare to common.
SLOTS = 1 << 20
#: Bits of a gram as it is joined: its slot's place in that order, and 24 bits of its hash.
JOIN_BITS = 44
#: Words of 64 parts each, whose parities bound the difference of two sets.
PARITIES = 8
PARTS = PARITIES * 64
_BATCH_CHARS = 1 << 20


def gram_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of three code points of each text as exact 63-bit numbers, and the text of each, in order."""
    filled = pc.fill_null(texts, "")
    lengths = pc.utf8_length(filled).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.frombuffer("".join(filled.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    if len(codes) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:]
    inside = owner[:-2] == owner[2:]
    grams, owner = grams[inside], owner[:-2][inside]
    if len(codes) and codes.max() >> np.uint64(16) == 0 and len(lengths) <= 1 << 16:
        # three code points of 16 bits and the text fit into one number, which sorts faster than two
        low = np.uint64(0xFFFF)
        keys = owner.astype(np.uint64) << np.uint64(48) | grams >> np.uint64(42) << np.uint64(32) | (grams >> np.uint64(21) & low) << np.uint64(16) | grams & low
        keys.sort()
        keys = keys[_first(keys)]
        grams = (keys >> np.uint64(32) & low) << np.uint64(42) | (keys >> np.uint64(16) & low) << np.uint64(21) | keys & low
        return grams, (keys >> np.uint64(48)).astype(np.int64)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = _first(grams) | _first(owner)
    return grams[new], owner[new]


def _first(sorted_: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_), bool)
    np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:])
    return new


def _mixed(grams: np.ndarray) -> np.ndarray:
    x = grams * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def _slots(mixed: np.ndarray) -> np.ndarray:
    return (mixed >> np.uint64(JOIN_BITS)).astype(np.int64)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose texts (second column) hold about as many characters each, one text at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            until = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _BATCH_CHARS, "right"))
            until = min(max(until, at + 1), at + (1 << 16))
            yield batch.slice(at, until - at)
            at = until


def slot_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(slot, hits)`` of the texts of a task."""
    hits = np.zeros(SLOTS, np.int64)
    for batch in _cut(batches):
        hits += np.bincount(_slots(_mixed(gram_sets(batch.column(1))[0])), minlength=SLOTS)
    own = np.flatnonzero(hits)
    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(hits[own])], names=["slot", "hits"])


def signer(place_of: np.ndarray, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of texts ``(id, bare, ...)``: size of the gram set, its prefix from rare to common, and the parities of PARTS parts of it.

    Grams that agree in all JOIN_BITS count as one place of the order: a join on
    them may bring more pairs together, never fewer.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            n = batch.num_rows
            grams, owner = gram_sets(batch.column(1))
            sizes = np.bincount(owner, minlength=n)
            mixed = _mixed(grams)
            bits = np.bincount(owner * PARTS + (mixed >> np.uint64(24) & np.uint64(PARTS - 1)).astype(np.int64), minlength=n * PARTS) & 1
            odd = np.packbits(bits.astype(np.uint8).reshape(n, PARTS), axis=1).view(np.int64)
            ranked = owner.astype(np.uint64) << np.uint64(JOIN_BITS) | place_of[_slots(mixed)] << np.uint64(24) | mixed & np.uint64(0xFFFFFF)
            ranked.sort()
            needed = np.where(sizes > 0, sizes - np.ceil(sizes * threshold - 1e-9).astype(np.int64) + 1, 0)
            inside = np.arange(len(ranked)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.repeat(needed, sizes)
            prefix = (ranked[inside] & np.uint64((1 << JOIN_BITS) - 1)).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(needed)], pa.int32()), pa.array(prefix))
            columns = [batch.column(0), batch.column(2), batch.column(3), pa.array(sizes, pa.int32()), lists]
            columns += [pa.array(np.ascontiguousarray(odd[:, i])) for i in range(PARITIES)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "is_left", "is_right", "size", "prefix", *(f"odd{i}" for i in range(PARITIES))])

    return sign


def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(a, b, shared, whole)`` of rows ``(a, text of a, b, text of b)``: sizes of the intersection and of the union."""
    for batch in _cut(batches):
        (x, of_x), (y, of_y) = _sets_of_distinct(batch.column(1)), _sets_of_distinct(batch.column(3))
        shared = np.array([len(np.intersect1d(x[i], y[j], assume_unique=True)) for i, j in zip(of_x, of_y, strict=True)], np.int64)
        whole = np.array([len(x[i]) + len(y[j]) for i, j in zip(of_x, of_y, strict=True)], np.int64) - shared
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(shared), pa.array(whole)], names=["a", "b", "shared", "whole"])


def _sets_of_distinct(texts: pa.Array) -> tuple[list[np.ndarray], list[int]]:
    """The gram set of each distinct text, and which of them each text has."""
    coded = pc.dictionary_encode(texts)
    grams, owner = gram_sets(coded.dictionary)
    return np.split(grams, np.searchsorted(owner, np.arange(1, len(coded.dictionary)))), coded.indices.to_pylist()
