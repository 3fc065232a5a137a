"""Texts of an Arrow batch as one array of code points, with vectorised folding.

Working on whole batches keeps Python out of the per-character path: every
character costs a few NumPy operations.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LAST_LETTER_PLANE = 0x40000  # planes above hold no letters or digits


@cache
def letter_digit_table() -> np.ndarray:
    """Code point -> lower-case code point of letters and digits (L*, N*), 0 for all else."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for i in range(_LAST_LETTER_PLANE):
        c = chr(i)
        if unicodedata.category(c)[0] in "LN":
            table[i] = ord(c.lower()[0])
    return table


@cache
def blank_table() -> np.ndarray:
    """True for Unicode white space."""
    table = np.zeros(sys.maxunicode + 1, bool)
    for i in range(0x3001):
        if chr(i).isspace():
            table[i] = True
    return table


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of ``texts`` (null as empty) and the offsets of each text among them."""
    filled = pc.fill_null(texts, "")
    offsets = np.zeros(len(filled) + 1, np.int64)
    np.cumsum(pc.utf8_length(filled).to_numpy(zero_copy_only=False), out=offsets[1:])
    joined = "".join(filled.to_pylist())
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def keep(codes: np.ndarray, offsets: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only the masked code points, with offsets moved accordingly."""
    before = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(mask, out=before[1:])
    return codes[mask], before[offsets]


def letters_and_digits(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters and digits only."""
    codes, offsets = code_points(texts)
    folded = letter_digit_table()[codes]
    return keep(folded, offsets, folded > 0)


_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def window_hashes(codes: np.ndarray, doublings: int) -> np.ndarray:
    """Polynomial hashes of all windows of 2**doublings code points (by position)."""
    h = codes.astype(np.uint64) + np.uint64(0x1F123BB5)
    width, base = 1, _BASE
    for _ in range(doublings):
        if len(h) <= width:
            return np.zeros(0, np.uint64)
        h = h[:-width] * np.uint64(base) + h[width:]
        width, base = width * 2, base * base & _MASK
    return h ^ (h >> np.uint64(29))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every input bit moves every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pieces(batches: Iterator[pa.RecordBatch], column: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of whole rows that hold about ``limit`` characters of ``column`` each."""
    for batch in batches:
        sizes = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // limit
        edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
        for a, b in zip(edges, [*edges[1:], len(part)]):
            yield batch.slice(int(a), int(b - a))
