"""Portable draws: the head of the MD5 of ``prefix + number`` for many numbers at once.

Numbers of one count of digits differ in their digits only, so a round of MD5 is
a few NumPy operations on all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

_BLOCK = 8192
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF) for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: The last three rounds leave the first word as it is.
_ROUNDS = 61


def digit_blocks(n: int) -> Iterator[tuple[np.ndarray, int]]:
    """The numbers from 0 to n - 1 in blocks of one length: ASCII digits (digits x numbers), and the first number."""
    low, high = 0, 10
    while low < n:
        for first in range(low, min(high, n), _BLOCK):
            numbers = np.arange(first, min(first + _BLOCK, high, n))
            places = 10 ** np.arange(len(str(first)) - 1, -1, -1)
            yield (numbers // places[:, None] % 10 + ord("0")).astype(np.uint32), first
        low, high = high, 10 * high


def md5_heads(prefix: bytes, digits: np.ndarray) -> np.ndarray:
    """The first 8 hex digits of the MD5 of the prefix and each number, as a number."""
    width, n = digits.shape
    length = len(prefix) + width
    if length > 55:
        raise ValueError("the message does not fit into one block")
    fixed = np.frombuffer(prefix + bytes(width) + b"\x80" + bytes(63 - length), "<u4")
    words = {w: np.full(n, fixed[w], np.uint32) for w in range(len(prefix) // 4, (length - 1) // 4 + 1)}
    for j in range(width):
        at = len(prefix) + j
        words[at // 4] |= digits[j] << np.uint32(8 * (at % 4))
    whole = [int(x) for x in fixed]
    whole[14] = 8 * length
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, high = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(_ROUNDS):
        if i < 16:
            k = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            k = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            k = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            k = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        if k in words:
            f += words[k]
            f += _SINES[i]
        else:
            f += np.uint32((int(_SINES[i]) + whole[k]) & 0xFFFFFFFF)
        np.left_shift(f, np.uint32(_TURNS[i]), out=high)
        f >>= np.uint32(32 - _TURNS[i])
        f |= high
        f += b
        a, b, c, d, f = d, f, b, c, a
    return (b + np.uint32(_START[0])).byteswap()
