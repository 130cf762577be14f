"""64-bit hashes of many pieces of a text at a time, from its code points."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
#: Characters that are hashed at a time.
BLOCK = 1 << 16
#: Odd multiplier of one place of a piece, and its inverse modulo 2**64.
PLACE = 0x9E3779B97F4A7C15
PLACE_INVERSE = pow(PLACE, -1, 1 << 64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def table_size(codes: np.ndarray) -> int:
    """Size of a table by code point that covers these."""
    return 0x110000 if len(codes) and codes.max() > 0xFFFF else 0x10000


def random_bits(numbers: np.ndarray) -> np.ndarray:
    """64 bits for each number."""
    bits = numbers.astype(U) + U(1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        bits *= U(0x9E3779B97F4A7C15)
        bits = (bits ^ (bits >> U(shift))) * U(factor)
    return bits ^ (bits >> U(31))


@lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of PLACE and of its inverse."""
    out = [np.full(n, x, U) for x in (PLACE, PLACE_INVERSE)]
    for p in out:
        p[:1] = 1
        np.cumprod(p, out=p)
    return out[0], out[1]


def spelled(codes: np.ndarray, bits: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each piece, a range of code points, never 0: the sum of its letters' bits times powers of PLACE."""
    out, i = np.empty(len(begins), U), 0
    while i < len(begins):
        first = int(begins[i])
        j = max(int(np.searchsorted(ends, first + BLOCK, "right")), i + 1)
        n = int(ends[j - 1]) - first
        # a piece longer than a block stands alone
        up, down = powers(BLOCK) if n <= BLOCK else powers.__wrapped__(n)
        sums = np.zeros(n + 1, U)
        np.cumsum(bits[codes[first:first + n]] * up[:n], out=sums[1:])
        at = begins[i:j] - first
        out[i:j] = (sums[ends[i:j] - first] - sums[at]) * down[at]
        i = j
    out[out == 0] = 1
    return out
