"""Counting quotient filters over packed word numbers.

A phrase of n words is a number of n * width bits. An invertible permutation spreads these numbers
evenly; the leading bits of the result are the quotient, all other bits the remainder. As the
remainder is kept whole and the permutation can be undone, the filter has no false counts and gives
back the phrases themselves. Filters of one block (leading bits that they share) are merged in order.
"""

from __future__ import annotations

import struct

import numpy as np

U = np.uint64
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
KEYS = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
HEADER = "<IBI"


def _mask(bits: int) -> np.uint64:
    return U((1 << bits) - 1)


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ U(key)) * U(FACTORS[0])
    x ^= x >> U(32)
    x *= U(FACTORS[1])
    return x ^ (x >> U(29))


class Code:
    """Phrases of n word numbers under 2**width as pairs (hi, lo) of unsigned 64-bit numbers.

    The pair is left-aligned: hi has the first 64 bits of the permuted number, lo the others at its right.
    """

    def __init__(self, n: int, width: int):
        self.n, self.width, self.bits = n, width, n * width
        if self.bits > 128:
            raise ValueError(f"{n} words of {width} bits do not fit in 128")
        self.low = max(self.bits - 64, 0)
        self.high = self.bits - self.low

    def pack(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The permuted number of each phrase; words has one array for each position."""
        hi, lo = np.zeros(len(words[0]), U), np.zeros(len(words[0]), U)
        for i, w in enumerate(words):
            w, shift = w.astype(U), self.width * (self.n - 1 - i) - self.low
            if shift >= 0:
                hi |= w << U(shift)
            else:
                if shift + self.width > 0:
                    hi |= w >> U(-shift)
                lo |= (w << U(self.low + shift)) & _mask(self.low)
        return self._permuted(hi, lo)

    def unpack(self, hi: np.ndarray, lo: np.ndarray) -> list[np.ndarray]:
        hi, lo = self._restored(hi, lo)
        out = []
        for i in range(self.n):
            shift = self.width * (self.n - 1 - i) - self.low
            if shift >= 0:
                w = hi >> U(shift)
            else:
                w = lo >> U(self.low + shift)
                if shift + self.width > 0:
                    w = w | (hi << U(-shift))
            out.append(w & _mask(self.width))
        return out

    def _permuted(self, hi, lo):
        if self.low:  # each half is changed by what the other one is
            for key in KEYS:
                hi = hi ^ _mixed(lo, key)
                lo = lo ^ (_mixed(hi, key) & _mask(self.low))
            return hi, lo
        half = U((self.bits + 1) // 2)
        for factor in FACTORS:
            hi = ((hi ^ (hi >> half)) * U(factor)) & _mask(self.bits)
        return (hi ^ (hi >> half)) << U(64 - self.bits), lo

    def _restored(self, hi, lo):
        if self.low:
            for key in KEYS[::-1]:
                lo = lo ^ (_mixed(hi, key) & _mask(self.low))
                hi = hi ^ _mixed(lo, key)
            return hi, lo
        half = U((self.bits + 1) // 2)
        hi = hi >> U(64 - self.bits)
        hi = hi ^ (hi >> half)
        for factor in FACTORS[::-1]:
            hi = (hi * U(pow(factor, -1, 1 << 64))) & _mask(self.bits)
            hi = hi ^ (hi >> half)
        return hi, lo


def combined(hi: np.ndarray, lo: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct keys in ascending order, and the sums of their counts."""
    if not len(hi):
        return hi, lo, np.zeros(0, np.int64)
    order = np.argsort(hi, kind="stable") if not lo.any() else np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    first = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
    if counts is None:
        sums = np.diff(np.append(first, len(hi)))
    else:
        sums = np.add.reduceat(counts[order], first)
    return hi[first], lo[first], sums


def _bytes_of(x: np.ndarray, size: int) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _from_bytes(raw: bytes, size: int, m: int) -> np.ndarray:
    wide = np.zeros((m, 8), np.uint8)
    wide[:, :size] = np.frombuffer(raw, np.uint8).reshape(m, size)
    return wide.reshape(-1).view("<u8").astype(U)


class Shape:
    """How a block's keys are laid out: block_bits lead, then the quotient, then the remainder."""

    def __init__(self, code: Code, block_bits: int):
        self.code, self.block_bits = code, min(block_bits, code.high)

    def block(self, hi: np.ndarray) -> np.ndarray:
        return (hi >> U(64 - self.block_bits)).astype(np.int64) if self.block_bits else np.zeros(len(hi), np.int64)

    def _rest(self, q: int) -> tuple[int, int, int]:
        """Remainder bits in hi, and the bytes that remainders take in hi and lo."""
        rest = self.code.high - self.block_bits - q
        return rest, (rest + 7) // 8, (self.code.low + 7) // 8

    def encode(self, hi: np.ndarray, lo: np.ndarray, counts: np.ndarray) -> bytes:
        """The filter of distinct ascending keys of one block.

        A bit for each quotient tells whether it occurs, a bit for each key whether it is the
        last of its quotient; counts above 254 are exceptions behind the one-byte counters.
        """
        m = len(hi)
        q = max(0, min(m.bit_length() - 1, self.code.high - self.block_bits))
        rest, hi_bytes, lo_bytes = self._rest(q)
        inner = (hi >> U(64 - self.code.high)) & _mask(self.code.high - self.block_bits)
        quotient = (inner >> U(rest)).astype(np.int64) if q else np.zeros(m, np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        run_end = np.append(quotient[1:] != quotient[:-1], True)
        big = counts > 254
        return b"".join((
            struct.pack(HEADER, m, q, int(big.sum())), np.packbits(occupied).tobytes(), np.packbits(run_end).tobytes(),
            _bytes_of(inner & _mask(rest), hi_bytes), _bytes_of(lo, lo_bytes),
            np.where(big, 255, counts).astype(np.uint8).tobytes(), counts[big].astype("<i8").tobytes(),
        ))

    def decode(self, block: int, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys in ascending order, and their counts."""
        m, q, n_big = struct.unpack_from(HEADER, raw)
        rest, hi_bytes, lo_bytes = self._rest(q)
        at = struct.calcsize(HEADER)

        def take(size: int) -> bytes:
            nonlocal at
            at += size
            return raw[at - size:at]

        occupied = np.unpackbits(np.frombuffer(take(((1 << q) + 7) // 8), np.uint8), count=1 << q)
        run_end = np.unpackbits(np.frombuffer(take((m + 7) // 8), np.uint8), count=m)
        run = np.cumsum(run_end) - run_end
        inner = _from_bytes(take(hi_bytes * m), hi_bytes, m)
        if q:
            inner |= np.flatnonzero(occupied)[run].astype(U) << U(rest)
        if self.block_bits:
            inner |= U(block) << U(self.code.high - self.block_bits)
        lo = _from_bytes(take(lo_bytes * m), lo_bytes, m)
        counts = np.frombuffer(take(m), np.uint8).astype(np.int64)
        counts[counts == 255] = np.frombuffer(take(8 * n_big), "<i8")
        return inner << U(64 - self.code.high), lo, counts
