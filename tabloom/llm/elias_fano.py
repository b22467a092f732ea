"""Monotone integer sequences in Elias-Fano form, read by many queries at once in numpy."""

from __future__ import annotations

import numpy as np

_POP = np.array([bin(b).count("1") for b in range(256)], np.uint8)
_SELECT = np.array([[next((i for i in range(8) if b >> i & 1 and bin(b & ((1 << i) - 1)).count("1") == r), 8)
                     for r in range(8)] for b in range(256)], np.uint8)


class EliasFano:
    """``values`` in order, below ``universe``.  The low bits of each are packed side by side; the high bits are a bit
    vector in which value i sets bit high(i) + i.  ``arrays`` lists the parts, for files."""

    def __init__(self, values: np.ndarray, universe: int):
        self.n, self.universe = len(values), max(1, int(universe))
        self.low_bits = max(0, int(self.universe // max(1, self.n)).bit_length() - 1)
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64) + np.arange(self.n)
        top = (self.universe >> self.low_bits) + self.n + 1
        bits = np.zeros(-(-top // 64) * 64, np.uint8)
        bits[high] = 1
        self.high = np.packbits(bits, bitorder="little")
        ones = _POP[self.high].reshape(-1, 8).sum(1, dtype=np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)  # before each 64 bits
        self.low = self._packed(values)

    def _packed(self, values: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(16, np.uint8)
        out, step = [], 1 << 16
        shifts = np.arange(self.low_bits, dtype=np.uint64)
        for i in range(0, self.n, step):  # a multiple of eight values, so every part ends on a byte
            out.append(np.packbits(((values[i:i + step, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little"))
        return np.concatenate([*out, np.zeros(16, np.uint8)])

    def arrays(self) -> list[np.ndarray]:
        return [self.high, self.ones, self.low]

    def replace(self, arrays: list[np.ndarray]) -> None:
        self.high, self.ones, self.low = arrays

    def _select(self, rank: np.ndarray, of: int) -> np.ndarray:
        """The place of the rank-th bit (from 0) that is ``of``."""
        before = self.ones.astype(np.int64) if of else np.arange(len(self.ones)) * 64 - self.ones
        word = np.searchsorted(before, rank, "right") - 1
        left, byte, open_ = rank - before[word], word * 8, np.ones(len(rank), bool)
        for _ in range(7):
            bits = self.high[byte] if of else ~self.high[byte]
            count = _POP[bits]
            open_ &= left >= count
            left, byte = left - np.where(open_, count, 0), byte + open_
        bits = self.high[byte] if of else ~self.high[byte]
        return byte * 8 + _SELECT[bits, np.minimum(left, 7)]

    def lows(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at * self.low_bits
        byte, shift = bit >> 3, (bit & 7).astype(np.uint64)
        word = np.zeros(len(at), np.uint64)
        for k in range(min(8, (self.low_bits + 14) // 8)):
            word |= self.low[byte + k].astype(np.uint64) << np.uint64(8 * k)
        word >>= shift
        if self.low_bits > 57:  # the last bits may lie in a ninth byte
            more = self.low[byte + 8].astype(np.uint64) << (np.uint64(64) - np.maximum(shift, np.uint64(1)))
            word |= np.where(shift > 0, more, np.uint64(0))
        return word & np.uint64((1 << self.low_bits) - 1)

    def get(self, at: np.ndarray) -> np.ndarray:
        high = self._select(at, 1) - at
        return (high.astype(np.uint64) << np.uint64(self.low_bits) | self.lows(at)).astype(np.int64)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The first place whose value is at least x."""
        high = x >> self.low_bits
        start = np.where(high > 0, self._select(np.maximum(high - 1, 0), 0) + 1 - high, 0)
        stop = self._select(high, 0) - high
        want = x.astype(np.uint64) & np.uint64((1 << self.low_bits) - 1)
        while True:
            open_ = np.flatnonzero(start < stop)
            if not len(open_):
                return start
            middle = (start[open_] + stop[open_]) >> 1
            less = self.lows(middle) < want[open_]
            start[open_[less]] = middle[less] + 1
            stop[open_[~less]] = middle[~less]

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of x, or -1."""
        if not self.n or not len(x):
            return np.full(len(x), -1)
        inside = (x >= 0) & (x < self.universe)
        at = self.successor(np.where(inside, x, 0))
        ok = inside & (at < self.n)
        return np.where(ok & (self.get(np.minimum(at, self.n - 1)) == x), at, -1)
