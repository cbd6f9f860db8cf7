"""Elias-Fano coding of ascending integers, with select for random access."""

from __future__ import annotations

import numpy as np

#: Every so many set bits, the position of one is stored.
SAMPLE = 256


class EliasFano:
    """n ascending values up to u in n * (2 + log2(u / n)) bits or so.

    The low ``l`` bits of each value are packed; the high parts are set bits
    of a vector, value i at position ``(v >> l) + i``. ``select`` finds the
    i-th set bit from a sampled position, so ``access`` needs no scan.
    Repeated values (empty documents) are fine.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> "EliasFano":
        values = np.asarray(values, np.uint64)
        n = len(values)
        low_bits = max(0, (int(universe) // n).bit_length() - 1) if n else 0
        low = np.zeros(0, np.uint8)
        if low_bits and n:
            bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        marks = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        marks[at] = 1
        return cls(n, low_bits, low, np.packbits(marks, bitorder="little"), at[::SAMPLE].astype(np.uint64))

    def select(self, i: int) -> int:
        """Position of the i-th set bit (from 0) of the high part."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        first = int(self.high[byte]) >> (at % 8) << (at % 8)  # from the sampled bit on
        while (have := first.bit_count()) <= left:
            left -= have
            byte += 1
            first = int(self.high[byte])
        for _ in range(left):
            first &= first - 1
        return byte * 8 + (first & -first).bit_length() - 1

    def access(self, i: int) -> int:
        high = self.select(i) - i
        low, at = 0, i * self.low_bits
        for k in range(self.low_bits):
            low |= (int(self.low[(at + k) // 8]) >> ((at + k) % 8) & 1) << k
        return high << self.low_bits | low

    def all(self) -> np.ndarray:
        """All values, decoded in bulk."""
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (at - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits and self.n:
            bits = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
            out |= (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out.astype(np.int64)

    def parts(self) -> list[bytes]:
        return [self.low.tobytes(), self.high.tobytes(), self.samples.astype("<u8").tobytes()]
