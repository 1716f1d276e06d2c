"""Elias-Fano sequences of non-decreasing integers, with selection by sampled one-bits."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

_HEAD = struct.Struct("<QqQBxxxxxxx")
#: One position in so many is kept; 32-bit positions are enough below 2**32 upper bits.
EVERY = 256
#: Values whose low bits are packed at once.
PACKED = 1 << 13


class EliasFano:
    """n values in about n * (2 + log2(range / n)) bits.

    Each value less the first splits into `low_bits` low bits, packed side by side, and a high
    part, written in unary as gaps of zeros before a one in `upper`.  The i-th value's high part is
    the position of the i-th one less i; `samples` holds the position of every 256th one.
    """

    def __init__(self, n: int, base: int, top: int, low_bits: int, lower: np.ndarray, upper: np.ndarray, samples: np.ndarray):
        self.n, self.base, self.top, self.low_bits = n, base, top, low_bits
        self.lower, self.upper, self.samples = lower, upper, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if not n:
            return cls(0, 0, 0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        if (np.diff(values) < 0).any():
            raise ValueError("the values decrease")
        base = int(values[0])
        rest = values.astype(np.uint64) - np.uint64(base % (1 << 64))  # wraps, so any 64-bit range fits
        top = int(rest[-1])
        low = max(0, (top // n).bit_length() - 1)
        shifts = np.arange(low, dtype=np.uint64)
        packed = [np.zeros(0, np.uint8)]
        for a in range(0, n if low else 0, PACKED):  # a multiple of eight values ends at a whole byte
            bits = ((rest[a : a + PACKED, None] >> shifts) & np.uint64(1)).astype(np.uint8)
            packed.append(np.packbits(bits.ravel(), bitorder="little"))
        ones = (rest >> np.uint64(low)).astype(np.int64) + np.arange(n)
        if ones[-1] >= 1 << 32:
            raise ValueError("one sequence holds 2**32 upper bits at most")
        unary = np.zeros(int(ones[-1]) + 1, np.uint8)
        unary[ones] = 1
        return cls(n, base, top, low, np.concatenate(packed), np.packbits(unary, bitorder="little"), ones[::EVERY].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.n, self.base, self.top, self.low_bits) + self.lower.tobytes() + self.upper.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """The sequence written at `at`, and where it ends."""
        n, base, top, low = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        sizes = [(n * low + 7) // 8, (n + (top >> low) + 7) // 8 if n else 0, 4 * -(-n // EVERY)]
        if len(data) < at + sum(sizes):
            raise ValueError("the sequence is cut off")
        parts = []
        for size, kind in zip(sizes, (np.uint8, np.uint8, "<u4"), strict=True):
            parts.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
            at += size
        return cls(n, base, top, low, *parts), at

    def select(self, i: int) -> int:
        """The i-th value."""
        return int(self.select_range(i, i + 1)[0])

    def select_range(self, i: int, j: int) -> np.ndarray:
        """The values i..j-1: the upper bits are read from the sample before the i-th one to that after the last, the low bits of these values only."""
        if not 0 <= i < self.n or not i < j <= self.n:
            raise IndexError((i, j))
        first, after = i // EVERY, -(-j // EVERY)
        bit = int(self.samples[first])
        end = int(self.samples[after]) if after < len(self.samples) else 8 * len(self.upper)
        ones = np.flatnonzero(np.unpackbits(self.upper[bit // 8 : (end + 7) // 8], bitorder="little")) + bit // 8 * 8
        skip = int(np.searchsorted(ones, bit)) + i - first * EVERY
        high = ones[skip : skip + j - i] - np.arange(i, j)
        low = np.zeros(j - i, np.uint64)
        if self.low_bits:
            at = i * self.low_bits
            bits = np.unpackbits(self.lower[at // 8 : (j * self.low_bits + 7) // 8], bitorder="little")[at % 8 :][: (j - i) * self.low_bits].reshape(j - i, self.low_bits)
            for k in range(self.low_bits):
                low |= bits[:, k].astype(np.uint64) << np.uint64(k)
        return ((high.astype(np.uint64) << np.uint64(self.low_bits)) + low + np.uint64(self.base % (1 << 64))).astype(np.int64)

    def all(self) -> Iterator[int]:
        """Every value, some at a time."""
        for a in range(0, self.n, PACKED):
            yield from self.select_range(a, min(self.n, a + PACKED)).tolist()
