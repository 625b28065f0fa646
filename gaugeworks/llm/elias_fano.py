"""Ascending numbers in little more than their entropy, with direct access to each.

Of n numbers below u, the low ``floor(log2(u / n))`` bits are stored as they are; the high parts
are unary in a bit string in which the i-th one stands at (high part of number i) + i. The place
of every 256th one is kept in 32 bits, from which a short scan finds any other.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

_STEP = 256
_HEAD = "<QQIIII"  # n, smallest, low bits, bytes of low bits, of high bits, samples


@dataclass
class EliasFano:
    """Encoded non-decreasing numbers."""

    n: int
    base: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @classmethod
    def of(cls, numbers: np.ndarray) -> EliasFano:
        numbers = np.asarray(numbers, np.int64)
        n = len(numbers)
        base = int(numbers[0]) if n else 0
        rest = (numbers - base).astype(np.uint64)
        span = int(rest[-1]) + 1 if n else 1
        low_bits = max(0, (span // max(n, 1)).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((rest[:, None] >> shifts) & np.uint64(1)).astype(np.uint8), bitorder="little")
        ones = (rest >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        high = np.packbits(bits, bitorder="little")
        return cls(n, base, low_bits, low, high, ones[::_STEP].astype(np.uint32))

    def _join(self, first: int, highs: np.ndarray) -> np.ndarray:
        """Numbers from number ``first`` on, whose high parts are given."""
        begin = first * self.low_bits
        end = begin + len(highs) * self.low_bits
        bits = np.unpackbits(self.low[begin // 8 : -(-end // 8)], bitorder="little")
        bits = bits[begin % 8 : begin % 8 + end - begin].reshape(len(highs), self.low_bits)
        weights = np.int64(1) << np.arange(self.low_bits, dtype=np.int64)
        return (highs.astype(np.int64) << self.low_bits) + bits @ weights + self.base

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little")[:])
        return self._join(0, ones - np.arange(self.n))

    def select(self, i: int) -> int:
        """The i-th number, read from one sample and the bits after it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // _STEP]), i % _STEP
        byte = at // 8
        skip = at % 8
        while True:
            bits = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
            ones = np.flatnonzero(bits[skip:]) + skip
            if left < len(ones):
                place = byte * 8 + int(ones[left])
                return int(self._join(i, np.array([place - i]))[0])
            left -= len(ones)
            byte, skip = byte + 64, 0

    def to_bytes(self) -> bytes:
        head = struct.pack(
            _HEAD, 
            self.n, self.base & (1 << 64) - 1, self.low_bits, len(self.low), len(self.high), len(self.samples)
        )
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def read(cls, data: memoryview | bytes, at: int = 0) -> tuple[EliasFano, int]:
        """What ``to_bytes`` wrote at ``at``, and the place after it."""
        n, base, low_bits, n_low, n_high, n_samples = struct.unpack_from(_HEAD, data, at)
        base -= (base >> 63) << 64
        at += struct.calcsize(_HEAD)
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        samples = np.frombuffer(data, "<u4", n_samples, at + n_low + n_high)
        return cls(n, base, low_bits, low, high, samples), at + n_low + n_high + 4 * n_samples
