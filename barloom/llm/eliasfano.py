"""Elias-Fano sequences: ascending numbers in about two bits each beside their low bits, with constant-time select.

Number i of n below u keeps its l = log2(u / n) low bits in an array; the rest, x >> l, is a one at place (x >> l) + i of a bit
vector. The place of every SAMPLEth one is kept in 32 bits, so select reads a short stretch of the vector and no table of whole
numbers. Sequences are read through a function of (offset, length), so a file is only read where it is asked.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np

SAMPLE = 512
HEAD = struct.Struct("<QQBQQ")  # n, the least number, l, bytes of low bits, bytes of the bit vector
CHUNK = 1 << 16  # numbers whose low bits are spread out at a time; divides into whole bytes


def encode(values: np.ndarray) -> bytes:
    """Ascending whole numbers (int64; they may repeat and lie below 0) as bytes."""
    n = len(values)
    least = int(values[0]) if n else 0
    x = (values.astype(np.int64) - np.int64(least)).astype(np.uint64)
    most = int(x[-1]) if n else 0
    low = max(most // n, 1).bit_length() - 1 if n else 0
    places = (x >> np.uint64(low)).astype(np.int64) + np.arange(n)
    if n and int(places[-1]) >= 1 << 32:
        raise ValueError("more numbers than one sequence can hold")
    ones = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
    ones[places] = 1
    shifts = np.arange(low, dtype=np.uint64)
    lows = b"".join(np.packbits((x[a : a + CHUNK, None] >> shifts & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes() for a in range(0, n, CHUNK)) if low else b""
    high = np.packbits(ones, bitorder="little").tobytes()
    return HEAD.pack(n, least & (1 << 64) - 1, low, len(lows), len(high)) + lows + high + places[::SAMPLE].astype("<u4").tobytes()


class Sequence:
    """Reads what encode() wrote, starting at `at`, through fetch(offset, length)."""

    def __init__(self, fetch: Callable[[int, int], bytes], at: int = 0):
        self.fetch = fetch
        self.n, least, self.low, lows, high = HEAD.unpack(fetch(at, HEAD.size))
        self.least = least - (1 << 64) if least >> 63 else least
        self.lows = at + HEAD.size
        self.high = self.lows + lows
        self.samples, self.high_bytes = self.high + high, high
        self.size = HEAD.size + lows + high + 4 * -(-self.n // SAMPLE)

    def __len__(self) -> int:
        return self.n

    def slice(self, a: int, b: int) -> np.ndarray:
        """Numbers a to before b: select over a stretch of the bit vector that begins at a sample."""
        a, b = max(a, 0), min(b, self.n)
        if a >= b:
            return np.zeros(0, np.int64)
        k, last = a // SAMPLE, (b - 1) // SAMPLE
        marks = np.frombuffer(self.fetch(self.samples + 4 * k, 4 * (min(last + 2, -(-self.n // SAMPLE)) - k)), "<u4").astype(np.int64)
        end = int(marks[last + 1 - k]) // 8 + 1 if last + 1 - k < len(marks) else self.high_bytes
        first = int(marks[0]) // 8
        bits = np.unpackbits(np.frombuffer(self.fetch(self.high + first, end - first), np.uint8), bitorder="little")
        bits[: int(marks[0]) % 8] = 0
        places = np.flatnonzero(bits)[a - k * SAMPLE : b - k * SAMPLE] + first * 8
        x = (places - np.arange(a, b)).astype(np.uint64) << np.uint64(self.low)
        return (x | self._low(a, b)).astype(np.int64) + np.int64(self.least)

    def _low(self, a: int, b: int) -> np.ndarray:
        out = np.zeros(b - a, np.uint64)
        if self.low:
            weights = np.uint64(1) << np.arange(self.low, dtype=np.uint64)
            for c in range(a, b, CHUNK):
                d = min(b, c + CHUNK)
                first = c * self.low // 8
                bits = np.unpackbits(np.frombuffer(self.fetch(self.lows + first, -(-d * self.low // 8) - first), np.uint8), bitorder="little")
                skip = c * self.low - first * 8
                out[c - a : d - a] = bits[skip : skip + (d - c) * self.low].reshape(d - c, self.low).astype(np.uint64) @ weights
        return out

    def select(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])

    def rank(self, x: int) -> int:
        """How many numbers are below x."""
        a, b = 0, self.n
        while a < b:
            mid = (a + b) // 2
            a, b = (mid + 1, b) if self.select(mid) < x else (a, mid)
        return a
