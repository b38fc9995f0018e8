"""Elias-Fano coding of non-decreasing numbers, with select.

``n`` numbers up to ``u`` take about ``2 + log2(u / n)`` bits each: the lower
bits are packed, the upper parts are written in unary, and every 256th one in
the unary part is sampled, so that a number is found without decoding others.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<QBQQ")
#: The place of each one in each byte, from the lowest.
_SELECT = np.array([([b for b in range(8) if byte >> b & 1] + [0] * 8)[:8] for byte in range(256)], np.int64)


def encode(values: np.ndarray) -> bytes:
    values = np.asarray(values, np.uint64)
    n = len(values)
    if n and np.any(values[1:] < values[:-1]):
        raise ValueError("the numbers must not decrease")
    top = int(values[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    upper = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros((int(upper[-1]) + 1) if n else 0, np.uint8)
    bits[upper] = 1
    unary = np.packbits(bits, bitorder="little").tobytes()
    planes = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    lower = np.packbits(planes.reshape(-1), bitorder="little").tobytes()
    samples = upper[::SAMPLE].astype("<u8").tobytes()
    return _HEAD.pack(n, low, len(lower), len(unary)) + lower + unary + samples


class EliasFano:
    """A view of encoded numbers inside ``data``, from ``at`` on."""

    def __init__(self, data: bytes, at: int = 0):
        self.n, self.low, lower, unary = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        self.lower = np.frombuffer(data, np.uint8, lower, at)
        self.unary = np.frombuffer(data, np.uint8, unary, at + lower)
        self.samples = np.frombuffer(data, "<u8", -(-self.n // SAMPLE), at + lower + unary)
        self.end = at + lower + unary + 8 * len(self.samples)

    def all(self) -> np.ndarray:
        upper = np.flatnonzero(np.unpackbits(self.unary, bitorder="little")).astype(np.uint64) - np.arange(self.n, dtype=np.uint64)
        planes = np.unpackbits(self.lower, count=self.n * self.low, bitorder="little").reshape(self.n, self.low).astype(np.uint64)
        return (upper << np.uint64(self.low)) | (planes << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def selected(self, wanted: np.ndarray) -> np.ndarray:
        """The numbers at the places ``wanted``: the bytes between a sample and its place are counted, no other number is decoded.

        Places far apart read 256 ones each; for runs of places the bytes of the run are counted once.
        """
        wanted = np.asarray(wanted, np.int64)
        if not len(wanted):
            return np.zeros(0, np.uint64)
        low, high = int(wanted.min()), int(wanted.max())
        if low < 0 or high >= self.n:
            raise IndexError(low if low < 0 else high)
        # Bytes of the unary part from the sample before the first place to the one after the last.
        first = int(self.samples[low // SAMPLE]) >> 3
        last = int(self.samples[high // SAMPLE + 1]) >> 3 if high // SAMPLE + 1 < len(self.samples) else len(self.unary) - 1
        part = self.unary[first : last + 1]
        skipped = int(self.unary[first] & ((1 << (int(self.samples[low // SAMPLE]) & 7)) - 1)).bit_count()
        ones = np.cumsum(np.bitwise_count(part), dtype=np.int64)
        rank = wanted - low // SAMPLE * SAMPLE + skipped
        byte = np.searchsorted(ones, rank, side="right")
        left = rank - np.where(byte > 0, ones[byte - 1], 0)
        upper = 8 * (first + byte) + _SELECT[part[byte], left] - wanted
        at = wanted[:, None] * self.low + np.arange(self.low)
        planes = (self.lower[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return (upper.astype(np.uint64) << np.uint64(self.low)) | (planes.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """The i-th number, from the nearest sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, skip = divmod(at, 8)
        word = int(self.unary[byte]) >> skip << skip
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.unary[byte])
        for _ in range(left):
            word &= word - 1
        upper = 8 * byte + (word & -word).bit_length() - 1 - i
        low = 0
        for b in range(self.low):
            k = i * self.low + b
            low |= (int(self.lower[k >> 3]) >> (k & 7) & 1) << b
        return upper << self.low | low
