"""A minimal perfect hash over 128-bit keys, as a stack of bit levels.

Each level hashes the keys that are left into twice as many bits; keys alone on
their bit are settled there, the others go on.  A key's number is the rank of
its bit, so ``n`` keys index arrays of exactly ``n`` entries for about four bits
each.  Keys that were not indexed get any number or none: callers compare a
fingerprint.
"""

from __future__ import annotations

import struct

import numpy as np

GAMMA = 2
LEVELS = 60
_HEAD = struct.Struct("<QI")


def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a + b * np.uint64(0x9E3779B97F4A7C15) + np.uint64((level + 1) * 0xD1B54A32D192ED03 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) % np.uint64(size)


def build(a: np.ndarray, b: np.ndarray) -> bytes:
    """Serialise the hash of the distinct keys ``(a, b)``, two unsigned 64-bit halves."""
    n, parts, sizes = len(a), [], []
    while len(a):
        if len(sizes) == LEVELS:
            raise ValueError("the keys are not distinct")
        size = -(-max(64, GAMMA * len(a)) // 64) * 64
        at = _place(a, b, len(sizes), size)
        alone = np.bincount(at.astype(np.int64), minlength=size) == 1
        parts.append(np.packbits(alone, bitorder="little").tobytes())
        sizes.append(size)
        left = ~alone[at.astype(np.int64)]
        a, b = a[left], b[left]
    return _HEAD.pack(n, len(sizes)) + np.array(sizes, "<u8").tobytes() + b"".join(parts)


class PerfectHash:
    def __init__(self, data: bytes, at: int = 0):
        self.n, levels = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        self.sizes = np.frombuffer(data, "<u8", levels, at).astype(np.int64)
        at += 8 * levels
        self.bits, self.ranks, base = [], [], 0
        for size in self.sizes.tolist():
            bits = np.unpackbits(np.frombuffer(data, np.uint8, size // 8, at), bitorder="little")
            ranks = base + np.cumsum(bits, dtype=np.int64) - bits
            base += int(bits.sum())
            self.bits.append(bits)
            self.ranks.append(ranks)
            at += size // 8
        self.end = at

    def numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for some that were not indexed."""
        out = np.full(len(a), -1, np.int64)
        open_ = np.arange(len(a))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(open_):
                break
            at = _place(a[open_], b[open_], level, size).astype(np.int64)
            found = self.bits[level][at] == 1
            out[open_[found]] = self.ranks[level][at[found]]
            open_ = open_[~found]
        return out
