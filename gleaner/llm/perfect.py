"""A minimal perfect hash over 128-bit keys, with arrays of what is known of each key in its order.

Levels of bit arrays: a key that is alone at its place of a level is settled there, the others go to the next one. The
place of a key among all keys is the number of bits before its own, so n keys need about 3.5 bits each and no key
is stored. What is not a key may get a place too: a fingerprint array tells it apart.
"""

from __future__ import annotations

import struct

import numpy as np

from .common import mix

#: Bits of a level for each key that reaches it; levels, after which the few keys that are left are stored as they are.
ROOM, LEVELS = 1.5, 40
#: Bits that are counted together.
WORD = 64


def _places(high: np.ndarray, low: np.ndarray, level: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(high ^ mix(low + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1))) % np.uint64(bits)).astype(np.int64)


class PerfectHash:
    """Distinct keys (high, low) to 0 .. n - 1."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        counts = [np.bitwise_count(x).astype(np.int64) for x in levels]
        #: For each level, keys before each of its words.
        self.before, total = [], 0
        for c in counts:
            self.before.append(total + np.cumsum(c) - c)
            total += int(c.sum())
        self.settled = total

    def __len__(self) -> int:
        return self.settled + len(self.rest)

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        levels = []
        for level in range(LEVELS):
            if not len(high):
                break
            bits = -(-int(len(high) * ROOM + 1) // WORD) * WORD
            at = _places(high, low, level, bits)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = ~alone[at]
            high, low = high[left], low[left]
        rest = np.stack((high, low), axis=1)
        return cls(levels, rest[np.lexsort((low, high))])

    def lookup(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The place of each key; for what is none, any place or -1."""
        out = np.full(len(high), -1, np.int64)
        left = np.arange(len(high))
        for level, (words, before) in enumerate(zip(self.levels, self.before, strict=True)):
            at = _places(high[left], low[left], level, len(words) * WORD)
            word, bit = words[at // WORD], (at % WORD).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            rank = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (before[at // WORD] + rank)[hit]
            left = left[~hit]
        for i, (h, l) in enumerate(self.rest):
            out[left[(high[left] == h) & (low[left] == l)]] = self.settled + i
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack("<qq", len(self.levels), len(self.rest)) + struct.pack(f"<{len(self.levels)}q", *map(len, self.levels))
        return head + b"".join(x.tobytes() for x in self.levels) + self.rest.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        n, rest = struct.unpack_from("<qq", raw)
        sizes = struct.unpack_from(f"<{n}q", raw, 16)
        at, levels = 16 + 8 * n, []
        for size in sizes:
            levels.append(np.frombuffer(raw, np.uint64, size, at))
            at += 8 * size
        return cls(levels, np.frombuffer(raw, np.uint64, 2 * rest, at).reshape(-1, 2))
