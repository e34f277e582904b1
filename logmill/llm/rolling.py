"""Hashes of words and of windows of consecutive words, with numpy over whole documents."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import per_worker

#: Odd multipliers; windows are hashed as polynomials in them, modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MOST_WORDS = 250_000


class WordHashes(dict):
    """word -> 64-bit hash, for recent words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Roller:
    """hashes(words) and windows(hashes, length, which): a hash per window start."""

    def __init__(self):
        self.known = WordHashes()
        self.powers = [np.ones(1, np.uint64) for _ in BASES]
        self.inverse = [np.ones(1, np.uint64) for _ in BASES]

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    def _reach(self, n: int) -> None:
        if len(self.powers[0]) < n:
            n = max(n, 2 * len(self.powers[0]), 4096)
            for k, base in enumerate(BASES):
                for table, step in ((self.powers, base), (self.inverse, pow(base, -1, 1 << 64))):
                    full = np.full(n, step, np.uint64)
                    full[0] = 1
                    table[k] = np.multiply.accumulate(full)

    def windows(self, h: np.ndarray, length: int, which: int = 0) -> np.ndarray:
        n = len(h)
        if n < length:
            return np.zeros(0, np.uint64)
        self._reach(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((h ^ np.uint64(which * 0x5851F42D4C957F2D)) * self.powers[which][:n], out=total[1:])
        return mix((total[length:] - total[:-length]) * self.inverse[which][: n - length + 1])


def roller() -> Roller:
    """This worker's roller."""
    return per_worker("roller", Roller)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))
