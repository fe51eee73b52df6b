"""Words of a text as 64-bit hashes, and hashes of word windows, in numpy.

Words are runs of bytes other than blank and \\x09-\\x0D: exactly what ``bytes.split`` gives.
"""

from __future__ import annotations

import numpy as np
import xxhash
import zstandard

# Odd multipliers of the 64-bit mixing steps.
STEP = np.uint64(0x9E3779B97F4A7C15)
SPREAD = np.uint64(0xBF58476D1CE4E5B9)
# A task remembers words until they take so many bytes, with what each costs besides its own.
REMEMBERED = 24_000_000
ENTRY = 190


class WordHashes(dict):
    """Word to 64-bit hash; a word is hashed once while it is remembered."""

    size = 0

    def __missing__(self, word: bytes) -> int:
        self.size += ENTRY + len(word)
        if self.size > REMEMBERED:
            self.clear()
            self.size = 0
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * SPREAD
    return h ^ (h >> np.uint64(32))


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of windows that begin as ``left`` and end as ``right``."""
    return mix(left * STEP + right)


def windows(ids: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of ``size`` ids, built by doubling; empty where there is none.

    A size that is no power of two overlaps its two halves, which fixes it all the same.
    """
    if len(ids) < size:
        return ids[:0]
    h, have = ids, 1
    while have < size:
        step = min(have, size - have)
        h = pair(h[: len(h) - step], h[step:])
        have += step
    return h


def sequence_hash(ids: np.ndarray, kind: int = 0) -> int:
    """A signed 64-bit hash of a whole array of ids."""
    return signed(xxhash.xxh3_64_intdigest(ids.tobytes(), seed=kind))


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def packed(text: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(text)


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)
