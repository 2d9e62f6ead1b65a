"""Words, word shingles and MinHash signatures as NumPy arrays.

Words are runs of characters other than the six ASCII white spaces; A-Z counts as
a-z where shingles are compared. Hashes are 64 bits wide, so sets of shingles are
exact up to collisions of 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(32)


class WordHashes(dict):
    """64-bit hash of each word, remembered; forgets all when it has grown too long."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = WordHashes()


def split_words(text: str | None, lower: bool = True) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> _SHIFT)) * _MIX
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> _SHIFT)


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; fewer words are one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    length = min(width, len(words))
    rolled = hashes[: len(words) - length + 1].copy()
    for offset in range(1, length):
        rolled *= _MIX
        rolled += hashes[offset : len(words) - length + 1 + offset]
    return np.unique(mixed(rolled + np.uint64(length)))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two non-empty sets have 100 * intersection >= percent * union."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


class MinHash:
    """Signatures of ``size`` 32-bit minima under multiply-add hashing."""

    def __init__(self, size: int, seed: int = 7):
        generator = np.random.default_rng(seed)
        self.factor = generator.integers(0, 2**63, size, np.uint64) * np.uint64(2) + np.uint64(1)
        self.offset = generator.integers(0, 2**63, size, np.uint64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """The minima of a non-empty set, in blocks, so that long sets need little memory."""
        best = None
        for start in range(0, len(hashes), 1024):
            block = hashes[start : start + 1024, None] * self.factor
            block += self.offset
            least = block.min(axis=0)
            best = least if best is None else np.minimum(best, least)
        return (best >> _SHIFT).astype(np.uint32)


def copies_needed(similarity: float, depth: int, miss: float) -> int:
    """How many independent keys of ``depth`` minima leave a chance of at most ``miss``
    that two sets of this similarity share none."""
    return math.ceil(math.log(miss) / math.log1p(-(similarity**depth)))
