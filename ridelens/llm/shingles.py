"""Hashes of word shingles, for the operators that compare documents by them."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORDS = 5
_WORD = re.compile(r"\w+")
_MOST_CACHED = 100_000
_ODD = 0x9E3779B97F4A7C15


class _Hashes(dict):
    """Hash of each word; words seen before are not hashed again."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _MOST_CACHED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


HASHES = _Hashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    words = _WORD.findall((text or "").lower())
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def shingles_of_words(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """One hash per run of ``words`` words, in order; a shorter text is one shingle of all
    its words, a text without words has none."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(words, n)
    total = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        factor = np.uint64(_ODD * (2 * i + 1) % 2**64 | 1)
        total += mixed(hashes[i : n - width + 1 + i]) * factor
    return mixed(total)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The hashes of the different shingles of a text, sorted. Words are runs of word
    characters, lower-cased; null counts as empty."""
    return np.unique(shingles_of_words(word_hashes(text), words))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; 1 if both are empty."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)
