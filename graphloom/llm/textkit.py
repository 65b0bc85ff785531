"""Word splitting and hashing shared by the text operators.

A *word* is a maximal run of bytes outside ``\\x20\\x09-\\x0D``; in UTF-8 these
separators never occur inside a longer character, so splitting the encoded text
gives the same words as the pattern ``[^\\x20\\x09-\\x0D]+`` does on characters.
"""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64


def encode(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null counts as empty, lone surrogates are kept."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


class WordHashes(dict):
    """word -> 64-bit hash, memoised up to ``limit`` words (then forgotten, never wrong)."""

    def __init__(self, seed: int = 0, limit: int = 300_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64's constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def shingles(ids: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of ``k`` word hashes, in order; empty when there are fewer."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(n, salt, dtype=np.uint64)
    for j in range(k):
        out = out * U64(0x9E3779B97F4A7C15) + ids[j : j + n]
        out ^= out >> U64(29)
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of ``w`` values, by doubling."""
    n = len(x) - w + 1
    if n <= 0:
        return np.empty(0, dtype=x.dtype)
    span, cur = 1, x
    while span * 2 <= w:
        cur = np.minimum(cur[:-span], cur[span:])
        span *= 2
    return np.minimum(cur[:n], cur[w - span : w - span + n])
