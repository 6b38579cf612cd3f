"""Five-word shingle sets of whole texts, as sorted distinct 64-bit hashes (numpy, inside tasks)."""

from __future__ import annotations

from functools import cache

import numpy as np
import xxhash

#: Words remembered per Python worker; the memory is emptied beyond it.
WORDS_KEPT = 1 << 17


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def odd_factors(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(text: str | None, lower: bool = True) -> np.ndarray:
    """Hashes of the words (runs of non-space ASCII-wise), A-Z lower-cased."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return hashes_of((data.lower() if lower else data).split())


def hashes_of(words: list[bytes]) -> np.ndarray:
    if len(_hashes) > WORDS_KEPT:
        _hashes.clear()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """A hash of each window of ``width`` words, in order; of the whole sequence if it is shorter."""
    n = len(words)
    if not n:
        return words
    take = min(n, width)
    factors = odd_factors(width, seed=5)
    out = np.full(n - take + 1, take, np.uint64)
    for j in range(take):
        out += words[j : n - take + 1 + j] * factors[j]
    return mixed(out)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text), width))
