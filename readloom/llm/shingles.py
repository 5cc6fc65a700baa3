"""Hashes of word shingles, by whole texts at a time."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


class _Powers:
    """1, b, b*b, ... modulo 2**64, as long as the longest text yet."""

    def __init__(self, base: np.uint64):
        self.base, self.held = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.held) < n:
            self.held = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, self.base, np.uint64))])
        return self.held[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_INVERSE)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str, words: int = 5) -> np.ndarray:
    """64-bit hashes of every run of words lower-cased words in order, repeats included; a shorter text is one shingle, no word none."""
    norm = np.frombuffer(" ".join(text.lower().split()).encode("utf-8", "surrogatepass"), np.uint8)
    n = len(norm)
    if not n:
        return np.empty(0, np.uint64)
    blanks = np.flatnonzero(norm == 32)
    starts, ends = np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [n]])
    k = min(words, len(starts))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[norm] * _UP.upto(n), out=sums[1:])
    a, b = starts[: len(starts) - k + 1], ends[k - 1 :]
    return mix64((sums[b] - sums[a]) * _DOWN.upto(n)[a])
