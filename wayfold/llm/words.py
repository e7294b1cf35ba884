"""Words and word hashes of whole Arrow text buffers in numpy.

A word is a maximal run of bytes other than space and 09-0D (UTF-8 never uses those bytes inside a
character). Its hash is a polynomial over random byte values modulo 2**64, taken from prefix sums for all
words of a buffer at once, then mixed.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _VALUES.copy()
_LOWER[65:91] = _VALUES[97:123]
_BASE = np.uint64(int(_rng.integers(1, 2**63)) * 2 + 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_pow: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, kept per process."""
    if len(_pow[0]) < n:
        m = max(n, 1 << 16)
        for i, b in enumerate((_BASE, _INVERSE)):
            a = np.full(m, b, np.uint64)
            a[0] = 1
            _pow[i] = np.multiply.accumulate(a)
    return _pow[0][:n], _pow[1][:n]


def forget() -> None:
    """Drop the powers kept so far; they are made anew when asked for."""
    _pow[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and the word offsets of the documents (n + 1)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    ends_of = offsets[1:][offsets[1:] > 0] - 1
    after[ends_of] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """Mixed 64-bit hashes of the words; with lower, A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, inv = powers(len(data))
    pre = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER if lower else _VALUES)[data] * p, out=pre[1:])
    return mix((pre[ends] - pre[starts]) * inv[starts])


def window_hashes(w: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size consecutive words: len(w) - size + 1 of them."""
    n = len(w) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p, inv = powers(len(w))
    pre = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w * p, out=pre[1:])
    return mix((pre[size:] - pre[:n]) * inv[:n])
