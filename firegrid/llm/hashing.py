"""Numpy kernels over the bytes of one text: word bounds and 64-bit hashes."""

from __future__ import annotations

import numpy as np

_SEED = np.random.Generator(np.random.PCG64(20240101))
_BYTE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.ones(1, np.uint64)]
#: Bytes outside words: white space, or all that is no letter, digit or byte of a non-ASCII letter.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NON_ALNUM = np.ones(256, bool)
NON_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        grown = np.full(max(n, 2 * len(_POWERS[0]), 64), _BASE, np.uint64)
        grown[0] = 1
        _POWERS[0] = np.multiply.accumulate(grown)
    return _POWERS[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_bounds(raw: bytes, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text's bytes, and starts and ends of its words."""
    b = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(b) + 2, bool)
    np.logical_not(outside[b], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return b, edges[0::2], edges[1::2]


def word_hashes(raw: bytes, outside: np.ndarray = SPACE) -> np.ndarray:
    """A 64-bit hash of every word, in order."""
    b, starts, ends = word_bounds(raw, outside)
    if not len(starts):
        return np.empty(0, np.uint64)
    sizes = ends - starts
    firsts = np.zeros(len(sizes), np.int64)
    np.cumsum(sizes[:-1], out=firsts[1:])
    shift = np.repeat(starts - firsts, sizes)
    inner = np.arange(len(shift))
    at = inner + shift
    values = _BYTE[b[at]] * _powers(int(sizes.max()))[inner - np.repeat(firsts, sizes)]
    return mix(np.add.reduceat(values, firsts))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of `size` words; of the whole sequence if it has fewer words."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    h = np.full(n, size, np.uint64)
    for j in range(size):
        h = mix(h * _BASE + words[j : j + n])
    return h
