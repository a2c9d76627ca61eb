"""Sampled suffixes: the starts within a text that every long enough repeated string must contain at the same place.

Of every window of `length` bytes the anchor is the k-gram with the least hash
(the leftmost of equals). Equal windows have their anchors at equal offsets, so
two occurrences of a repeated string meet at a pair of equal suffix heads, and
of all suffixes only about one in (length - k) / 2 needs to be sorted.
"""

from __future__ import annotations

import numpy as np

GRAM = 64
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the `gram` bytes from each position (gram a power of two), by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    step, mult = 1, _BASE
    while step < gram:
        h = h[:-step] * mult + h[step:]
        mult = mult * mult
        step *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def runs(data: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches [first, last] of window starts that have the same anchor, and the anchors."""
    n = len(data) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    with np.errstate(over="ignore"):
        h = gram_hashes(data, gram)
    w = length - gram + 1
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    # Least of each w keys: suffix minima of a block and prefix minima of the next.
    blocks = -(-len(key) // w)
    padded = np.full(blocks * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(key)] = key
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cuts = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    first = np.r_[0, cuts]
    last = np.r_[cuts - 1, n - 1]
    return first, last, anchor[first]
