"""Sets of word shingles as hashes, and their prefixes under several global orders (used inside tasks)."""

from __future__ import annotations

import numpy as np

from .words import Words, mixed, window_hashes


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of `size` words, A-Z lower-cased; of shorter texts, one of all words."""
    words = Words(texts, lower=True)
    h = words.hashes()
    out = np.zeros(len(words.start), np.uint64)
    at = words.windows(size)
    if len(at):
        out[at] = window_hashes(h, size)[at]
    count, first = words.count, words.first
    few = np.flatnonzero((count > 0) & (count < size))
    for n in range(1, size):
        own = few[count[few] == n]
        if len(own):
            out[first[own]] = mixed(window_hashes(h, n)[first[own]] + np.uint64(n))
    kept = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    return [np.unique(out[f : f + k]) for f, k in zip(first[:-1], kept, strict=True)]


def order_keys(tokens: np.ndarray, order: int) -> np.ndarray:
    """The hash by which global order number `order` sorts each token."""
    return mixed(tokens + np.uint64(0x9E3779B97F4A7C15 * (order + 1) & (2**64 - 1)))


def prefix_size(n: int, percent: int) -> int:
    """So many first tokens of a set of n, under any order, hold one of every set that is `percent` or more alike."""
    return n - -(-percent * n // 100) + 1 if n else 0
