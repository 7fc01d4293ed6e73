"""Words and rolling hashes of many texts at once, as numpy arrays (used inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: The bytes that separate words: space and 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that are hashed at once; a single longer text is taken whole.
CHUNK = 1 << 21

_rng = np.random.Generator(np.random.PCG64(20240229))
_odd = lambda shape: _rng.integers(0, 1 << 63, shape, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTES = _odd(256)
BASE = _odd(1)[0]
STEP = _odd((2, 40))


_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit numbers."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of some texts: start and end in `buf`, hash, and for each text its first word (`first`, one more at the end)."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(joined, np.uint8)
        if lower:
            buf = LOWER[buf]
        space = SPACE[buf]
        before = np.empty(len(space), bool)
        before[0] = True
        before[1:] = space[:-1]
        self.buf = buf
        self.start = np.flatnonzero(before & ~space)
        self.end = np.flatnonzero(space & ~before)
        lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        offsets = np.concatenate([[0], np.cumsum(lens)])
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    def trim(self, most: int = 3) -> None:
        """Takes up to `most` ASCII punctuation marks off both ends of words that keep a byte."""
        start, end = self.start.copy(), self.end.copy()
        for _ in range(most):
            start += _PUNCT[self.buf[np.minimum(start, len(self.buf) - 1)]] & (start < end - 1)
            end -= _PUNCT[self.buf[np.maximum(end - 1, 0)]] & (start < end - 1)
        self.start, self.end = start, end

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        # positions of all word bytes, one word after another
        total = np.cumsum(length)
        within = np.arange(total[-1]) - np.repeat(total - length, length)
        at = within + np.repeat(self.start, length)
        power = np.cumprod(np.full(int(length.max()), BASE, np.uint64))
        return mixed(np.add.reduceat(BYTES[self.buf[at]] * power[within], total - length))

    def owner(self) -> np.ndarray:
        """The text that each word is of."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def place(self) -> np.ndarray:
        """Each word's number within its text."""
        return np.arange(len(self.start)) - np.repeat(self.first[:-1], self.count)

    def windows(self, k: int) -> np.ndarray:
        """Starts of the windows of k words that lie within one text."""
        left = np.repeat(self.count, self.count) - self.place()
        return np.flatnonzero(left >= k)


def window_hashes(h: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """A hash of h[i : i + k] for each i, by doubling: log k passes, no growth of memory with k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, piece, size, at, level = np.full(n, STEP[lane, 0], np.uint64), h, 1, 0, 1
    while True:
        if k & size:
            out = (out ^ (out >> np.uint64(32))) * STEP[lane, level] + piece[at : at + n]
            at += size
        if size * 2 > k:
            return mixed(out)
        piece = piece[:-size] * STEP[lane, 20 + level] + piece[size:]
        piece ^= piece >> np.uint64(29)
        size, level = size * 2, level + 1


def chunks(texts: list[bytes], most: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of consecutive texts of about `most` bytes, with the index of the first."""
    begin, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t) + 1
        if total >= most:
            yield begin, texts[begin : i + 1]
            begin, total = i + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]
