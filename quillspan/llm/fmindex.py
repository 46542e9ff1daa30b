"""FM-index over a sequence of small integers: wavelet-matrix ranks and sampled suffix positions, all on arrays."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with constant-time rank: 64-bit words and the count of ones before each."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        padded = np.zeros((self.n // 64 + 1) * 64, dtype=np.uint8)
        padded[: self.n] = bits
        self.words = np.packbits(padded.reshape(-1, 64), axis=1, bitorder="little").view(np.uint64).ravel()
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words).astype(np.int64))]

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask).astype(np.int64)


class Wavelet:
    """Wavelet matrix: one bit vector a level, zeros sorted before ones from level to level."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        v = values
        for level in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = (v >> level) & 1
            self.levels.append(Bits(bit.astype(np.uint8)))
            self.zeros.append(int(len(v) - bit.sum()))
            v = np.r_[v[bit == 0], v[bit == 1]]

    def _down(self, k: int, ones: np.ndarray, i: np.ndarray) -> np.ndarray:
        r = self.levels[k].rank(i)
        return np.where(ones, self.zeros[k] + r, i - r)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands among the first i values."""
        top = len(self.levels) - 1
        start = np.zeros_like(i)
        for k in range(top + 1):
            ones = ((symbol >> (top - k)) & 1).astype(bool)
            start, i = self._down(k, ones, start), self._down(k, ones, i)
        return i - start

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value at i, and how often it stands before i."""
        value = np.zeros_like(i)
        start = np.zeros_like(i)
        for k, bits in enumerate(self.levels):
            ones = bits.get(i)
            value = value * 2 + ones
            start, i = self._down(k, ones, start), self._down(k, ones, i)
        return value, i - start


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; the sequence ends with a symbol smaller than all others."""
    n = len(s)
    _, rank = np.unique(s, return_inverse=True)
    rank = rank.astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.cumsum(np.r_[0, k[1:] != k[:-1]])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            return order
        step *= 2


class FMIndex:
    """Count and locate phrases in a sequence of symbols 1..sigma-1; 0 is kept for the sequence's end."""

    SAMPLE = 16

    def __init__(self, values: np.ndarray, sigma: int):
        s = np.r_[values, 0].astype(np.int64)
        order = suffix_array(s)
        self.n = len(s)
        bwt = s[order - 1]
        self.first = np.r_[0, np.cumsum(np.bincount(s, minlength=sigma))].astype(np.int64)
        self.tree = Wavelet(bwt, sigma)
        marked = order % self.SAMPLE == 0
        self.marks = Bits(marked.astype(np.uint8))
        self.samples = order[marked]

    def ranges(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search for all phrases at once: rows of `phrases`, padded on the right."""
        lo = np.zeros(len(phrases), dtype=np.int64)
        hi = np.full(len(phrases), self.n, dtype=np.int64)
        for back in range(phrases.shape[1] if len(phrases) else 0):
            live = np.flatnonzero((hi > lo) & (lengths > back))
            if not len(live):
                break
            c = phrases[live, lengths[live] - 1 - back]
            lo[live] = self.first[c] + self.tree.rank(c, lo[live])
            hi[live] = self.first[c] + self.tree.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to the nearest sampled position."""
        out = np.zeros(len(rows), dtype=np.int64)
        left, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(left):
            known = self.marks.get(at)
            out[left[known]] = self.samples[self.marks.rank(at[known])] + steps
            left, at = left[~known], at[~known]
            if len(left):
                value, rank = self.tree.access_rank(at)
                at = self.first[value] + rank
                steps += 1
        return out
