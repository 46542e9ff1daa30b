"""Elias-Fano sequences and a three-level n-gram trie made of them, in one buffer that can be memory-mapped."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Bits of a successor's hash within its context: after a word, and after a pair, which has far fewer successors.
FINGER, THIRD = 32, 24


def _select_in_word(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Position of the one with r ones before it in each 64-bit word, by halving."""
    at = np.zeros(len(word), dtype=np.int64)
    r = r.copy()
    for width in (32, 16, 8, 4, 2, 1):
        part = (word >> at.astype(U64)) & U64((1 << width) - 1)
        ones = np.bitwise_count(part).astype(np.int64)
        up = r >= ones
        r -= np.where(up, ones, 0)
        at += np.where(up, width, 0)
    return at


class Sequence:
    """A non-decreasing sequence of integers below 2**64: low bytes stored plainly, high parts in unary."""

    def __init__(self, n: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low, self.high = n, low, high
        self.bytes = low.shape[1]
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones = np.r_[0, np.cumsum(ones)]
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    @staticmethod
    def parts(values: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """The low and the high part of sorted values, all below `top`."""
        n = max(1, len(values))
        bits = max(0, (max(1, top) // n).bit_length() - 1)
        width = min(7, -(-bits // 8))
        low = np.ascontiguousarray(values.astype(U64)).view(np.uint8).reshape(-1, 8)[:, :width].copy()
        up = (values.astype(U64) >> U64(8 * width)).astype(np.int64)
        size = int(up[-1]) + len(values) + 1 if len(values) else 1
        bit = np.zeros((size // 64 + 1) * 64, dtype=np.uint8)
        bit[up + np.arange(len(values))] = 1
        return low, np.packbits(bit.reshape(-1, 64), axis=1, bitorder="little").view(U64).ravel()

    def _lows(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros((len(i), 8), dtype=np.uint8)
        out[:, : self.bytes] = self.low[i]
        return out.view(U64).ravel()

    def _select(self, count: np.ndarray, r: np.ndarray, flip: bool) -> np.ndarray:
        w = np.searchsorted(count, r, side="right") - 1
        word = self.high[np.minimum(w, len(self.high) - 1)]
        return w * 64 + _select_in_word(~word if flip else word, r - count[w])

    def get(self, i: np.ndarray) -> np.ndarray:
        up = self._select(self.ones, i, False) - i
        return (up.astype(U64) << U64(8 * self.bytes)) | self._lows(i)

    def _until(self, up: np.ndarray) -> np.ndarray:
        """How many values have a high part below `up`."""
        out = np.full(len(up), self.n, dtype=np.int64)
        out[up <= 0] = 0
        inside = (up > 0) & (up <= self.zeros[-1])
        z = up[inside] - 1
        out[inside] = np.minimum(self._select(self.zeros, z, True) - z, self.n)
        return out

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value not below x (n if there is none)."""
        up = (x >> U64(8 * self.bytes)).astype(np.int64)
        lo, hi = self._until(up), self._until(up + 1)
        low = x & U64((1 << (8 * self.bytes)) - 1)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) // 2
            less = self._lows(mid) < low[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]


def _codebook() -> np.ndarray:
    """Counts that a byte stands for: 1 to 100 as they are, then in even ratios to 10**12."""
    return np.r_[0.0, np.arange(1.0, 101.0), 10 ** np.linspace(2.05, 12, 155)]


CODES = _codebook()


def quantised(counts: np.ndarray) -> np.ndarray:
    middle = (CODES[1:-1] + CODES[2:]) / 2
    return (np.searchsorted(middle, counts, side="right") + 1).astype(np.uint8)


class Trie:
    """One shard of the model.

    Level 1: word hashes; running totals of their counts; pointers to where their successors begin.
    Level 2: successors relative to their context, as (rank of the context, leading bits of the successor's hash),
    and a byte each for the discounted count.
    Level 3: words after a pair, as (rank of the pair, leading bits of the word's hash), and a byte each.
    All but the bytes are monotone Elias-Fano sequences.
    """

    NAMES = ("words", "totals", "pointers", "successors", "thirds")

    def __init__(self, buffer: np.ndarray):
        head = buffer[:256].view(np.int64)
        at, self.parts = 256, {}
        for k, name in enumerate(self.NAMES):
            n, width, words = (int(v) for v in head[3 * k : 3 * k + 3])
            low = buffer[at : at + n * width].reshape(n, width)
            at += -(-n * width // 8) * 8
            self.parts[name] = Sequence(n, low, buffer[at : at + 8 * words].view(U64))
            at += 8 * words
        n, m = (int(v) for v in head[3 * len(self.NAMES) : 3 * len(self.NAMES) + 2])
        self.codes, self.third_codes = buffer[at : at + n], buffer[at + n : at + n + m]
        self.mass_at = self.third_mass_at = None

    @classmethod
    def build(cls, words: np.ndarray, counts: np.ndarray, n_succ: np.ndarray, fingers: np.ndarray, succ_counts: np.ndarray, n_third: np.ndarray, thirds: np.ndarray, third_counts: np.ndarray, least: int) -> bytes:
        """Sorted word hashes with counts and numbers of successors; successors by word and finger, with counts and
        numbers of words after them; these by pair and finger, with counts."""
        owner = np.repeat(np.arange(len(words)), n_succ)
        keep = succ_counts >= least
        pair = np.repeat(np.where(keep, np.cumsum(keep) - 1, -1), n_third)
        third = (pair >= 0) & (third_counts >= least)
        third_key = (pair[third].astype(U64) << U64(THIRD)) | thirds[third]
        owner, fingers, succ_counts = owner[keep], fingers[keep], succ_counts[keep]
        n = np.bincount(owner, minlength=len(words))
        key = (owner.astype(U64) << U64(FINGER)) | fingers
        totals, pointers = np.cumsum(counts).astype(U64), np.cumsum(n).astype(U64)
        code, third_code = quantised(succ_counts), quantised(third_counts[third])
        head = np.zeros(32, dtype=np.int64)
        body = []
        tops = (1 << 64, int(totals[-1]) + 1 if len(totals) else 1, int(pointers[-1]) + 1 if len(pointers) else 1, max(1, len(words)) << FINGER, max(1, len(key)) << THIRD)
        for k, (v, top) in enumerate(zip((words, totals, pointers, key, third_key), tops)):
            low, high = Sequence.parts(v, top)
            head[3 * k : 3 * k + 3] = len(v), low.shape[1], len(high)
            raw = low.tobytes()
            body += [raw, b"\0" * (-len(raw) % 8), high.tobytes()]
        head[3 * len(cls.NAMES) : 3 * len(cls.NAMES) + 2] = len(code), len(third_code)
        return b"".join([head.tobytes(), *body, code.tobytes(), third_code.tobytes()])

    def query(self, words: np.ndarray, n_succ: np.ndarray, fingers: np.ndarray, n_third: np.ndarray, thirds: np.ndarray, discount: float):
        """Counts of words (0: not here), the discounted mass of their kept successors, and the code of each pair (0: not kept);
        the mass of the words kept after each pair, and the code of each triple."""
        w = self.parts["words"]
        counts, mass = np.zeros(len(words), dtype=np.int64), np.zeros(len(words))
        codes, third_mass, third_codes = np.zeros(len(fingers), dtype=np.uint8), np.zeros(len(fingers)), np.zeros(len(thirds), dtype=np.uint8)
        if not w.n or not len(words):
            return counts, mass, codes, third_mass, third_codes
        at = w.successor(words)
        known = at < w.n
        known[known] = w.get(at[known]) == words[known]
        here = at[known]
        before = lambda s, i: np.where(i > 0, s.get(np.maximum(i - 1, 0)).astype(np.int64), 0)
        counts[known] = self.parts["totals"].get(here).astype(np.int64) - before(self.parts["totals"], here)
        end, begin = self.parts["pointers"].get(here).astype(np.int64), before(self.parts["pointers"], here)
        if self.mass_at is None:
            self.mass_at = np.r_[0.0, np.cumsum(np.maximum(CODES[self.codes] - discount, 0.0))]
        mass[known] = self.mass_at[end] - self.mass_at[begin]
        s = self.parts["successors"]
        owner = np.repeat(np.where(known, at, -1), n_succ)
        ask = np.flatnonzero(owner >= 0)
        if s.n and len(ask):
            i, ok = self._found(s, owner[ask], fingers[ask], FINGER)
            codes[ask[ok]] = self.codes[i[ok]]
            pair = np.full(len(fingers), -1, dtype=np.int64)
            pair[ask[ok]] = i[ok]
            self._thirds(pair, n_third, thirds, discount, third_mass, third_codes)
        return counts, mass, codes, third_mass, third_codes

    @staticmethod
    def _found(s: Sequence, owner: np.ndarray, fingers: np.ndarray, bits: int):
        """Places of (owner, finger) in a level, and which of them are there."""
        key = (owner.astype(U64) << U64(bits)) | fingers
        i = s.successor(key)
        ok = i < s.n
        ok[ok] = s.get(i[ok]) == key[ok]
        return i, ok

    def _thirds(self, pair: np.ndarray, n_third: np.ndarray, thirds: np.ndarray, discount: float, mass: np.ndarray, codes: np.ndarray) -> None:
        """Fill in level 3 for pairs at these places (-1: not kept)."""
        s = self.parts["thirds"]
        asked = np.flatnonzero((pair >= 0) & (n_third > 0))
        if not s.n or not len(asked):
            return
        if self.third_mass_at is None:
            self.third_mass_at = np.r_[0.0, np.cumsum(np.maximum(CODES[self.third_codes] - discount, 0.0))]
        edge = lambda p: s.successor(p.astype(U64) << U64(THIRD))
        mass[asked] = self.third_mass_at[edge(pair[asked] + 1)] - self.third_mass_at[edge(pair[asked])]
        owner = np.repeat(pair, n_third)
        ask = np.flatnonzero(owner >= 0)
        i, ok = self._found(s, owner[ask], thirds[ask], THIRD)
        codes[ask[ok]] = self.third_codes[i[ok]]
