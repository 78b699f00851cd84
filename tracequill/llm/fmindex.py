"""A full-text index in minute space over word symbols: suffix order, wavelet ranks, sampled positions.

The text is an array of symbols in which 0 ends a run; runs are told apart by their
place, so no match crosses an end. ``search`` narrows the row ranges of all patterns
together, one symbol back at a time; ``locate`` walks back from a row to a sampled position.
"""

from __future__ import annotations

import numpy as np

#: Every RATE-th position, and the first of every run, keeps its place in the index.
RATE = 16


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order. ``symbols`` ends with 0; ends count as different symbols, by place.

    Keys of as many symbols as fit 62 bits are sorted, then only ties, by the ranks of twice as many each time.
    """
    n = len(symbols)
    ends = symbols == 0
    n_ends = int(ends.sum())
    own = np.where(ends, np.cumsum(ends) - 1, symbols.astype(np.int64) + (n_ends - 1))
    bits = int(own.max()).bit_length() if n else 1
    depth = max(1, 62 // max(1, bits))
    key = own.copy()
    for j in range(1, min(depth, n)):
        key <<= bits
        key[: n - j] |= own[j:]
    order = np.argsort(key)
    key = key[order]
    fresh = np.concatenate([[True], key[1:] != key[:-1]]) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rows = np.flatnonzero(~(fresh & np.concatenate([fresh[1:], [True]]))) if n else np.zeros(0, np.int64)
    while len(rows):
        at = order[rows]
        key = rank[at] << 31 | rank[np.minimum(at + depth, n - 1)]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[rows] = at
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = rows[np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), 0))]
        rows = rows[~(fresh & np.concatenate([fresh[1:], [True]]))]
        depth *= 2
    return order


class Bits:
    """A bit vector with constant-time counts of the ones before a place."""

    def __init__(self, flags: np.ndarray) -> None:
        padded = np.zeros((len(flags) // 64 + 1) * 64, bool)
        padded[: len(flags)] = flags
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts
        self.total = int(counts.sum())

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletTree:
    """Ranks of any symbol by one bit vector a binary digit, highest first; zeros of a level stand before its ones."""

    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        self.levels = []
        self.n = len(symbols)
        for bit in reversed(range(max(1, int(n_symbols - 1).bit_length()))):
            flags = (symbols >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(flags), len(symbols) - int(flags.sum())))
            symbols = np.concatenate([symbols[~flags], symbols[flags]])
        every = np.arange(n_symbols)
        self.first = self._down(every, np.zeros(n_symbols, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, own, zeros in self.levels:
            ones = own.rank(at)
            at = np.where(symbols >> bit & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each of ``symbols`` stands before its place in ``at``."""
        return self._down(symbols, at) - self.first[symbols]

    def at(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before it."""
        symbols = np.zeros(len(at), np.int64)
        for bit, own, zeros in self.levels:
            one, ones = own.get(at), own.rank(at)
            symbols |= one.astype(np.int64) << bit
            at = np.where(one, zeros + ones, at - ones)
        return symbols, at - self.first[symbols]


class FMIndex:
    def __init__(self, symbols: np.ndarray, n_symbols: int, rate: int = RATE) -> None:
        order = suffix_order(symbols)
        before = symbols[order - 1]
        marked = (before == 0) | (order % rate == 0)
        self.marks, self.samples = Bits(marked), order[marked]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols))])
        self.tree = WaveletTree(before, n_symbols)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and end of the rows of every pattern (a row of ``patterns``, filled with 0 in front)."""
        lo, hi = self.starts[patterns[:, -1]].copy(), self.starts[patterns[:, -1] + 1].copy()
        live = np.flatnonzero(lo < hi)
        for j in reversed(range(patterns.shape[1] - 1)):
            live = live[(patterns[live, j] > 0) & (lo[live] < hi[live])]
            if not len(live):
                break
            c = patterns[live, j]
            for side in (lo, hi):
                side[live] = self.starts[c] + self.tree.rank(c, side[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of index rows."""
        found = np.empty(len(rows), np.int64)
        left, steps = np.arange(len(rows)), 0
        while len(left):
            known = self.marks.get(rows)
            found[left[known]] = self.samples[self.marks.rank(rows[known])] + steps
            left, rows, steps = left[~known], rows[~known], steps + 1
            symbols, ranks = self.tree.at(rows)
            rows = self.starts[symbols] + ranks
        return found
