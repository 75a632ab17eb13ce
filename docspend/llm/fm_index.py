"""An FM-index over the symbols of one shard: wavelet ranks, backward search of many patterns at once, sampled places."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The order of all suffixes of text, by prefix doubling.  text ends in 0; each 0 is a symbol of its own, smaller than the next 0 and all others."""
    m = len(text)
    ends = np.flatnonzero(text == 0)
    key = text.astype(np.int64) + len(ends)
    key[ends] = np.arange(len(ends))
    order = np.argsort(key, kind="stable")
    fresh = np.append(True, key[order][1:] != key[order][:-1])
    head = np.flatnonzero(fresh)
    size = np.diff(np.append(head, m))
    rank = np.empty(m, np.int64)
    rank[order] = np.repeat(head, size)
    at = np.flatnonzero(np.repeat(size, size) > 1)  # places of suffixes that still agree with another
    h = 1
    while len(at):
        i = order[at]
        # no 0 is among the first h symbols of suffixes that agree, so i + h is in the text
        key = rank[i] * m + rank[i + h]
        turn = np.argsort(key, kind="stable")
        i, key = i[turn], key[turn]
        order[at] = i
        fresh = np.append(True, key[1:] != key[:-1])
        head = np.flatnonzero(fresh)
        size = np.diff(np.append(head, len(i)))
        rank[i] = np.repeat(at[head], size)
        at = at[np.repeat(size, size) > 1]
        h *= 2
    return order


class Wavelet:
    """A wavelet tree in level order: how often a symbol stands before a place."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.bits = max(1, int(largest).bit_length())
        self.ones: list[np.ndarray] = []  # directory of each level: ones before each place
        self.zeros: list[int] = []
        now = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = (now >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(len(now) - int(self.ones[-1][-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def mapped(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where place stands among the symbols of the last level; differences of two are ranks."""
        for k, ones in enumerate(self.ones):
            before = ones[place]
            place = np.where((symbol >> (self.bits - 1 - k)) & 1, self.zeros[k] + before, place - before)
        return place


class FMIndex:
    """text: symbols from 1, and 0 as the end of every stretch, the last one too."""

    def __init__(self, text: np.ndarray, sample: int = 8):
        m, largest = len(text), int(text.max(initial=0))
        order = suffix_array(text)
        self.last = text[order - 1]  # the symbol before each suffix
        self.tree = Wavelet(self.last, largest)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=largest + 1))])
        self.zero = self.tree.mapped(np.arange(largest + 1), np.zeros(largest + 1, np.int64))
        self.size, self.largest = m, largest
        # places are kept for every sample-th symbol and for the first of each stretch, which no step back may leave
        kept = (order % sample == 0) | (self.last == 0)
        self.kept, self.nth, self.places = kept, np.cumsum(kept) - 1, order[kept]

    def back(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The suffixes before place, each with this symbol put before it."""
        return self.first[symbol] + self.tree.mapped(symbol, place) - self.zero[symbol]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each pattern (rows of symbols, filled up at the end)."""
        lo, hi = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.size)
        for step in range(int(lengths.max(initial=0))):
            rows = np.flatnonzero((lengths > step) & (lo < hi))
            symbol = patterns[rows, lengths[rows] - 1 - step]
            known = symbol <= self.largest
            hi[rows[~known]] = lo[rows[~known]]
            rows, symbol = rows[known], symbol[known]
            lo[rows], hi[rows] = self.back(symbol, lo[rows]), self.back(symbol, hi[rows])
        return lo, hi

    def locate(self, suffixes: np.ndarray) -> np.ndarray:
        """Where these suffixes begin in the text."""
        suffixes, steps = suffixes.copy(), np.zeros(len(suffixes), np.int64)
        rows = np.flatnonzero(~self.kept[suffixes])
        while len(rows):
            now = suffixes[rows]
            suffixes[rows] = self.back(self.last[now], now)
            steps[rows] += 1
            rows = rows[~self.kept[suffixes[rows]]]
        return self.places[self.nth[suffixes]] + steps
