"""FM-index over integer symbols: backward search by wavelet ranks, positions from sampled suffixes.

The text is a sequence of runs of symbols 1, 2, ...; symbol 0 ends each run. Run ends are distinct and ordered by
position, so suffixes never compare beyond their run and every suffix has a rank of its own. Searches take many phrases
at once: a step prepends one symbol to every phrase still alive, with two ranks each.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Ranks and access over a sequence, a bit vector with block counts for each bit of a symbol, highest first."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels, self.n = max(1, int(largest).bit_length()), len(symbols)
        self.words, self.counts, self.zeros = [], [], []
        self.first = np.zeros(largest + 2, np.int64)  # where each symbol's block starts below the last level
        now = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(self.n // 64 + 1, np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
            self.zeros.append(self.n - int(bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])
        if self.n:
            starts = np.flatnonzero(np.r_[True, now[1:] != now[:-1]])
            self.first[now[starts]] = starts

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        inside = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][at >> 6] + np.bitwise_count(self.words[level][at >> 6] & inside)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position. Every symbol must occur somewhere."""
        at = at.copy()
        for i in range(self.levels):
            ones = self._ones(i, at)
            set_ = (symbol >> (self.levels - 1 - i) & 1).astype(bool)
            at = np.where(set_, self.zeros[i] + ones, at - ones)
        return at - self.first[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it occurs before."""
        at, symbol = at.copy(), np.zeros(len(at), np.int64)
        for i in range(self.levels):
            set_ = (self.words[i][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ones = self._ones(i, at)
            at = np.where(set_, self.zeros[i] + ones, at - ones)
            symbol = symbol << 1 | set_
        return symbol, at - self.first[symbol]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of ``text`` (runs ended by 0) in the order of their suffixes, by prefix doubling: a round orders only
    the suffixes that are not alone in their rank, by the rank of what follows the part they share."""
    n = len(text)
    ends = np.flatnonzero(text == 0)
    keys = text.astype(np.int64) + len(ends)
    keys[ends] = np.arange(len(ends))  # run ends are alone from the start
    order = np.argsort(keys, kind="stable")
    new = np.r_[True, keys[order][1:] != keys[order][:-1]] if n else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    rank = np.empty(n, np.int64)
    rank[order] = first
    shared = 1
    slots = np.flatnonzero(~(new & np.r_[new[1:], True])) if n else first
    while len(slots):
        rows = order[slots]
        # what follows lies in the same run: a suffix that shares ``shared`` symbols with another has no run end in them
        follow = rank[rows + shared]
        by = np.lexsort((follow, rank[rows]))
        rows, follow, group = rows[by], follow[by], rank[rows][by]
        order[slots] = rows
        new = np.r_[True, (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])]
        rank[rows] = np.maximum.accumulate(np.where(new, slots, 0))
        slots = slots[~(new & np.r_[new[1:], True])]
        shared *= 2
    return order


class FMIndex:
    """Index of ``text``: symbols 1 to ``largest``, each run ended by a 0."""

    def __init__(self, text: np.ndarray, largest: int, sample: int = 16):
        self.n = len(text)
        order = suffix_order(text)
        before = text[order - 1]  # position 0 is preceded by the last run end
        self.wavelet = WaveletMatrix(before, largest)
        counts = np.bincount(text, minlength=largest + 1)
        self.count, self.start = counts, np.concatenate([[0], np.cumsum(counts)])
        # walks go backwards within a run, so its first position is a sample as well as every ``sample``-th one
        kept = (order % sample == 0) | (before == 0)
        self.kept, self.kept_before = kept, np.concatenate([[0], np.cumsum(kept)])
        self.positions = order[kept]

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[low, high) of the suffixes that start with each row of ``phrases`` (equal lengths, symbols from 1)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for step in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, step]
            known = self.count[symbol] > 0
            high[alive[~known]] = low[alive[~known]]
            alive, symbol = alive[known], symbol[known]
            found = self.start[np.r_[symbol, symbol]] + self.wavelet.rank(np.r_[symbol, symbol], np.r_[low[alive], high[alive]])
            low[alive], high[alive] = found[:len(alive)], found[len(alive):]
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix row: steps back to a sampled suffix, and their number added."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            done = self.kept[at[todo]]
            ready = todo[done]
            out[ready] = self.positions[self.kept_before[at[ready]]] + steps[ready]
            todo = todo[~done]
            symbol, rank = self.wavelet.access(at[todo])
            at[todo] = self.start[symbol] + rank
            steps[todo] += 1
        return out
