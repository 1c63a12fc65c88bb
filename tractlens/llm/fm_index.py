"""FM-index over a sequence of integer symbols: suffix array, wavelet matrix, sampled positions.

Symbols are 1..sigma; 0 separates stretches, and the sequence ends with 0.  Every
separator ranks on its own, so that no suffix comparison and no walk crosses one.
"""

from __future__ import annotations

import numpy as np

from tractlens.llm.common import spans


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; each round sorts only suffixes that still tie."""
    n = len(text)
    cuts = text == 0
    key = np.where(cuts, np.cumsum(cuts) - 1, int(cuts.sum()) + text.astype(np.int64))
    sa = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    rank[sa], tied = _ranks(key[sa], np.zeros(n, np.int64))
    active = sa[tied]
    k = 1
    while len(active):
        # A tied suffix has k symbols without a separator, so position + k exists.
        first, second = rank[active], rank[active + k]
        order = np.lexsort((second, first))
        active, first, second = active[order], first[order], second[order]
        group = np.flatnonzero(np.diff(first, prepend=-1))
        base = np.repeat(first[group] - group, np.diff(group, append=len(first)))
        new, tied = _ranks(first * n + second, base)
        rank[active] = new
        active = active[tied]
        k *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def _ranks(key: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of sorted keys: where their run begins plus ``base``, which of them tie)."""
    starts = np.diff(key, prepend=key[:1] - 1) != 0
    at = np.flatnonzero(starts)
    length = np.diff(at, append=len(key))
    return np.repeat(at, length) + base, np.repeat(length > 1, length)


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int, sample_rate: int = 16):
        n = len(text)
        sa = suffix_array(text)
        bwt = text[sa - 1]
        counts = np.bincount(text, minlength=sigma + 2)
        self.n, self.before = n, np.cumsum(counts) - counts
        sampled = (sa % sample_rate == 0) | (bwt == 0)
        self.sampled, self.sample_rank, self.samples = sampled, np.cumsum(sampled) - sampled, sa[sampled]
        self.ones, self.zeros, self.levels = [], [], max(1, int(sigma).bit_length())
        seq = bwt.astype(np.int32)
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level) & 1 == 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(n - int(bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the first i places of the transform."""
        start = np.zeros_like(i)
        for d, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (symbol >> (self.levels - 1 - d)) & 1 == 1
            a, b = ones[start], ones[i]
            start, i = np.where(bit, zeros + a, start - a), np.where(bit, zeros + b, i - b)
        return i - start

    def step_back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix one symbol longer (its symbol is read from the wavelet matrix)."""
        symbol, start, i = np.zeros_like(row), np.zeros_like(row), row
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[i + 1] > ones[i]
            a, b = ones[start], ones[i]
            start, i = np.where(bit, zeros + a, start - a), np.where(bit, zeros + b, i - b)
            symbol = 2 * symbol + bit
        return self.before[symbol] + i - start

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of patterns, given right-aligned and padded on the left."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1] if len(patterns) else 0
        alive = np.arange(len(patterns))
        for j in range(width):
            alive = alive[(lengths[alive] > j) & (high[alive] > low[alive])]
            if not len(alive):
                break
            c = patterns[alive, width - 1 - j].astype(np.int64)
            low[alive] = self.before[c] + self.rank(c, low[alive])
            high[alive] = self.before[c] + self.rank(c, high[alive])
        return low, high

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern number, position) of every occurrence."""
        n = np.maximum(high - low, 0)
        row, which = spans(low, n), np.repeat(np.arange(len(low)), n)
        at, todo, steps = np.zeros(len(row), np.int64), np.arange(len(row)), 0
        while len(todo):
            done = self.sampled[row[todo]]
            at[todo[done]] = self.samples[self.sample_rank[row[todo[done]]]] + steps
            todo = todo[~done]
            row[todo] = self.step_back(row[todo])
            steps += 1
        return which, at
