"""An FM-index over a sequence of small integers, searched for many patterns at once.

The Burrows-Wheeler transform is kept in a wavelet matrix with running counts,
so a step of backward search is a few array look-ups for all patterns together.
Suffix positions are sampled; an occurrence walks back to the next sample.
Symbol 0 separates runs: no pattern has it, and each is a symbol of its own in
the order of suffixes, so sorting ends within the longest run.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling the compared length until all differ."""
    n = len(text)
    zero = text == 0
    rank = np.where(zero, np.cumsum(zero) - 1, text.astype(np.int64) + np.count_nonzero(zero))
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = rank[width:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + after
        order = np.argsort(key, kind="stable")
        step = np.zeros(n, np.int64)
        step[1:] = np.cumsum(key[order[1:]] != key[order[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = step
        width *= 2
        if not n or step[-1] == n - 1 or width > 2 * n:
            return order


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits = bits
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        now = symbols
        for b in range(bits - 1, -1, -1):
            bit = (now >> b) & 1
            ones = np.zeros(len(now) + 1, np.int64)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(now) - int(ones[-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        start = np.zeros_like(at)
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            up = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            a, s = ones[at], ones[start]
            at, start = np.where(up, zeros + a, at - a), np.where(up, zeros + s, start - s)
        return at - start


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int):
        """``text`` of integers from 0 to ``symbols`` - 1."""
        text = np.concatenate([text, [0]]).astype(np.int64)
        order = suffix_order(text)
        before = text[order - 1]
        self.n, self.bwt = len(text), before
        self.tree = WaveletMatrix(before, max(1, int(symbols - 1).bit_length()))
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        sampled = order % SAMPLE == 0
        sampled |= before == 0  # the first of a run: walks end there
        self.sampled, self.position = sampled, np.where(sampled, order, -1)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each pattern (row, right-padded), by backward search."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            some = np.flatnonzero((j < lengths) & (low < high))
            if len(some):
                c = patterns[some, j].astype(np.int64)
                low[some] = self.less[c] + self.tree.rank(c, low[some])
                high[some] = self.less[c] + self.tree.rank(c, high[some])
        return low, high

    def locate(self, suffix: np.ndarray) -> np.ndarray:
        """Where these suffixes begin."""
        at, steps = suffix.copy(), np.zeros(len(suffix), np.int64)
        walking = np.flatnonzero(~self.sampled[at])
        while len(walking):
            c = self.bwt[at[walking]]
            at[walking] = self.less[c] + self.tree.rank(c, at[walking])
            steps[walking] += 1
            walking = walking[~self.sampled[at[walking]]]
        return self.position[at] + steps
