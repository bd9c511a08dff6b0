"""FM-index over a sequence of small integers, for many phrases at a time."""

from __future__ import annotations

import numpy as np

from listweave.llm.common import ranges

SAMPLE = 8


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling the compared length. The last symbol is the smallest."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    rank = rank.astype(np.int64)
    width = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh_rank = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh_rank
        if fresh_rank[-1] == n - 1:
            return order
        width *= 2


class WaveletTree:
    """Ranks of symbols in a sequence, one level per bit.

    On each level all symbols are stably sorted by their bit, zeros before ones, so a node is a
    stretch of its level.
    """

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits = bits
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        level = symbols
        for shift in reversed(range(bits)):
            bit = (level >> shift) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(int(len(bit) - bit.sum()))
            level = np.concatenate([level[bit == 0], level[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position ``end``."""
        start = np.zeros_like(end)
        for depth, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = ((symbol >> (self.bits - 1 - depth)) & 1).astype(bool)
            ones_start, ones_end = ones[start], ones[end]
            start = np.where(bit, zeros + ones_start, start - ones_start)
            end = np.where(bit, zeros + ones_end, end - ones_end)
        return end - start

    def at(self, place: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(place), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            before = ones[place]
            bit = ones[place + 1] - before
            symbol = (symbol << 1) | bit
            place = np.where(bit == 1, zeros + before, place - before)
        return symbol


class FMIndex:
    """Index of ``symbols``, integers of 1 and more; zero ends the sequence."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE) -> None:
        text = np.concatenate([symbols.astype(np.int64), [0]])
        order = suffix_array(text)
        top = int(text.max())
        self.size = len(text)
        self.top = top
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.tree = WaveletTree(text[order - 1], max(1, top.bit_length()))
        sampled = order % sample == 0
        self.sampled_before = np.concatenate([[0], np.cumsum(sampled)])
        self.sampled_places = order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last+1 suffix of each phrase, read from its last symbol on.

        ``phrases`` has a row per phrase, filled to the right with anything.
        """
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size, np.int64)
        for step in range(phrases.shape[1] if len(phrases) else 0):
            live = np.flatnonzero((lengths > step) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, lengths[live] - 1 - step]
            known = symbol <= self.top
            high[live[~known]] = low[live[~known]]
            live, symbol = live[known], symbol[known]
            first = self.before[symbol]
            low[live] = first + self.tree.rank(symbol, low[live])
            high[live] = first + self.tree.rank(symbol, high[live])
        return low, high

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all suffixes in the ranges, and the number of the range of each.

        A suffix that is not sampled is followed to the one a symbol before it until one is.
        """
        counts = np.maximum(high - low, 0)
        owner = np.repeat(np.arange(len(low)), counts)
        suffix = ranges(low, counts)
        place = np.full(len(suffix), -1, np.int64)
        left = np.arange(len(suffix))
        steps = 0
        while len(left):
            at = suffix[left]
            known = self.sampled_before[at + 1] > self.sampled_before[at]
            place[left[known]] = self.sampled_places[self.sampled_before[at[known]]] + steps
            left, at = left[~known], at[~known]
            symbol = self.tree.at(at)
            suffix[left] = self.before[symbol] + self.tree.rank(symbol, at)
            steps += 1
        return place, owner
