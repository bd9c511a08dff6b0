"""Context-tree weighting over bytes, from counts.

A byte is eight binary decisions. Each decision has a tree of contexts: the bytes before it, one
more per depth. A node with a zeros and b ones has the Krichevsky-Trofimov block probability, and
its weighted probability is half that plus half the product of its children's; at the full depth it
is the block probability alone. All of it follows from the counts of sequences of depth + 1 bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes of context, if no other number is given; with the byte itself and a bit for marks up to 6
#: fit in 64 bits.
DEPTH = 5
MOST_DEPTH = 6
BITS = 8
NODES = 1 << BITS
#: Stands before the first byte of a text and closes it; no UTF-8 text has it.
EDGE = 0xFF


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function for x > 0, by Stirling's series from 8 on."""
    x = np.asarray(x, np.float64)
    shift = np.ones_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift = np.where(low, shift * y, shift)
        y = np.where(low, y + 1, y)
    inverse = 1 / y
    square = inverse * inverse
    series = inverse * (
        1 / 12 - square * (1 / 360 - square * (1 / 1260 - square * (1 / 1680 - square / 1188)))
    )
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(shift)


def log_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return (
        log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(zeros + ones + 1)
    )


def weighted(block: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Log weighted probability of inner nodes from theirs and the sum of their children's logs."""
    return np.logaddexp(block, children) - np.log(2)


@dataclass
class Level:
    """Nodes of one depth, by sorted key: share of the node's own estimate, and that of a one."""

    keys: np.ndarray
    own: np.ndarray
    one: np.ndarray

    def at(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Share and estimate; nodes never seen have one half for both."""
        if not len(self.keys):
            return np.full(len(keys), 0.5), np.full(len(keys), 0.5)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[place] == keys
        return np.where(known, self.own[place], 0.5), np.where(known, self.one[place], 0.5)


def bit_nodes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol the eight decision nodes (1 … 255) on its way and the bits taken."""
    k = np.arange(BITS)
    node = (1 << k) | (symbols[:, None] >> (BITS - k))
    return node, (symbols[:, None] >> (BITS - 1 - k)) & 1


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    unique, place = np.unique(keys, return_inverse=True)
    return unique, *(np.bincount(place, v, minlength=len(unique)) for v in values)


def contexts(grams: np.ndarray, depth: int) -> np.ndarray:
    """The last ``depth`` bytes before the symbol of each gram (the symbol is its lowest byte)."""
    return (grams >> BITS) & ((1 << (BITS * depth)) - 1)


@dataclass
class Subtrees:
    """Nodes of the depths from ``top`` down, and what the nodes at ``top`` hand upwards."""

    levels: dict[int, Level]
    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    log_weighted: np.ndarray


def subtrees(
    grams: np.ndarray, counts: np.ndarray, top: int, full: int = DEPTH
) -> Subtrees:
    """Trees of all contexts of ``top`` bytes that occur, from all grams that end with them.

    A key is the context times 256 plus the decision node.
    """
    node, bit = bit_nodes(grams & (NODES - 1))
    times = np.repeat(counts[:, None], BITS, axis=1)
    keys = ((contexts(grams, full)[:, None] << BITS) | node).reshape(-1)
    ones = (times * bit).reshape(-1)
    keys, ones, total = _summed(keys, ones, times.reshape(-1))
    zeros = total - ones
    log_w = log_block(zeros, ones)
    levels = {full: Level(keys, np.ones(len(keys)), (ones + 0.5) / (zeros + ones + 1))}
    for depth in range(full - 1, top - 1, -1):
        mask = (1 << (BITS * (depth + 1))) - 1
        keys, zeros, ones, below = _summed(keys & mask, zeros, ones, log_w)
        block = log_block(zeros, ones)
        log_w = weighted(block, below)
        levels[depth] = Level(
            keys, np.exp(block - np.log(2) - log_w), (ones + 0.5) / (zeros + ones + 1)
        )
    return Subtrees(levels, keys, zeros, ones, log_w)


def log10_probabilities(grams: np.ndarray, levels: dict[int, Level]) -> np.ndarray:
    """Log10 probability of the last byte of each gram after the others, over all depths."""
    node, bit = bit_nodes(grams & (NODES - 1))
    one = np.full(node.size, 0.5)
    for depth in range(max(levels), -1, -1):
        own, estimate = levels[depth].at(
            ((contexts(grams, depth)[:, None] << BITS) | node).reshape(-1)
        )
        one = own * estimate + (1 - own) * one
    taken = np.where(bit.reshape(-1) == 1, one, 1 - one)
    return np.log10(taken).reshape(-1, BITS).sum(axis=1)
