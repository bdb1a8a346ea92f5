"""Balanced parentheses of an ordinal tree, with range min-max excess blocks (numpy).

A node is an opening bit (1) and the closing bit (0) that matches it; its subtree is what
stands between.  Bits are cut into blocks of ``BLOCK``; each keeps its excess (ones less
zeros) and the least excess within, and a binary tree over the blocks keeps the least excess
of each range, so a matching parenthesis is found in a logarithmic number of steps.
"""

from __future__ import annotations

import numpy as np

BLOCK = 256


class Parentheses:
    def __init__(self, bits: np.ndarray):
        self.bits = np.asarray(bits, dtype=np.uint8)
        n = len(self.bits)
        self.ones = np.concatenate(([0], np.cumsum(self.bits, dtype=np.int64)))          # rank of openings
        leaf = np.zeros(n + 1, dtype=np.int64)
        if n:
            leaf[1:n] = np.cumsum((self.bits[:-1] == 1) & (self.bits[1:] == 0))
            leaf[n] = leaf[n - 1]
        self.leaf = leaf                                                                 # rank of leaf pairs
        self.excess = 2 * self.ones - np.arange(n + 1)
        blocks = max(1, -(-n // BLOCK))
        self.leaves = 1 << (blocks - 1).bit_length()
        # least excess after any bit of the block; absolute, so ranges combine by minimum alone
        low = np.full(2 * self.leaves, n + 1, dtype=np.int64)
        if n:
            low[self.leaves:self.leaves + blocks] = np.minimum.reduceat(self.excess[1:], np.arange(0, n, BLOCK))
        for k in range(self.leaves - 1, 0, -1):
            low[k] = min(low[2 * k], low[2 * k + 1])
        self.low = low

    def find_close(self, at: int) -> int:
        """The place of the parenthesis that closes the one opened at ``at``."""
        target = self.excess[at]                 # the excess before it is met again after its closing
        block = at // BLOCK
        end = min(len(self.bits), (block + 1) * BLOCK)
        here = np.flatnonzero(self.excess[at + 1:end + 1] <= target)
        if len(here):
            return at + int(here[0])
        k = block + self.leaves
        while k & 1 or self.low[k + 1] > target:           # up to a range to the right that goes low enough
            k >>= 1
        k += 1
        while k < self.leaves:                             # down to its first block
            k = 2 * k if self.low[2 * k] <= target else 2 * k + 1
        start = (k - self.leaves) * BLOCK
        here = np.flatnonzero(self.excess[start + 1:start + BLOCK + 1] <= target)
        return start + int(here[0])

    def subtree(self, at: int) -> tuple[int, int, int]:
        """Of the node opened at ``at``: its number and the number after its subtree, in the order of
        openings, and the number of leaf pairs in it."""
        close = self.find_close(at)
        return int(self.ones[at]), int(self.ones[close]), int(self.leaf[close + 1] - self.leaf[at])
