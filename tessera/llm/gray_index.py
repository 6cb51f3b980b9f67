"""Hierarchical index over bit fingerprints in Gray order.

Fingerprints are sorted by their rank in the reflected Gray code, so that neighbours differ in few bits. Runs of
``FAN`` neighbours form a node, runs of nodes form a node above, up to one root for each group. A node keeps the bits on
which all below it agree (``mask``, ``pattern``); what a node's parent has settled is factored out of it. A query comes
down from the root, adds up the differences found so far, and leaves a node, with everything below it, as soon as they
exceed the radius. All groups of a batch are searched at once, level by level, with numpy.
"""

from __future__ import annotations

import numpy as np

FAN = 8
#: (query, node) pairs looked at together.
AT_ONCE = 1 << 18


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Rank in the reflected Gray code, of unsigned 64-bit integers."""
    x = x.copy()
    for by in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(by)
    return x


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int32)


class Index:
    """``prints``: n x words of uint64, sorted by group and, inside it, by Gray rank; ``group``: ascending numbers."""

    def __init__(self, prints: np.ndarray, group: np.ndarray):
        self.prints = prints
        n = len(prints)
        ones = np.uint64(0xFFFFFFFFFFFFFFFF)
        mask, pattern = np.full_like(prints, ones), prints
        #: from the leaves up: mask, pattern, first child and number of children; leaves are the prints themselves
        self.levels = []
        first = np.arange(n + 1)
        owner = group
        while True:
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, dtype=np.int64)
            if self.levels and len(starts) == len(owner):
                break
            place = np.arange(len(owner)) - np.repeat(starts, np.diff(np.r_[starts, len(owner)]))
            heads = np.flatnonzero(place % FAN == 0)
            all_ones = np.bitwise_and.reduceat(pattern, heads, axis=0)
            any_ones = np.bitwise_or.reduceat(pattern, heads, axis=0)
            settled = np.bitwise_and.reduceat(mask, heads, axis=0)
            up_mask = settled & ~(all_ones ^ any_ones)
            up_pattern = all_ones & up_mask
            ends = np.r_[heads[1:], len(owner)]
            # what the parent settles is not compared again below it
            parent = np.repeat(np.arange(len(heads)), ends - heads)
            self.levels.append({"mask": mask & ~up_mask[parent], "pattern": pattern, "first": heads, "n": ends - heads})
            mask, pattern, owner = up_mask, up_pattern, owner[heads]
            first = heads
        del first
        self.root_mask, self.root_pattern = mask, pattern
        self.root_of = np.searchsorted(owner, group)

    def within(self, radius: int):
        """Yields arrays (i, j), i < j: positions of prints of one group that differ in at most ``radius`` bits."""
        n = len(self.prints)
        step = 4096
        for at in range(0, n, step):
            q = np.arange(at, min(n, at + step))
            stack = [(len(self.levels), q, self.root_of[q], np.zeros(len(q), dtype=np.int32))]
            while stack:
                level, q, node, d = stack.pop()
                mask, pattern = (self.root_mask, self.root_pattern) if level == len(self.levels) else (self.levels[level]["mask"], self.levels[level]["pattern"])
                d = d + popcount((self.prints[q] ^ pattern[node]) & mask[node])
                near = d <= radius
                q, node, d = q[near], node[near], d[near]
                if level == 0:
                    later = node > q
                    if later.any():
                        yield q[later], node[later]
                    continue
                below = self.levels[level - 1]
                k = below["n"][node]
                total = np.cumsum(k)
                cuts = np.searchsorted(total, np.arange(AT_ONCE, (total[-1] if len(total) else 0) + AT_ONCE, AT_ONCE))
                lo = 0
                for hi in np.unique(np.minimum(cuts + 1, len(k))):
                    if hi > lo:
                        m = k[lo:hi]
                        inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                        child = np.repeat(below["first"][node[lo:hi]], m) + inner
                        stack.append((level - 1, np.repeat(q[lo:hi], m), child, np.repeat(d[lo:hi], m)))
                    lo = hi


def labels(n: int, pairs) -> np.ndarray:
    """For each of n nodes the smallest node of its component; ``pairs``: arrays (a, b) of edges, one after another."""
    lab = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = lab[a], lab[b]
            if (x == y).all():
                break
            low = np.minimum(x, y)
            np.minimum.at(lab, x, low)
            np.minimum.at(lab, y, low)
            while True:
                up = lab[lab]
                if (up == lab).all():
                    break
                lab = up
    return lab
