"""Ball trees over a chunk of vectors, and their search for many anchors at once.

A node is a run of rows with its mean and the largest distance from it; its children are the halves of the run along the
coordinate that spreads most, or the sides of a change of label. For an anchor q the inner products below a node lie
within q·mean ± |q|·radius. A node is left out if that range misses all score windows of the anchor, or if its upper end
is strictly below the score that the window's last place has already. Everything is done level by level with numpy.
"""

from __future__ import annotations

import numpy as np

LEAF = 64
#: Anchors that are searched together.
AT_ONCE = 256


class Tree:
    """``vectors`` (rows by coordinates, whole numbers), ``label`` by row; the rows may come in any order."""

    def __init__(self, vectors: np.ndarray, label: np.ndarray):
        order = np.argsort(label, kind="stable")
        x, label = vectors[order].astype(np.float64), label[order]
        #: by level: first row, end, mean, radius, whether all labels are equal, label, first child (or -1)
        self.levels: list[tuple[np.ndarray, ...]] = []
        runs = [(0, len(x))] if len(x) else []
        while runs:
            means, radii, children, below = [], [], [], []
            for lo, hi in runs:
                part = x[lo:hi]
                mean = part.mean(axis=0)
                means.append(mean)
                radii.append(np.sqrt(((part - mean) ** 2).sum(axis=1).max()))
                if hi - lo <= LEAF:
                    children.append(-1)
                    continue
                if label[lo] != label[hi - 1]:  # rows are by label: cut at the change nearest to the middle
                    cuts = lo + 1 + np.flatnonzero(label[lo + 1 : hi] != label[lo : hi - 1])
                    mid = int(cuts[np.argmin(np.abs(cuts - (lo + hi) // 2))])
                else:
                    mid = (lo + hi) // 2
                    by = np.argpartition(part[:, int(part.var(axis=0).argmax())], mid - lo)
                    x[lo:hi], order[lo:hi] = part[by], order[lo:hi][by]
                children.append(len(below))
                below += [(lo, mid), (mid, hi)]
            lo, hi = np.array(runs).T
            self.levels.append((lo, hi, np.array(means), np.array(radii), label[lo] == label[hi - 1], label[lo], np.array(children)))
            runs = below
        self.x, self.label, self.order = x, label, order

    def leaves(self, q: np.ndarray, q_label: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray):
        """(first row, end, anchors) of each leaf that anchors have to look at; ``low``, ``high``: anchors by windows."""
        norm = np.sqrt((q**2).sum(axis=1))
        alive = np.ones((len(q), 1), dtype=bool)
        for lo, hi, mean, radius, pure, label, child in self.levels:
            middle = q @ mean.T
            # rounding of the bounds must not leave out a row at the very end of the range
            reach = norm[:, None] * radius * (1 + 1e-9) + 1e-6 * (1 + np.abs(middle))
            may = np.zeros_like(alive)
            for w in range(low.shape[1]):
                may |= (middle + reach >= low[:, w, None]) & (middle - reach <= high[:, w, None])
            equal = q_label[:, None] == label
            alive &= may & (~pure | equal if same else ~(pure & equal))
            for i in np.flatnonzero((child < 0) & alive.any(axis=0)):
                yield lo[i], hi[i], np.flatnonzero(alive[:, i])
            inner = np.flatnonzero(child >= 0)
            alive = np.repeat(alive[:, inner], 2, axis=1)


class Best:
    """The best ``k`` rows for each anchor and window; higher scores first, ties by smaller id."""

    def __init__(self, q: np.ndarray, label: np.ndarray, own: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int):
        """``own``: the anchors' row numbers, which are left out; ``low``, ``high``: anchors by windows, ends included."""
        self.q, self.label, self.own, self.same, self.k = q.astype(np.float64), label, own, same, k
        self.low, self.high = low.astype(np.float64), high.astype(np.float64)
        self.found = [np.zeros((0, 4), dtype=np.int64) for _ in range(low.shape[1])]  # anchor, score, id, row; sorted
        self.least = self.low.copy()

    def look(self, vectors: np.ndarray, label: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        tree = Tree(vectors, label)
        ids, rows = ids[tree.order], rows[tree.order]
        exact = self._exact(tree.x)
        for at in range(0, len(self.q), AT_ONCE):
            to = min(at + AT_ONCE, len(self.q))
            q, least, high = self.q[at:to], self.least[at:to], self.high[at:to]
            score = np.full((to - at, len(rows)), -np.inf)
            for lo, hi, anchors in tree.leaves(q, self.label[at:to], self.same, least, high):
                score[anchors, lo:hi] = q[anchors] @ tree.x[lo:hi].T if exact else self._whole(q[anchors], tree.x[lo:hi])
            equal = self.label[at:to, None] == tree.label
            score[(~equal if self.same else equal) | (self.own[at:to, None] == rows)] = -np.inf
            for w in range(self.low.shape[1]):
                a, j = np.nonzero((score >= least[:, w, None]) & (score <= high[:, w, None]) & (score > -np.inf))
                if len(a):
                    self._merge(w, np.stack([a + at, score[a, j].astype(np.int64), ids[j], rows[j]], axis=1))

    def _exact(self, x: np.ndarray) -> bool:
        """Whether sums of products stay where doubles are whole numbers."""
        most = lambda v: np.abs(v).max(initial=0.0)
        return most(x) * most(self.q) * max(1, x.shape[1]) < 2.0**53

    @staticmethod
    def _whole(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        return (q.astype(np.int64) @ x.astype(np.int64).T).astype(np.float64)

    def _merge(self, w: int, new: np.ndarray) -> None:
        touched = np.unique(new[:, 0])
        held = self.found[w]
        again = np.isin(held[:, 0], touched)
        every = np.concatenate([held[again], new])
        every = every[np.lexsort((every[:, 3], every[:, 2], -every[:, 1], every[:, 0]))]
        first = np.flatnonzero(np.r_[True, every[1:, 0] != every[:-1, 0]])
        size = np.diff(np.r_[first, len(every)])
        place = np.arange(len(every)) - np.repeat(first, size)
        kept = every[place < self.k]
        full = first[size >= self.k] + self.k - 1
        self.least[every[full, 0], w] = np.maximum(self.low[every[full, 0], w], every[full, 1])
        self.found[w] = np.concatenate([held[~again], kept])
