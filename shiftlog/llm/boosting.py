"""Gradient boosted trees for a bounded training sample, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Binary classifier: trees of fixed depth on logistic loss.

    A tree is complete: node ``i`` sends a row to ``2i + 1`` (value at most
    the cut) or ``2i + 2``.
    """

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        self.start, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        coded = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T)], 1)
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.start = np.log(share / (1 - share))
        raw = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(coded, cuts, p - y, np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            raw += self._leaf(tree, x)
        return self

    def _grow(self, coded, cuts, grad, hess):
        inner = 2 ** self.depth - 1
        feature, cut = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(len(grad), int)
        for i in range(inner):
            own = node == i
            best = 1e-3
            total_g, total_h = grad[own].sum(), hess[own].sum()
            for f, edges in enumerate(cuts):
                g = np.bincount(coded[own, f], grad[own], len(edges) + 1).cumsum()[:-1]
                h = np.bincount(coded[own, f], hess[own], len(edges) + 1).cumsum()[:-1]
                gain = (g ** 2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1)
                        - total_g ** 2 / (total_h + 1))
                if len(gain) and gain.max() > best:
                    best, feature[i] = gain.max(), f
                    cut[i] = edges[gain.argmax()]
            right = own & (coded[:, feature[i]] > np.searchsorted(cuts[feature[i]], cut[i]))
            node[own] = 2 * i + 1
            node[right] = 2 * i + 2
        leaf = node - inner
        g = np.bincount(leaf, grad, inner + 1)
        h = np.bincount(leaf, hess, inner + 1)
        return feature, cut, -self.rate * g / (h + 1)

    def _leaf(self, tree, x):
        feature, cut, value = tree
        node, rows = np.zeros(len(x), int), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        return value[node - len(cut)]

    def predict(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.start)
        for tree in self.trees:
            raw += self._leaf(tree, x)
        return 1 / (1 + np.exp(-raw))
