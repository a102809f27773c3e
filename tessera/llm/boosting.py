"""Gradient-boosted trees of fixed depth for a few classes (softmax loss, histogram splits)."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, classes: int, rounds: int = 25, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0):
        self.classes, self.rounds, self.depth, self.rate, self.bins, self.ridge = classes, rounds, depth, rate, bins, ridge
        self.trees: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1)
        score = np.zeros((len(x), self.classes))
        hot = np.eye(self.classes)[y]
        for _ in range(self.rounds):
            e = np.exp(score - score.max(1, keepdims=True))
            p = e / e.sum(1, keepdims=True)
            trees = []
            for k in range(self.classes):
                tree = self._grow(binned, cuts, p[:, k] - hot[:, k], p[:, k] * (1 - p[:, k]))
                score[:, k] += self._leaf(tree, x)
                trees.append(tree)
            self.trees.append(trees)
        return self

    def _grow(self, binned, cuts, g, h):
        inner = (1 << self.depth) - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(g), np.int64)
        for level in range(self.depth):
            base, count = (1 << level) - 1, 1 << level
            best = np.full(count, 1e-9)
            for f in range(binned.shape[1]):
                if not len(cuts[f]):
                    continue
                key = (node - base) * (self.bins + 1) + binned[:, f]
                size = count * (self.bins + 1)
                gs, hs = (np.cumsum(np.bincount(key, v, size).reshape(count, -1), 1) for v in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                gain = gain[:, : len(cuts[f])]
                at = gain.argmax(1)
                top = gain[np.arange(count), at]
                better = top > best
                best[better] = top[better]
                feature[base + np.flatnonzero(better)] = f
                cut[base + np.flatnonzero(better)] = cuts[f][at[better]]
            go = np.array([binned[:, f] for f in range(binned.shape[1])])[feature[node], np.arange(len(node))]
            limit = np.array([np.searchsorted(cuts[feature[j]], cut[j], "left") if np.isfinite(cut[j]) else self.bins + 1 for j in range(inner)])
            node = 2 * node + 1 + (go > limit[node])
        leaf = node - inner
        value = -np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.ridge) * self.rate
        return feature, cut, value

    def _leaf(self, tree, x):
        feature, cut, value = tree
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        return value[node - len(feature)]

    def log_proba(self, x: np.ndarray) -> np.ndarray:
        score = np.zeros((len(x), self.classes))
        for trees in self.trees:
            for k, tree in enumerate(trees):
                score[:, k] += self._leaf(tree, x)
        score -= score.max(1, keepdims=True)
        return score - np.log(np.exp(score).sum(1, keepdims=True))
