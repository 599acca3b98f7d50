"""Gradient-boosted trees for two classes, on histograms of binned features."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Complete binary trees of one depth: feature and threshold of inner nodes, values of leaves. x > threshold goes right."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, base: float):
        self.feature, self.threshold, self.leaf, self.base = feature, threshold, leaf, base

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, ridge: float = 1.0) -> Boosted:
        """Logistic loss; each split takes the largest gain over all features and bins."""
        n, m = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        mean = float((y * weight).sum() / weight.sum())
        base = float(np.log(mean / (1 - mean)))
        score = np.full(n, base)
        inner = (1 << depth) - 1
        feature, threshold, leaf = np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
        for t in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (y - p), weight * p * (1 - p)
            at = np.zeros(n, np.int64)
            for level in range(depth):
                first, nodes = (1 << level) - 1, 1 << level
                best = np.full(nodes, 1e-9)
                split = np.zeros((nodes, 2), np.int64) - 1
                local = at - first
                total_g, total_h = np.bincount(local, g, nodes), np.bincount(local, h, nodes)
                for j in range(m):
                    size = len(edges[j]) + 1
                    if size < 2:
                        continue
                    key = local * size + binned[:, j]
                    lg = np.bincount(key, g, nodes * size).reshape(nodes, size).cumsum(axis=1)[:, :-1]
                    lh = np.bincount(key, h, nodes * size).reshape(nodes, size).cumsum(axis=1)[:, :-1]
                    rg, rh = total_g[:, None] - lg, total_h[:, None] - lh
                    gain = lg**2 / (lh + ridge) + rg**2 / (rh + ridge) - (total_g**2 / (total_h + ridge))[:, None]
                    gain[(lh < 1) | (rh < 1)] = 0
                    cut = gain.argmax(axis=1)
                    value = gain[np.arange(nodes), cut]
                    better = value > best
                    best[better] = value[better]
                    split[better] = np.stack([np.full(nodes, j), cut], axis=1)[better]
                for k in range(nodes):
                    if split[k, 0] >= 0:
                        feature[t, first + k], threshold[t, first + k] = split[k, 0], edges[split[k, 0]][split[k, 1]]
                at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > threshold[t, at])
            local = at - inner
            leaf[t] = rate * np.bincount(local, g, inner + 1) / (np.bincount(local, h, inner + 1) + ridge)
            score += leaf[t, local]
        return cls(feature, threshold, leaf, base)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The log odds."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while at.size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - inner]
        return out
