"""Gradient-boosted trees for two classes, on binned features, in numpy.

For a bounded sample on the driver; the fitted trees are a few arrays that are applied to batches in tasks.
"""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """``rounds`` trees of ``depth`` levels, each fitted to the gradient of the logistic loss of those before it."""

    def __init__(self, rounds: int = 50, depth: int = 4, rate: float = 0.3, ridge: float = 1.0, least: float = 4.0):
        self.rounds, self.depth, self.rate, self.ridge, self.least = rounds, depth, rate, ridge, least
        self.base, self.feature, self.cut, self.value = 0.0, None, None, None

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n = len(x)
        varied = np.flatnonzero((x != x[:1]).any(0)) if n else np.zeros(0, np.int64)      # the others split nothing
        x = x[:, varied]
        k = len(varied)
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="higher")) if n else np.zeros(0) for j in range(k)]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1) if k else np.zeros((n, 0), int)
        share = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        inner = (1 << self.depth) - 1
        self.feature = np.zeros((self.rounds, inner), np.int64)
        self.cut = np.full((self.rounds, inner), np.inf)
        self.value = np.zeros((self.rounds, inner + 1))
        score = np.full(n, self.base)
        flat = (binned + np.arange(k) * BINS).astype(np.int64)
        for t in range(self.rounds if k else 0):
            p = 1 / (1 + np.exp(-score))
            grad, hess = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, wide = (1 << level) - 1, 1 << level
                size = wide * k * BINS
                at = ((node - first)[:, None] * (k * BINS) + flat).ravel()
                g = np.bincount(at, np.repeat(grad, k), size).reshape(wide, k, BINS)
                h = np.bincount(at, np.repeat(hess, k), size).reshape(wide, k, BINS)
                left_g, left_h = g.cumsum(2)[:, :, :-1], h.cumsum(2)[:, :, :-1]
                all_g, all_h = g.sum(2, keepdims=True), h.sum(2, keepdims=True)
                gain = left_g ** 2 / (left_h + self.ridge) + (all_g - left_g) ** 2 / (all_h - left_h + self.ridge) - all_g ** 2 / (all_h + self.ridge)
                gain[(left_h < self.least / 4) | (all_h - left_h < self.least / 4)] = 0
                best = gain.reshape(wide, -1).argmax(1)
                useful = gain.reshape(wide, -1).max(1) > 1e-9
                f, b = best // (BINS - 1), best % (BINS - 1)
                for w in range(wide):
                    if useful[w] and b[w] < len(edges[f[w]]):
                        self.feature[t, first + w], self.cut[t, first + w] = f[w], edges[f[w]][b[w]]
                node = 2 * node + 1 + (x[np.arange(n), self.feature[t, node]] > self.cut[t, node])
            leaf = node - inner
            g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
            self.value[t] = -self.rate * g / (h + self.ridge)
            score += self.value[t, leaf]
        self.feature = varied[self.feature] if k else self.feature      # columns as they are given to ``raw``
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        """The log-odds of class 1."""
        inner, rows = self.feature.shape[1], np.arange(len(x))
        score = np.full(len(x), self.base)
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            score += value[node - inner]
        return score
