"""Gradient-boosted trees for a yes/no label, in numpy: histogram splits, complete trees of fixed depth."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, rounds: int = 80, depth: int = 5, rate: float = 0.15, bins: int = 48, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.feature = self.cut = self.leaf = None
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, m = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        mean = y.mean()
        self.base = float(np.log(mean / (1 - mean)))
        score = np.full(n, self.base)
        inner, leaves = 2**self.depth - 1, 2**self.depth
        self.feature = np.zeros((self.rounds, inner), dtype=np.int64)
        self.cut = np.full((self.rounds, inner), np.inf)
        self.leaf = np.zeros((self.rounds, leaves))
        for t in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, dtype=np.int64)
            for d in range(self.depth):
                width, first = 2**d, 2**d - 1
                gain = np.zeros((width, m))
                place = np.zeros((width, m), dtype=np.int64)
                for j in range(m):
                    size = len(edges[j]) + 1
                    at = node * size + code[:, j]
                    gs = np.bincount(at, weights=g, minlength=width * size).reshape(width, size).cumsum(axis=1)
                    hs = np.bincount(at, weights=h, minlength=width * size).reshape(width, size).cumsum(axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    won = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    won[:, -1] = 0
                    place[:, j] = won.argmax(axis=1)
                    gain[:, j] = won.max(axis=1)
                best = gain.argmax(axis=1)
                pick = place[np.arange(width), best]
                value = np.array([edges[f][b] if gain[k, f] > 1e-6 and b < len(edges[f]) else np.inf for k, (f, b) in enumerate(zip(best, pick))])
                self.feature[t, first : first + width], self.cut[t, first : first + width] = best, value
                node = node * 2 + (x[np.arange(n), best[node]] > value[node])
            gs, hs = np.bincount(node, weights=g, minlength=leaves), np.bincount(node, weights=h, minlength=leaves)
            self.leaf[t] = self.rate * gs / (hs + self.ridge)
            score += self.leaf[t][node]
        return self

    def decision(self, x: np.ndarray) -> np.ndarray:
        """Log odds of the label."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for d in range(self.depth):
                k = 2**d - 1 + node
                node = node * 2 + (x[rows, f[k]] > c[k])
            out += v[node]
        return out
