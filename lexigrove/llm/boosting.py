"""Small gradient-boosted trees with logistic loss, for models trained on bounded samples."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of fixed depth over quantile bins. A tree is arrays of feature and cut for each inner node, and leaf values."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 24, ridge: float = 1.0):
        self.n, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        """``y``: 0 or 1. With one class only, the model is constant."""
        n, d = x.shape
        p = float(np.clip(y.mean() if n else 0.5, 1e-4, 1 - 1e-4))
        self.base = float(np.log(p / (1 - p)))
        if not n or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        code = [np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]
        f = np.full(n, self.base)
        for _ in range(self.n):
            q = 1 / (1 + np.exp(-f))
            g, h = y - q, q * (1 - q)
            node = np.zeros(n, int)
            feat, cut = [], []
            for level in range(self.depth):
                k = 1 << level
                fs, cs, best = np.zeros(k, int), np.full(k, np.inf), np.full(k, 1e-6)
                G, H = np.bincount(node, g, k), np.bincount(node, h, k)
                for j in range(d):
                    m = len(cuts[j]) + 1
                    if m == 1:
                        continue
                    at = node * m + code[j]  # all nodes of the level at once
                    gl, hl = (np.cumsum(np.bincount(at, w, k * m).reshape(k, m), 1)[:, :-1] for w in (g, h))
                    gain = gl**2 / (hl + self.ridge) + (G[:, None] - gl) ** 2 / (H[:, None] - hl + self.ridge) - (G**2 / (H + self.ridge))[:, None]
                    c = gain.argmax(1)
                    top = gain[np.arange(k), c]
                    better = top > best
                    best[better], fs[better], cs[better] = top[better], j, cuts[j][c[better]]
                node = node * 2 + (x[np.arange(n), fs[node]] > cs[node])
                feat.append(fs)
                cut.append(cs)
            G = np.bincount(node, g, 1 << self.depth)
            H = np.bincount(node, h, 1 << self.depth)
            leaf = self.rate * G / (H + self.ridge)
            f += leaf[node]
            self.trees.append((feat, cut, leaf))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of class 1."""
        return 1 / (1 + np.exp(-self.odds(x)))

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1."""
        f = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feat, cut, leaf in self.trees:
            node = np.zeros(len(x), int)
            for fs, cs in zip(feat, cut, strict=True):
                node = node * 2 + (x[rows, fs[node]] > cs[node])
            f += leaf[node]
        return f
