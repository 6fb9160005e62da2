"""Gradient-boosted trees for small samples, in numpy: models that are trained on the driver and scored in tasks."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Logistic loss, trees of fixed depth, thresholds at quantiles. Deterministic."""

    rounds: int = 40
    depth: int = 3
    rate: float = 0.3
    bins: int = 16
    start: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(x.shape[1])]
        p = float(np.clip(y.mean(), 0.01, 0.99))
        self.start, self.trees = float(np.log(p / (1 - p))), []
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            g, h = y - q, q * (1 - q)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                for n in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(node == n)
                    best = 1e-9
                    total_g, total_h = g[rows].sum(), h[rows].sum()
                    for k, es in enumerate(edges):
                        for e in es:
                            left = x[rows, k] <= e
                            gl, hl = g[rows][left].sum(), h[rows][left].sum()
                            gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
                            if gain > best:
                                best, feature[n], cut[n] = gain, k, e
                    node[rows] = 2 * n + 1 + (x[rows, feature[n]] > cut[n])
            leaf = node - (2**self.depth - 1)
            value = np.array([g[leaf == i].sum() / (h[leaf == i].sum() + 1) for i in range(2**self.depth)]) * self.rate
            self.trees.append((feature, cut, value))
            score += value[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            score += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-score))
