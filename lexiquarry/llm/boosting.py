"""Gradient-boosted trees for two classes, on features of a few levels, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth: feature and level of each inner node, leaf values."""

    feature: np.ndarray
    level: np.ndarray
    leaf: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of rows of levels."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, v, leaf in zip(self.feature, self.level, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > v[at])
            out += leaf[at - (2**self.depth - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.25, levels: int = 64, ridge: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss; splits by histograms of gradients."""
    n, width = x.shape
    p0 = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    score = np.full(n, np.log(p0 / (1 - p0)))
    base = float(score[0])
    inner = 2**depth - 1
    flat = x.astype(np.int64) + np.arange(width) * levels
    features, cuts, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        f, v = np.zeros(inner, np.int64), np.full(inner, levels, np.int64)
        for node in range(inner):
            mine = np.flatnonzero(at == node)
            if len(mine) >= 8:
                cells = flat[mine].reshape(-1)
                gs = np.bincount(cells, np.repeat(g[mine], width), width * levels).reshape(width, levels).cumsum(axis=1)
                hs = np.bincount(cells, np.repeat(h[mine], width), width * levels).reshape(width, levels).cumsum(axis=1)
                tg, th = gs[0, -1], hs[0, -1]
                gain = gs**2 / (hs + ridge) + (tg - gs) ** 2 / (th - hs + ridge) - tg**2 / (th + ridge)
                gain[(hs < 0.5) | (th - hs < 0.5)] = 0
                best = int(gain.argmax())
                if gain.reshape(-1)[best] > 1e-6:
                    f[node], v[node] = best // levels, best % levels
            at[mine] = 2 * node + 1 + (x[mine, f[node]] > v[node])
        at -= inner
        leaf = rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        score += leaf[at]
        features.append(f)
        cuts.append(v)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(cuts), np.array(leaves), depth, base)
