"""Gradient-boosted trees for two classes over binned features, in NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth: per inner node a feature and a limit, per leaf a value."""

    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, depth = np.arange(len(x)), int(np.log2(self.leaf.shape[1]))
        for f, t, v in zip(self.feature, self.limit, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (len(v) - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss; splits are chosen from histograms of quantile bins."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    share = float(np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    score = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    feature, limit, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best_gain, best = np.full(count, 1e-6), [(0, np.inf, bins)] * count
            for j in range(width):
                if not len(edges[j]):
                    continue
                key = at * bins + binned[j]
                gs = np.bincount(key, g, count * bins).reshape(count, bins).cumsum(1)
                hs = np.bincount(key, h, count * bins).reshape(count, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain = gain[:, : len(edges[j])]
                k = gain.argmax(1)
                for c in np.flatnonzero(gain[np.arange(count), k] > best_gain):
                    best_gain[c], best[c] = gain[c, k[c]], (j, edges[j][k[c]], k[c])
            cut = np.array([b[2] for b in best])
            which = np.array([b[0] for b in best])
            feature[t, first : first + count] = which
            limit[t, first : first + count] = [b[1] for b in best]
            at = 2 * at + (binned[which[at], np.arange(n)] > cut[at])
        gs, hs = np.bincount(at, g, leaves), np.bincount(at, h, leaves)
        leaf[t] = rate * gs / (hs + ridge)
        score += leaf[t][at]
    return Trees(feature, limit, leaf, base)
