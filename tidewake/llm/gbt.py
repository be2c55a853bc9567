"""Gradient-boosted trees in numpy: logistic loss, histograms of binned features, trees of one fixed depth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees: inner node k has children 2k + 1 and 2k + 2."""

    depth: int
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # go right where the value is greater
    leaf: np.ndarray  # trees x leaves
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of every row."""
        out, row = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[row, feature[at]] > threshold[at])
            out += leaf[at - len(feature)]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 5.0) -> Trees:
    """Newton boosting; splits are at quantiles of the features."""
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins)[1:-1])) for k in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], axis=1)  # bin b: above b cuts
    share = float(np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    inner, leaves = (1 << depth) - 1, 1 << depth
    features, thresholds, values = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            best = np.full(count, 1e-6)
            local = at - first
            total_g, total_h = np.bincount(local, g, count), np.bincount(local, h, count)
            for k in range(d):
                size = len(cuts[k]) + 1
                if size == 1:
                    continue
                cell = local * size + binned[:, k]
                left_g = np.cumsum(np.bincount(cell, g, count * size).reshape(count, size), axis=1)[:, :-1]
                left_h = np.cumsum(np.bincount(cell, h, count * size).reshape(count, size), axis=1)[:, :-1]
                right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - (total_g**2 / (total_h + ridge))[:, None]
                where = gain.argmax(axis=1)
                top = gain[np.arange(count), where]
                for node in np.flatnonzero(top > best):
                    best[node] = top[node]
                    features[t, first + node], thresholds[t, first + node] = k, cuts[k][where[node]]
            at = 2 * at + 1 + (x[np.arange(n), features[t, at]] > thresholds[t, at])
        leaf = at - inner
        values[t] = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        margin += values[t][leaf]
    return Trees(depth, features, thresholds, values, base)
