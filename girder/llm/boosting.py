"""Gradient-boosted trees for two classes, on numpy histograms: fitting and prediction."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Production parameters.
TREES = 60
DEPTH = 4
RATE = 0.2
BINS = 32
LEAST_WEIGHT = 2.0
RIDGE = 1.0


class Boosted(NamedTuple):
    """Full trees of one depth, in heap order; a row goes right where its value is above the cut."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes
    leaf: np.ndarray  # trees x leaves
    base: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        row = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while True:
                at = 2 * at + 1 + (x[row, feature[at]] > cut[at])
                if 2 * inner <= 2 * at[0] if len(at) else True:
                    break
            out += leaf[at - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Boosted:
    """Trees fitted to rows ``x`` with labels ``y`` (0 or 1) by Newton steps on the logistic loss."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1).astype(np.int64)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score = np.full(n, base)
    inner = (1 << depth) - 1
    features, limits, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        for level in range(depth):
            first, k = (1 << level) - 1, 1 << level
            best = np.full(k, 1e-9)
            key = (at - first) * BINS
            for j in range(width):
                sums = [np.bincount(key + binned[:, j], v, k * BINS).reshape(k, BINS).cumsum(1) for v in (g, h)]
                (gl, hl), (gt, ht) = sums, (sums[0][:, -1:], sums[1][:, -1:])
                gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(hl < LEAST_WEIGHT) | (ht - hl < LEAST_WEIGHT)] = 0
                b = gain.argmax(1)
                value = gain[np.arange(k), b]
                for i in np.flatnonzero(value > best):
                    if b[i] < len(cuts[j]):
                        best[i], feature[first + i], limit[first + i] = value[i], j, cuts[j][b[i]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > limit[at])
        leaf = rate * np.bincount(at - inner, g, inner + 1) / (np.bincount(at - inner, h, inner + 1) + RIDGE)
        score += leaf[at - inner]
        features.append(feature)
        limits.append(limit)
        leaves.append(leaf)
    return Boosted(np.stack(features), np.stack(limits), np.stack(leaves), base)
