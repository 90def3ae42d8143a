"""Gradient-boosted trees for two classes over dense features, and isotonic calibration, in numpy.

Training works on a bounded sample that fits the driver; scoring works on any number of rows, batch by batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth: split feature and threshold of inner nodes in heap order, values of the leaves."""

    start: float
    feature: np.ndarray  # trees x (2^depth - 1)
    threshold: np.ndarray
    value: np.ndarray  # trees x 2^depth

    def raw(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        inner = self.feature.shape[1]
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            score += value[node - inner]
        return score

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit_trees(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 1.0
) -> Trees:
    """Newton boosting of the logistic loss with histograms. One class only, or no rows: a constant."""
    positive = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(positive / (1 - positive)))
    inner, leaves = 2**depth - 1, 2**depth
    if len(y) == 0 or y.min() == y.max():
        empty = np.zeros((0, inner))
        return Trees(start, empty.astype(int), empty, np.zeros((0, leaves)))
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    score = np.full(n, start)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, hessian = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best = np.full(count, 1e-9)
            local = node - first
            chosen_bin = np.full(count, bins + 1)
            for f in range(width):
                key = local * (bins + 1) + binned[:, f]
                g = np.bincount(key, gradient, count * (bins + 1)).reshape(count, -1).cumsum(1)
                h = np.bincount(key, hessian, count * (bins + 1)).reshape(count, -1).cumsum(1)
                whole_g, whole_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + least) + (whole_g - g) ** 2 / (whole_h - h + least) - whole_g**2 / (whole_h + least)
                gain = gain[:, : len(cuts[f])]
                if not gain.shape[1]:
                    continue
                at = gain.argmax(1)
                top = gain[np.arange(count), at]
                better = top > best
                best[better] = top[better]
                feature[first : first + count][better] = f
                threshold[first : first + count][better] = cuts[f][at[better]]
                chosen_bin[better] = at[better]
            goes = binned[np.arange(n), feature[node]] > chosen_bin[local]
            node = 2 * node + 1 + goes
        leaf = node - inner
        g = np.bincount(leaf, gradient, leaves)
        h = np.bincount(leaf, hessian, leaves)
        value = rate * g / (h + least)
        score += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(start, np.array(features), np.array(thresholds), np.array(values))


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a non-decreasing map from scores to frequencies (ties share one knot)."""
    if not len(y):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    at, inverse = np.unique(score, return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    mean = np.bincount(inverse, y) / weight
    blocks: list[list[float]] = []  # mean, weight, first score, last score
    for m, w, s in zip(mean, weight, at):
        blocks.append([m, w, s, s])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, _, last = blocks.pop()
            m1, w1, first, _ = blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, first, last])
    knots = [(edge, b[0]) for b in blocks for edge in dict.fromkeys((b[2], b[3]))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


def calibrated(score: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.clip(np.interp(score, *knots), 0.0, 1.0)
