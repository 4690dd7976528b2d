"""Histogram gradient-boosted trees: numpy fit on a bounded sample, flat-array scoring.

Trees are complete to a fixed depth and stored level by level, so node k has
children 2k + 1 and 2k + 2 and a whole batch descends one level per numpy step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


@dataclass
class Trees:
    base: float
    feature: np.ndarray  # (trees, 2^depth - 1)
    threshold: np.ndarray  # the same; a row goes right where its value is above
    leaf: np.ndarray  # (trees, 2^depth)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row, by vectorised descent of all trees."""
        n, (trees, inner) = len(x), self.feature.shape
        out, rows = np.full(n, self.base), np.arange(n)
        for t in range(trees):
            node = np.zeros(n, np.int64)
            feature, threshold = self.feature[t], self.threshold[t]
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += self.leaf[t][node - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64,
        ridge: float = 4.0, least: int = 8) -> Trees:
    """Logistic boosting on binned features; one class or no rows give a constant."""
    inner, width = 2 ** depth - 1, x.shape[1]
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    model = Trees(float(np.log(share / (1 - share))), np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    if len(np.unique(y)) < 2:
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(width)], axis=1)
    raw = np.full(len(y), model.base)
    for t in range(trees):
        p = sigmoid(raw)
        gradient, hessian = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = 2 ** level - 1, 2 ** level
            local = node - first
            total_g = np.bincount(local, gradient, count)
            total_h = np.bincount(local, hessian, count)
            best = np.full(count, 1e-6)
            for j in range(width):
                at, size = local * bins + binned[:, j], count * bins
                g = np.bincount(at, gradient, size).reshape(count, bins).cumsum(1)
                h = np.bincount(at, hessian, size).reshape(count, bins).cumsum(1)
                n = np.bincount(at, minlength=size).reshape(count, bins).cumsum(1)
                other_g, other_h = total_g[:, None] - g, total_h[:, None] - h
                gain = g ** 2 / (h + ridge) + other_g ** 2 / (other_h + ridge) - (total_g ** 2 / (total_h + ridge))[:, None]
                gain[(n < least) | (n[:, -1:] - n < least)] = -1
                gain[:, len(edges[j]):] = -1
                cut = gain.argmax(1)
                found = gain[np.arange(count), cut]
                for k in np.flatnonzero(found > best):
                    best[k] = found[k]
                    model.feature[t, first + k], model.threshold[t, first + k] = j, edges[j][cut[k]]
            feature, threshold = model.feature[t, node], model.threshold[t, node]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature] > threshold)
        leaf = node - inner
        g, h = np.bincount(leaf, gradient, inner + 1), np.bincount(leaf, hessian, inner + 1)
        model.leaf[t] = rate * g / (h + ridge)
        raw += model.leaf[t][leaf]
    return model


@dataclass
class Isotonic:
    """Non-decreasing map from raw score to probability, linear between block means."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.x, self.y)


def isotonic(raw: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; each block is held by its mean score and rate, with one half-count of either class."""
    if not len(raw):
        return Isotonic(np.array([-1.0, 1.0]), sigmoid(np.array([-1.0, 1.0])))
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, sum of raw
    for value, label in zip(raw[order].tolist(), y[order].tolist()):
        blocks.append([label, 1.0, value])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    s, n, v = np.array(blocks).T
    rates = np.maximum.accumulate((s + 0.5) / (n + 1.0))
    return Isotonic(v / n, rates)
