"""Gradient-boosted trees for two classes on binned features, with Platt calibration. Small, deterministic, NumPy only."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of equal depth as flat arrays: node i has the children 2 i + 1 and 2 i + 2."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 8, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.scale, self.shift = 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
        n, width = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(n, self.base)
        inner = (1 << self.depth) - 1
        self.feature, self.cut, self.leaf = [], [], []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            feature, cut = np.full(inner, -1, np.int64), np.full(inner, np.inf)
            at = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, nodes = (1 << level) - 1, 1 << level
                best = np.full(nodes, 1e-9)
                split = np.zeros(nodes, np.int64)
                for j in range(width):
                    size = len(self.edges[j]) + 1
                    if size < 2:
                        continue
                    key = (at - first) * size + binned[:, j]
                    gs, hs, ns = (np.bincount(key, w, nodes * size).reshape(nodes, size).cumsum(axis=1) for w in (g, h, np.ones(n)))
                    left, right = gs[:, :-1], gs[:, -1:] - gs[:, :-1]
                    gain = left**2 / (hs[:, :-1] + self.ridge) + right**2 / (hs[:, -1:] - hs[:, :-1] + self.ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + self.ridge)
                    gain[(ns[:, :-1] < self.least) | (ns[:, -1:] - ns[:, :-1] < self.least)] = -1
                    k = gain.argmax(axis=1)
                    value = gain[np.arange(nodes), k]
                    take = value > best
                    best[take], split[take] = value[take], k[take]
                    feature[first : first + nodes][take] = j
                    cut[first : first + nodes][take] = self.edges[j][k[take]]
                f = feature[at]
                at = 2 * at + 1 + ((f >= 0) & (binned[np.arange(n), np.maximum(f, 0)] > self._bin(f, split[at - first], n)))
            leaf = np.bincount(at - inner, g, inner + 1) / (np.bincount(at - inner, h, inner + 1) + self.ridge) * self.rate
            margin += leaf[at - inner]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(leaf)
        return self

    @staticmethod
    def _bin(feature: np.ndarray, split: np.ndarray, n: int) -> np.ndarray:
        return np.where(feature >= 0, split, np.iinfo(np.int64).max)

    def margin(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, np.float64)
        out, place = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = 2 * at + 1 + ((f >= 0) & (x[place, np.maximum(f, 0)] > cut[at]))
            out += leaf[at - len(feature)]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Platt scaling on rows that the trees have not seen, by Newton steps."""
        m = self.margin(x)
        target = np.where(np.asarray(y) > 0, (np.sum(y) + 1) / (np.sum(y) + 2), 1 / (np.sum(1 - y) + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
            w = np.maximum(p * (1 - p), 1e-6)
            grad = np.array([((p - target) * m).sum() + 1e-3 * (a - 1), (p - target).sum()])
            hess = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-6]])
            step = np.linalg.solve(hess, grad)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-8:
                break
        if a > 0:
            self.scale, self.shift = float(a), float(b)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.margin(x) + self.shift, -30, 30))) if len(x) else np.empty(0)


def threshold(p: np.ndarray, y: np.ndarray, precision: float = 0.98) -> float:
    """The least probability from which held-out precision holds; never under one half."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(np.asarray(y)[order])
    good = np.flatnonzero(hits / np.arange(1, len(p) + 1) >= precision)
    return max(0.5, float(p[order][good[-1]])) if len(good) else 0.5
