"""Gradient-boosted trees for two classes, on histograms, in numpy. Small tables only: it is for bounded samples."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Full binary trees of one depth; feature < 0 never splits (all go left)."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, f = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], axis=1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        score = np.full(n, self.start)
        nodes = (1 << self.depth) - 1
        self.feature = np.full((self.trees, nodes), -1)
        self.cut = np.zeros((self.trees, nodes))
        self.leaf = np.zeros((self.trees, nodes + 1))
        width = self.bins
        for t in range(self.trees):
            prob = 1 / (1 + np.exp(-score))
            g, h = y - prob, np.maximum(prob * (1 - prob), 1e-6)
            at = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, count = (1 << level) - 1, 1 << level
                local = at - first
                best = np.full(count, 1e-6)
                choice = np.full((count, 2), -1)
                total_g, total_h = np.bincount(local, g, count), np.bincount(local, h, count)
                base = total_g**2 / (total_h + self.ridge)
                for j in range(f):
                    if not len(self.cuts[j]):
                        continue
                    key = local * width + binned[:, j]
                    left_g = np.cumsum(np.bincount(key, g, count * width).reshape(count, width), axis=1)[:, :-1]
                    left_h = np.cumsum(np.bincount(key, h, count * width).reshape(count, width), axis=1)[:, :-1]
                    right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                    gain = left_g**2 / (left_h + self.ridge) + right_g**2 / (right_h + self.ridge) - base[:, None]
                    gain[(left_h < 0.5) | (right_h < 0.5)] = 0
                    gain[:, len(self.cuts[j]) :] = 0
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(count), k]
                    better = top > best
                    best[better] = top[better]
                    choice[better] = np.stack((np.full(count, j), k), axis=1)[better]
                for i, (j, k) in enumerate(choice):
                    if j >= 0:
                        self.feature[t, first + i], self.cut[t, first + i] = j, self.cuts[j][k]
                j = self.feature[t, at]
                right = (j >= 0) & (x[np.arange(n), np.maximum(j, 0)] > self.cut[t, at])
                at = 2 * at + 1 + right
            at -= nodes
            self.leaf[t] = self.rate * np.bincount(at, g, nodes + 1) / (np.bincount(at, h, nodes + 1) + self.ridge)
            score = score + self.leaf[t, at]
        del self.cuts
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        out = np.full(len(x), self.start)
        for t in range(self.trees):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                j = self.feature[t, at]
                at = 2 * at + 1 + ((j >= 0) & (x[rows, np.maximum(j, 0)] > self.cut[t, at]))
            out += self.leaf[t, at - (1 << self.depth) + 1]
        return out
