"""Small learners in numpy: gradient-boosted trees of dense features, and isotonic calibration."""

from __future__ import annotations

import numpy as np

BINS = 32


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


class Boosted:
    """Trees of one depth for the logistic loss, grown level by level over binned features."""

    def __init__(self, rounds: int = 60, rate: float = 0.2, depth: int = 3, penalty: float = 1.0, least: float = 1.0):
        self.rounds, self.rate, self.depth, self.penalty, self.least = rounds, rate, depth, penalty, least

    def _binned(self, x):
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1) if len(self.edges) else np.zeros((len(x), 0), int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T] if len(x) else [np.zeros(0)] * x.shape[1]
        self.trees = []
        n, f = x.shape
        mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
        self.base = float(logit(mean)) if n else 0.0
        if n == 0 or y.min() == y.max():
            return self
        b = self._binned(x)
        flat = b + np.arange(f) * BINS
        score = np.full(n, self.base)
        for _ in range(self.rounds):
            p = sigmoid(score)
            g, h = p - y, p * (1 - p)
            feature, cut = np.zeros(1 << self.depth, int), np.full(1 << self.depth, BINS)
            node = np.ones(n, int)
            for level in range(self.depth):
                first, many = 1 << level, 1 << level
                at = ((node - first)[:, None] * (f * BINS) + flat).ravel()
                gs, hs = (np.bincount(at, np.repeat(w, f), many * f * BINS).reshape(many, f, BINS).cumsum(axis=2) for w in (g, h))
                g_all, h_all = gs[:, :, -1:], hs[:, :, -1:]
                of = lambda a, c: a * a / (c + self.penalty)
                gain = of(gs, hs) + of(g_all - gs, h_all - hs) - of(g_all, h_all)
                gain[(hs < self.least) | (h_all - hs < self.least)] = 0
                best = gain.reshape(many, -1).argmax(axis=1)
                worth = gain.reshape(many, -1).max(axis=1) > 1e-9
                feature[first : 2 * first] = np.where(worth, best // BINS, 0)
                cut[first : 2 * first] = np.where(worth, best % BINS, BINS)
                node = 2 * node + (b[np.arange(n), feature[node]] > cut[node])
            leaf = node - (1 << self.depth)
            value = -self.rate * np.bincount(leaf, g, 1 << self.depth) / (np.bincount(leaf, h, 1 << self.depth) + self.penalty)
            score += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        score = np.full(len(x), self.base)
        if self.trees and len(x):
            b, rows = self._binned(x), np.arange(len(x))
            for feature, cut, value in self.trees:
                node = np.ones(len(x), int)
                for _ in range(self.depth):
                    node = 2 * node + (b[rows, feature[node]] > cut[node])
                score += value[node - (1 << self.depth)]
        return sigmoid(score)


class Isotonic:
    """The ascending step function nearest to the labels, read with straight lines between its steps."""

    def fit(self, p: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(p, kind="stable")
        blocks: list[list[float]] = []  # mean, weight, first, last
        for q, v in zip(p[order].tolist(), y[order].tolist(), strict=True):
            if blocks and blocks[-1][3] == q:
                m, w, a, _ = blocks.pop()
                blocks.append([(m * w + v) / (w + 1), w + 1, a, q])
            else:
                blocks.append([v, 1, q, q])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                m, w, _, z = blocks.pop()
                m0, w0, a, _ = blocks.pop()
                blocks.append([(m * w + m0 * w0) / (w + w0), w + w0, a, z])
        self.x = np.array([e for b in blocks for e in (b[2], b[3])] or [0.0, 1.0])
        self.y = np.array([b[0] for b in blocks for _ in (0, 1)] or [0.0, 1.0])
        return self

    def predict(self, p: np.ndarray) -> np.ndarray:
        return np.interp(p, self.x, self.y)


def out_of_fold(x: np.ndarray, y: np.ndarray, fold: np.ndarray, **how) -> np.ndarray:
    """Each row's prediction by a model that hasn't seen its fold."""
    p = np.zeros(len(x))
    for k in np.unique(fold):
        p[fold == k] = Boosted(**how).fit(x[fold != k], y[fold != k]).predict(x[fold == k])
    return p
