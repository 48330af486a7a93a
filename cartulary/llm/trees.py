"""Small decision-tree ensembles over binned features, in numpy."""

from __future__ import annotations

import numpy as np

BINS = 32


class Bins:
    """Cuts each feature at quantiles of the training rows."""

    def __init__(self, x: np.ndarray):
        self.cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.empty(0) for k in range(x.shape[1])]

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.cuts)], axis=1).astype(np.uint8) if x.shape[1] else np.empty((len(x), 0), np.uint8)


class Tree:
    """A tree of second-order gains; leaves hold -sum(g) / (sum(h) + 1)."""

    def __init__(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rng: np.random.Generator | None = None, tried: int | None = None, least: float = 5.0, ridge: float = 1.0):
        self.feature, self.cut, self.below, self.value = [], [], [], []
        self.options = (rng, tried, least, ridge)
        self._grow(b, g, h, np.arange(len(b)), depth)
        self.arrays = tuple(map(np.array, (self.feature, self.cut, self.below, self.value)))

    def _grow(self, b, g, h, rows, depth) -> int:
        rng, tried, least, ridge = self.options
        me = len(self.feature)
        gain = lambda x, y: x * x / (y + ridge)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        self.feature.append(-1)
        self.cut.append(0)
        self.below.append((me, me))
        self.value.append(float(-total_g / (total_h + ridge)))
        best = (1e-9, -1, 0)
        if depth:
            columns = np.arange(b.shape[1]) if rng is None else np.sort(rng.choice(b.shape[1], tried, replace=False))
            for k in columns:
                own = b[rows, k]
                left_g, left_h = np.cumsum(np.bincount(own, g[rows], BINS + 1)), np.cumsum(np.bincount(own, h[rows], BINS + 1))
                score = gain(left_g, left_h) + gain(total_g - left_g, total_h - left_h) - gain(total_g, total_h)
                score[(left_h < least) | (total_h - left_h < least)] = -1
                if (at := int(score.argmax())) is not None and score[at] > best[0]:
                    best = (float(score[at]), int(k), at)
        if best[1] >= 0:
            left = b[rows, best[1]] <= best[2]
            self.feature[me], self.cut[me] = best[1], best[2]
            self.below[me] = (self._grow(b, g, h, rows[left], depth - 1), self._grow(b, g, h, rows[~left], depth - 1))
        return me

    def of(self, b: np.ndarray) -> np.ndarray:
        feature, cut, below, value = self.arrays
        at = np.zeros(len(b), np.int64)
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = below[node, (b[rows, feature[node]] > cut[node]).astype(int)]
        return value[at]


class Forest:
    """A random forest: the mean of trees on bootstrap rows and random features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bins = Bins(x)
        b = self.bins.of(x)
        self.trees = []
        for _ in range(trees if len(y) else 0):
            rows = rng.integers(0, len(y), len(y))
            self.trees.append(Tree(b[rows], -y[rows].astype(float), np.ones(len(rows)), depth, rng, max(1, round(x.shape[1] ** 0.5)), least=2.0, ridge=1e-3))

    def of(self, x: np.ndarray) -> np.ndarray:
        b = self.bins.of(x)
        return np.mean([t.of(b) for t in self.trees], axis=0) if self.trees else np.full(len(x), 0.5)


class Boosted:
    """Gradient boosting of the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2):
        self.bins, self.rate, self.trees = Bins(x), rate, []
        b = self.bins.of(x)
        share = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(share / (1 - share)))
        f = np.full(len(y), self.base)
        for _ in range(rounds if 0 < y.sum() < len(y) else 0):
            p = 1 / (1 + np.exp(-f))
            self.trees.append(Tree(b, p - y, p * (1 - p), depth))
            f += rate * self.trees[-1].of(b)

    def of(self, x: np.ndarray) -> np.ndarray:
        b = self.bins.of(x)
        f = self.base + self.rate * sum((t.of(b) for t in self.trees), np.zeros(len(x)))
        return 1 / (1 + np.exp(-np.clip(f, -50, 50)))
