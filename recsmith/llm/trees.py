"""Histogram decision trees in numpy: boosted (with monotonic constraints) and random forests.

Fitting runs on the driver over a bounded sample; fitted trees are flat node arrays that
score a whole batch level by level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Trees as flat arrays of equal width: ``feature < 0`` marks a leaf, children are absolute nodes."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of the trees' leaf values for each row of ``x``."""
        x = np.nan_to_num(np.asarray(x, float).reshape(len(x), -1))
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        for _ in range(self.depth):
            f = self.feature[node]
            down = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[node], self.left[node], self.right[node])
            node = np.where(f < 0, node, down)
        return self.base + self.value[node].sum(axis=1)


def bins_of(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Split points of each feature: midpoints of its values, or quantiles if there are many."""
    out = []
    for col in x.T:
        v = np.unique(col)
        if len(v) > most:
            v = np.unique(np.quantile(v, np.linspace(0, 1, most)))
        out.append((v[1:] + v[:-1]) / 2)
    return out


class _Grower:
    def __init__(self, x, most_bins, depth, min_leaf, l2, monotone):
        self.edges = bins_of(x, most_bins)
        self.codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        self.depth, self.min_leaf, self.l2 = depth, min_leaf, l2
        self.monotone = np.zeros(x.shape[1], int) if monotone is None else np.asarray(monotone)
        self.nodes: list[list] = []
        self.roots: list[int] = []

    def tree(self, g, h, rows, rate, pick=None) -> None:
        """Fit one tree to gradients ``g`` and weights ``h``; ``pick()`` chooses features per node."""
        self.roots.append(self._grow(g, h, rows, 0, -np.inf, np.inf, rate, pick))

    def _grow(self, g, h, rows, depth, lo, hi, rate, pick) -> int:
        at = len(self.nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        value = min(max(-gs / (hs + self.l2), lo), hi)
        self.nodes.append([-1, 0.0, at, at, value * rate])
        if depth == self.depth or len(rows) < 2 * self.min_leaf:
            return at
        best = (1e-9, -1, -1, 0.0, 0.0)
        for f in range(len(self.edges)) if pick is None else pick():
            n_bins = len(self.edges[f]) + 1
            if n_bins < 2:
                continue
            codes = self.codes[rows, f]
            n = np.cumsum(np.bincount(codes, minlength=n_bins))[:-1]
            gl = np.cumsum(np.bincount(codes, g[rows], n_bins))[:-1]
            hl = np.cumsum(np.bincount(codes, h[rows], n_bins))[:-1]
            left, right = -gl / (hl + self.l2), -(gs - gl) / (hs - hl + self.l2)
            gain = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)
            bad = (n < self.min_leaf) | (len(rows) - n < self.min_leaf) | (self.monotone[f] * (right - left) < 0)
            gain = np.where(bad, -np.inf, gain)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], f, k, left[k], right[k])
        _, f, k, vl, vr = best
        if f < 0:
            return at
        middle = min(max((vl + vr) / 2, lo), hi)
        bounds = {1: ((lo, middle), (middle, hi)), -1: ((middle, hi), (lo, middle)), 0: ((lo, hi), (lo, hi))}[int(self.monotone[f])]
        goes = self.codes[rows, f] <= k
        left = self._grow(g, h, rows[goes], depth + 1, *bounds[0], rate, pick)
        right = self._grow(g, h, rows[~goes], depth + 1, *bounds[1], rate, pick)
        self.nodes[at][:4] = [f, float(self.edges[f][k]), left, right]
        return at

    def forest(self, base: float = 0.0) -> Forest:
        cols = list(zip(*self.nodes, strict=True))
        kinds = (np.int32, float, np.int32, np.int32, float)
        return Forest(*[np.array(c, k) for c, k in zip(cols, kinds, strict=True)], np.array(self.roots, np.int32), self.depth, base)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_boosted(x, y, trees=60, depth=3, rate=0.2, min_leaf=10, l2=1.0, most_bins=32, monotone=None) -> Forest:
    """Gradient-boosted trees on log-odds; ``monotone`` has -1, 0 or 1 for each feature."""
    x, y = np.nan_to_num(np.asarray(x, float)), np.asarray(y, float)
    grower = _Grower(x, most_bins, depth, min_leaf, l2, monotone)
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    z, rows = np.full(len(y), base), np.arange(len(y))
    for _ in range(trees):
        p = _sigmoid(z)
        first = len(grower.nodes)
        grower.tree(p - y, p * (1 - p), rows, rate)
        part = grower.forest()
        z = z + Forest(part.feature, part.threshold, part.left, part.right, part.value, np.array([first]), depth).raw(x)
    return grower.forest(base)


def fit_forest(x, y, trees=40, depth=8, min_leaf=3, most_bins=64, seed=1) -> Forest:
    """Random forest whose ``raw`` is the mean of the trees' class shares."""
    x, y = np.nan_to_num(np.asarray(x, float)), np.asarray(y, float)
    rng = np.random.default_rng(seed)
    grower = _Grower(x, most_bins, depth, min_leaf, 1e-9, None)
    take = max(1, int(np.ceil(np.sqrt(x.shape[1]))))
    ones = np.ones(len(y))
    for _ in range(trees):
        grower.tree(-y, ones, rng.integers(0, len(y), len(y)), 1 / trees, lambda: rng.choice(x.shape[1], take, replace=False))
    return grower.forest()


def probability(forest: Forest, x) -> np.ndarray:
    return _sigmoid(forest.raw(x))
