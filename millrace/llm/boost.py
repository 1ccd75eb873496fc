"""Gradient-boosted regression trees in numpy: histogram training, monotonic constraints, flat node arrays for scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees in shared node arrays. A leaf points to itself, so a fixed number of steps reaches every leaf."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Prediction for each row of x."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
            out += self.value[node]
        return out


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48, least: int = 12, ridge: float = 1.0) -> Forest:
    """Least-squares boosting. monotone: 1, 0 or -1 for each feature; a split against it is never taken, and the
    children's values are bounded by the middle of the parent's two sides, so the whole tree keeps the order."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)], 1)
    base = float(y.mean())
    guess = np.full(n, base)
    feature, cut, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        k = len(feature)
        for a, b in ((feature, 0), (cut, np.inf), (left, k), (right, k), (value, v)):
            a.append(b)
        return k

    def grow(at: np.ndarray, residual: np.ndarray, level: int, low: float, high: float) -> int:
        total, count = residual[at].sum(), len(at)
        own = float(np.clip(total / (count + ridge), low, high))
        if level == 0 or count < 2 * least:
            return leaf(own * rate)
        best = (1e-9, None)
        for j in range(m):
            size = len(edges[j]) + 1
            if size < 2:
                continue
            c = np.cumsum(np.bincount(binned[at, j], minlength=size))[:-1]
            s = np.cumsum(np.bincount(binned[at, j], residual[at], minlength=size))[:-1]
            vl, vr = np.clip(s / (c + ridge), low, high), np.clip((total - s) / (count - c + ridge), low, high)
            gain = s**2 / (c + ridge) + (total - s) ** 2 / (count - c + ridge) - total**2 / (count + ridge)
            gain[(c < least) | (count - c < least) | (monotone[j] * (vr - vl) < 0)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (j, k, vl[k], vr[k]))
        if best[1] is None:
            return leaf(own * rate)
        j, k, vl, vr = best[1]
        goes_left = binned[at, j] <= k
        middle = (vl + vr) / 2
        bounds = ((low, min(high, middle)), (max(low, middle), high)) if monotone[j] > 0 else ((max(low, middle), high), (low, min(high, middle))) if monotone[j] < 0 else ((low, high), (low, high))
        node = leaf(own * rate)
        feature[node], cut[node] = j, float(edges[j][k])
        left[node] = grow(at[goes_left], residual, level - 1, *bounds[0])
        right[node] = grow(at[~goes_left], residual, level - 1, *bounds[1])
        return node

    everyone = np.arange(n)
    arrays = None
    for _ in range(trees):
        residual = y - guess
        roots.append(grow(everyone, residual, depth, -np.inf, np.inf))
        arrays = [np.array(a) for a in (feature, cut, left, right, value)]
        node = np.full(n, roots[-1])
        for _ in range(depth):
            node = np.where(x[everyone, arrays[0][node]] <= arrays[1][node], arrays[2][node], arrays[3][node])
        guess += arrays[4][node]
    return Forest(base, np.array(roots), *arrays, depth)
