"""Gradient-boosted trees for yes/no labels, in numpy: quantile bins, logistic loss, level-wise trees of fixed depth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    """A complete binary tree per round: feature and threshold of inner nodes in breadth-first order, values of leaves.
    A row goes right where its feature is above the threshold."""

    depth: int
    feature: np.ndarray  # rounds x (2 ** depth - 1)
    threshold: np.ndarray
    value: np.ndarray  # rounds x 2 ** depth
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of every row of x."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (2**self.depth - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.3, l2: float = 2.0) -> Trees:
    n, width = x.shape
    yes_no = np.array([bool(((c == 0) | (c == 1)).all()) for c in x.T])
    numbers, flags = np.flatnonzero(~yes_no), np.flatnonzero(yes_no)
    edges = {f: np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in numbers}
    bins = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in numbers] or [np.zeros(n, np.int64)], 1)  # bin b: edge[b-1] < x <= edge[b]
    wide = bins.shape[1]
    flat, flag = bins + np.arange(wide) * BINS, np.ascontiguousarray(x[:, flags], np.float32)
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin, inner, leaves = np.full(n, base), 2**depth - 1, 2**depth
    features, thresholds, values = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, leaves))

    def gain(gl: np.ndarray, hl: np.ndarray, g: float, h: float) -> np.ndarray:
        out = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g**2 / (h + l2)
        return np.where((hl < 1e-2) | (h - hl < 1e-2), 0, out)

    for r in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first = 2**level - 1
            for k in range(first, 2 * first + 1):
                own = np.flatnonzero(at == k)
                if not len(own):
                    continue
                go, ho, cells = g[own], h[own], flat[own].ravel()
                gs, hs = (np.bincount(cells, np.repeat(v, wide), wide * BINS).reshape(wide, BINS).cumsum(1)[:, :-1] for v in (go, ho))
                best = gain(gs, hs, go.sum(), ho.sum())
                f, cut = divmod(int(best.argmax()), BINS - 1)
                top = best[f, cut] if len(numbers) and cut < len(edges[numbers[f]]) else 0.0
                if top > 1e-6:
                    features[r, k], thresholds[r, k] = numbers[f], edges[numbers[f]][cut]
                if len(flags):
                    other = gain(go.sum() - go.astype(np.float32) @ flag[own], ho.sum() - ho.astype(np.float32) @ flag[own], go.sum(), ho.sum())
                    if other.max() > max(top, 1e-6):
                        features[r, k], thresholds[r, k] = flags[int(other.argmax())], 0.5
            at = 2 * at + 1 + (x[np.arange(n), features[r][at]] > thresholds[r][at])
        leaf = at - inner
        values[r] = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        margin += values[r][leaf]
    return Trees(depth, features, thresholds, values, base)
