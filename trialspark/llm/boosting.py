"""Gradient-boosted trees in numpy: histogram splits, logistic loss, monotonic constraints, flat node arrays.

A small trainer for a bounded sample of labelled rows; scoring walks all rows of a batch down one tree level at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Complete binary trees laid out level by level: node ``i`` has children ``2i+1`` and ``2i+2``."""

    depth: int
    bias: float
    feature: np.ndarray  # (trees, 2**depth - 1) int
    threshold: np.ndarray  # (trees, 2**depth - 1); a row goes right when its value is above
    leaf: np.ndarray  # (trees, 2**depth)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - (len(leaf) - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, *, monotone: dict[int, int] | None = None, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, reg: float = 1.0, min_rows: int = 10) -> Forest:
    """``monotone`` maps a feature to +1 (score never falls as it grows) or -1 (never rises)."""
    n, m = x.shape
    sign = np.zeros(m)
    for k, v in (monotone or {}).items():
        sign[k] = v
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(p / (1 - p)))
    inner = 2**depth - 1
    forest = Forest(depth, bias, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    margin = np.full(n, bias)
    offset = np.arange(m) * (bins + 1)
    for t in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, np.maximum(q * (1 - q), 1e-6)
        node = np.zeros(n, np.int64)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        for i in range(inner):
            rows = np.flatnonzero(node == i)
            left, right = 2 * i + 1, 2 * i + 2
            low[[left, right]], high[[left, right]] = low[i], high[i]
            if len(rows) >= 2 * min_rows:
                flat = (binned[rows] + offset).ravel()
                sums = [np.bincount(flat, np.repeat(v, m), m * (bins + 1)).reshape(m, -1).cumsum(1) for v in (g[rows], h[rows], np.ones(len(rows)))]
                (gl, hl, nl), (gt, ht, nt) = (s[:, :-1] for s in sums), (s[:, -1:] for s in sums)
                vl = np.clip(-gl / (hl + reg), low[i], high[i])
                vr = np.clip(-(gt - gl) / (ht - hl + reg), low[i], high[i])
                gain = -(gl * vl + (hl + reg) * vl**2 / 2) - ((gt - gl) * vr + (ht - hl + reg) * vr**2 / 2)
                bad = (nl < min_rows) | (nt - nl < min_rows) | (sign[:, None] * (vr - vl) < 0)
                for j, c in enumerate(cuts):
                    bad[j, len(c) :] = True
                gain[bad] = -np.inf
                j, b = np.unravel_index(np.argmax(gain), gain.shape)
                if np.isfinite(gain[j, b]):
                    forest.feature[t, i], forest.threshold[t, i] = j, cuts[j][b]
                    middle = (vl[j, b] + vr[j, b]) / 2
                    if sign[j] > 0:
                        high[left], low[right] = middle, middle
                    elif sign[j] < 0:
                        low[left], high[right] = middle, middle
            node[rows] = 2 * i + 1 + (x[rows, forest.feature[t, i]] > forest.threshold[t, i])
        at = node - inner
        gs, hs = np.bincount(at, g, inner + 1), np.bincount(at, h, inner + 1)
        forest.leaf[t] = rate * np.clip(-gs / (hs + reg), low[inner:], high[inner:])
        margin += forest.leaf[t][at]
    return forest
