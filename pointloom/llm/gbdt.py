"""Histogram gradient-boosted trees for two classes, in numpy.

Features are binned at quantiles; each tree grows level by level from
histograms of gradients. The trees are kept as flat arrays (feature, threshold,
left child, value), so scoring walks all rows of a block through a tree with a
few array operations a level. Everything is deterministic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Node k of a tree tests ``x[feature[k]] <= threshold[k]``: left to ``left[k]``, else ``left[k] + 1``; leaves point to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                left = self.left[node]
                step = x[rows, self.feature[node]] > self.threshold[node]
                node = np.where(left < 0, node, left + step)
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(np.asarray(x, dtype=np.float64))))


def constant(p: float) -> Forest:
    z = np.zeros(0)
    return Forest(z.astype(int), z, z.astype(int), z, z.astype(int), 0, float(np.log(p / (1 - p))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, penalty: float = 2.0, least: int = 8) -> Forest:
    """Fit to ``y`` in {0, 1}; with no rows or one class, a constant just inside (0, 1)."""
    x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
    n = len(y)
    if not n or y.min() == y.max():
        return constant(0.5 if not n else (n * y.mean() + 0.5) / (n + 1))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    width, features = bins, len(edges)
    start = float(np.log(y.mean() / (1 - y.mean())))
    raw = np.full(n, start)
    feature, threshold, left, value, roots = [], [], [], [], []

    def node() -> int:
        for a, v in ((feature, 0), (threshold, 0.0), (left, -1), (value, 0.0)):
            a.append(v)
        return len(value) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        root = node()
        roots.append(root)
        open_, at = [root], np.zeros(n, dtype=np.int64)
        for level in range(depth + 1):
            m = len(open_)
            live = at >= 0
            tot_g, tot_h = (np.bincount(at[live], v[live], m) for v in (g, h))
            for k, i in enumerate(open_):
                value[i] = rate * tot_g[k] / (tot_h[k] + penalty)
            if level == depth:
                break
            key = at[live] * width
            hist = np.stack([np.stack([np.bincount(key + b[live], v[live], m * width).reshape(m, width) for v in (g, h, np.ones(n))]) for b in binned])
            gl, hl, cl = np.moveaxis(np.cumsum(hist, axis=3), 1, 0)
            gt, ht, ct = tot_g[:, None], tot_h[:, None], np.bincount(at[live], minlength=m)[:, None]
            gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
            gain[(cl < least) | (ct - cl < least)] = -1
            flat = np.moveaxis(gain, 1, 0).reshape(m, features * width)
            best = flat.argmax(axis=1)
            nxt, moved = [], np.full(n, -1, dtype=np.int64)
            for k, i in enumerate(open_):
                j, b = divmod(int(best[k]), width)
                if flat[k, best[k]] <= 1e-9 or b >= len(edges[j]):
                    continue
                a, c = node(), node()
                feature[i], threshold[i], left[i] = j, float(edges[j][b]), a
                rows = at == k
                moved[rows] = len(nxt) + (binned[j][rows] > b)
                nxt += [a, c]
            open_, at = nxt, moved
            if not nxt:
                break
        f = Forest(*(np.array(v) for v in (feature, threshold, left, value)), np.array([root]), depth, 0.0)
        raw += f.raw(x)
    return Forest(*(np.array(v) for v in (feature, threshold, left, value, roots)), depth, start)
