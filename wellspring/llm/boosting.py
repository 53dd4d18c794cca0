"""Gradient-boosted trees for two classes and isotonic calibration, in NumPy, for a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth; node i has children 2i+1 and 2i+2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[np.arange(len(x)), f[at]] > c[at])
            out += v[at - len(f)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, l2: float = 1.0, least: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss on binned features."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    coded = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    p0 = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(p0 / (1 - p0)))
    f, inner = np.full(n, base), (1 << depth) - 1
    feats, cuts, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, dtype=np.int64)
        tf, tc = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            node = at - first
            gain, pick = np.zeros(width), [(0, -1)] * width
            gt, ht = np.bincount(node, g, width), np.bincount(node, h, width)
            for j in range(d):
                if not len(edges[j]):
                    continue
                key = node * bins + coded[:, j]
                gl = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(axis=1)[:, : len(edges[j])]
                hl = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(axis=1)[:, : len(edges[j])]
                gr, hr = gt[:, None] - gl, ht[:, None] - hl
                s = gl**2 / (hl + l2) + gr**2 / (hr + l2) - (gt**2 / (ht + l2))[:, None]
                s[(hl < least) | (hr < least)] = 0
                b = s.argmax(axis=1)
                for q in np.flatnonzero(s[np.arange(width), b] > gain + 1e-9):
                    gain[q], pick[q] = s[q, b[q]], (j, int(b[q]))
            for q, (j, b) in enumerate(pick):
                if b >= 0:
                    tf[first + q], tc[first + q] = j, edges[j][b]
            at = 2 * at + 1 + (x[np.arange(n), tf[at]] > tc[at])
        leaf = at - inner
        v = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        f += v[leaf]
        feats.append(tf)
        cuts.append(tc)
        leaves.append(v)
    return Trees(base, np.array(feats), np.array(cuts), np.array(leaves))


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and non-decreasing values, for interpolation."""
    order = np.argsort(score, kind="stable")
    knots, start = np.unique(score[order], return_index=True)
    total = np.add.reduceat(y[order].astype(np.float64), start)
    count = np.diff(np.append(start, len(y))).astype(np.float64)
    stack: list[list[float]] = []
    for i in range(len(knots)):
        stack.append([total[i], count[i], 1])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
            t, c, k = stack.pop()
            stack[-1][0] += t
            stack[-1][1] += c
            stack[-1][2] += k
    return knots, np.repeat([t / c for t, c, _ in stack], [int(k) for _, _, k in stack])
