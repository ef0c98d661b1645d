"""Gradient-boosted trees and isotonic calibration over small dense training sets."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees: per tree and inner node a feature and a limit (left: value <= limit), per leaf a step."""

    depth: int
    bias: float
    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.limit, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            total += v[node - (2**self.depth - 1)]
        return total


def fitted(x: np.ndarray, y: np.ndarray, n_trees: int = 80, depth: int = 3, rate: float = 0.12, bins: int = 64, ridge: float = 2.0) -> Trees:
    """Second-order boosting of the logistic loss on quantile histograms."""
    n, d = x.shape
    mean = (y.sum() + 0.5) / (n + 1.0)
    bias = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(1) for j in range(d)]
    width = max(len(c) for c in cuts) + 1
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1) if n else np.zeros((0, d), np.int64)
    inner = 2**depth - 1
    total = np.full(n, bias)
    trees: list[tuple] = []
    for _ in range(n_trees if n else 0):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            lo = 2**level - 1
            slot = node - lo
            for k in range(2**level):
                own = slot == k
                if own.sum() < 8:
                    continue
                flat = (np.arange(d) * width + code[own]).ravel()
                gs = np.bincount(flat, np.repeat(g[own], d), d * width).reshape(d, width).cumsum(1)
                hs = np.bincount(flat, np.repeat(h[own], d), d * width).reshape(d, width).cumsum(1)
                gt, ht = gs[0, -1], hs[0, -1]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < 1e-3) | (ht - hs < 1e-3)] = -1
                for j, c in enumerate(cuts):
                    gain[j, len(c) :] = -1
                j, c = np.unravel_index(gain.argmax(), gain.shape)
                if gain[j, c] > 1e-6:
                    feature[lo + k], limit[lo + k] = j, cuts[j][c]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > limit[node])
        leaf_of = node - inner
        gs, hs = np.bincount(leaf_of, g, 2**depth), np.bincount(leaf_of, h, 2**depth)
        leaf = rate * gs / (hs + ridge)
        total += leaf[leaf_of]
        trees.append((feature, limit, leaf))
    if not trees:
        trees = [(np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(2**depth))]
    return Trees(depth, bias, *(np.array(t) for t in zip(*trees)))


def isotonic(raw: np.ndarray, y: np.ndarray, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: rising (raw, probability) knots, for linear interpolation."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []
    for r, t in zip(raw[order], y[order]):
        blocks.append([float(t), 1.0, float(r), float(r)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, n2, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + n2, blocks[-1][2], hi]
    xs, ps = [], []
    prior = float(y.mean()) if len(y) else 0.0
    for t, n, lo, hi in blocks:
        p = (t + weight * prior) / (n + weight)
        xs += [lo, hi]
        ps += [p, p]
    return (np.array(xs), np.maximum.accumulate(np.array(ps))) if xs else (np.array([0.0]), np.array([prior]))
