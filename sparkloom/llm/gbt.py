"""Histogram gradient-boosted trees for 0/1 labels, flattened into arrays for vectorised traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees: feature and threshold of each inner node, value of each leaf, a row a tree."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48, least: float = 5.0, l2: float = 1.0) -> Trees:
    """Boosted trees on the log loss.  No rows, or one label only, give a constant score."""
    n, width = x.shape
    inner = 2**depth - 1
    mean = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(mean / (1 - mean)))
    if not n or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    edges = np.full((width, bins - 1), np.inf)
    binned = np.empty((n, width), dtype=np.int64)
    for f in range(width):
        own = np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
        edges[f, : len(own)] = own
        binned[:, f] = np.searchsorted(own, x[:, f], side="left")  # bin b: edges[b-1] < x <= edges[b]
    binned += np.arange(width) * bins
    margin = np.full(n, base)
    feature, threshold, value = (np.zeros((trees, k), t) for k, t in ((inner, np.int64), (inner, float), (inner + 1, float)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            count = 2**level
            cell = (node[:, None] * (width * bins) + binned).ravel()
            size = count * width * bins
            sums = [np.bincount(cell, np.repeat(w, width), size).reshape(count, width, bins).cumsum(axis=2) for w in (g, h)]
            (gl, hl), (gt, ht) = sums, (s[:, :, -1:] for s in sums)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < least / 4) | (ht - hl < least / 4) | ~np.isfinite(gain)] = -1
            gain[:, :, -1] = -1
            best = gain.reshape(count, -1).argmax(axis=1)
            f, b = best // bins, best % bins
            ok = gain.reshape(count, -1)[np.arange(count), best] > 1e-9
            at = count - 1 + np.arange(count)
            feature[t, at] = np.where(ok, f, 0)
            threshold[t, at] = np.where(ok, edges[f, np.minimum(b, bins - 2)], np.inf)
            go = ok[node] & (binned[np.arange(n), f[node]] - f[node] * bins > b[node])
            node = 2 * node + go
        leaf_g, leaf_h = (np.bincount(node, w, inner + 1) for w in (g, h))
        value[t] = -rate * leaf_g / (leaf_h + l2)
        margin += value[t][node]
    return Trees(feature, threshold, value, base)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (scores, values) between which the calibrated value is interpolated."""
    if not len(score):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, count, lowest score, highest score
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        if blocks and s == blocks[-1][3]:
            blocks[-1][0] += v
            blocks[-1][1] += 1
        else:
            blocks.append([v, 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2], b[3]]
    at = np.array([x for b in blocks for x in (b[2], b[3])])
    to = np.array([b[0] / b[1] for b in blocks for _ in (0, 1)])
    return at, to


def auc(score: np.ndarray, y: np.ndarray) -> float:
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    s = score[order]
    _, first, size = np.unique(s, return_index=True, return_counts=True)
    rank[order] = np.repeat(first + (size + 1) / 2, size)
    pos = y == 1
    return float((rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / max(1, pos.sum() * (~pos).sum()))
