"""Gradient-boosted trees and isotonic calibration on a bounded sample of dense features."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

TREES, DEPTH, RATE, BINS, LEAST = 60, 3, 0.2, 32, 5


def fit_trees(x: np.ndarray, y: np.ndarray) -> tuple[float, list[list[tuple[int, float, float]]]]:
    """Prior log-odds and complete trees: per node (feature, threshold, leaf value), heap order."""
    rate = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    prior = float(np.log(rate / (1 - rate)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1) if len(x) else np.zeros((0, x.shape[1]), int)
    raw, trees = np.full(len(y), prior), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        tree, at = [(0, np.inf, 0.0)] * (2 ** (DEPTH + 1) - 1), np.zeros(len(y), int)
        for node in range(2 ** (DEPTH + 1) - 1):
            own = at == node
            sg, sh = g[own].sum(), h[own].sum()
            best, split = 1e-9, None
            if node < 2**DEPTH - 1 and own.sum() >= 2 * LEAST:
                for f, e in enumerate(edges):
                    if len(e):
                        cg, ch, n = (np.cumsum(np.bincount(bins[own, f], w, len(e) + 1))[:-1] for w in (g[own], h[own], None))
                        gain = np.where((n >= LEAST) & (own.sum() - n >= LEAST), cg**2 / (ch + 1) + (sg - cg) ** 2 / (sh - ch + 1) - sg**2 / (sh + 1), 0)
                        if gain.max() > best:
                            best, split = gain.max(), (f, int(gain.argmax()))
            value = float(RATE * sg / (sh + 1))
            if split:
                f, k = split
                tree[node] = (f, float(edges[f][k]), value)
                at[own] = np.where(bins[own, f] <= k, 2 * node + 1, 2 * node + 2)
            else:
                tree[node] = (0, np.inf, value)
                raw[own] += value
        trees.append(tree)
    return prior, trees


def tree_scores(model: tuple[float, list[list[tuple[int, float, float]]]], x: np.ndarray) -> np.ndarray:
    prior, trees = model
    raw, rows = np.full(len(x), prior), np.arange(len(x))
    for tree in trees:
        f, t, v = (np.array(c) for c in zip(*tree, strict=True))
        at, open_ = np.zeros(len(x), int), np.ones(len(x), bool)
        for _ in range(DEPTH):
            open_ &= np.isfinite(t[at])
            at = np.where(open_, 2 * at + 1 + (x[rows, f[at]] > t[at]), at)
        raw += v[at]
    return raw


def pooled(pools: Iterable[tuple[float, float, float, float]]) -> list[list[float]]:
    """Pool adjacent violators over ``sum of y, weight, first score, last score``: means rise strictly."""
    out: list[list[float]] = []
    for p in pools:
        out.append(list(p))
        while len(out) > 1 and out[-2][0] * out[-1][1] >= out[-1][0] * out[-2][1]:
            a, b = out.pop(-2), out[-1]
            out[-1] = [a[0] + b[0], a[1] + b[1], a[2], b[3]]
    return out


def fit_isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and rising probabilities: pools are shrunk by one doubtful row each and then pooled again, so the curve never falls."""
    order = np.lexsort((-y, score))
    rows = zip((y * weight)[order].tolist(), weight[order].tolist(), score[order].tolist(), score[order].tolist(), strict=True)
    pools = pooled((p[0] + 0.5, p[1] + 1, p[2], p[3]) for p in pooled(rows))
    if not pools:
        return np.zeros(1), np.full(1, 0.5)
    knots = np.array([k for p in pools for k in p[2:]])
    return knots, np.repeat([p[0] / p[1] for p in pools], 2)


def calibrated(model: tuple[np.ndarray, np.ndarray], score: np.ndarray) -> np.ndarray:
    return np.clip(np.interp(score, *model), 0.0, 1.0)
