"""Gradient-boosted trees on numbers, flattened to arrays of nodes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All trees' nodes one after another: node i asks ``x[feature] <= cut`` (left) or goes right; feature -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row. NaN goes right. Steps down all trees for all rows at once."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            feature = self.feature[node]
            inner = feature >= 0
            go_left = x[row, np.maximum(feature, 0)] <= self.cut[node]
            node = np.where(inner, np.where(go_left, self.left[node], self.right[node]), node)
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(1))))


def fit(
    x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...], trees: int = 80, depth: int = 3, rate: float = 0.2,
    bins: int = 64, l2: float = 1.0, least: float = 2.0,
) -> Trees:
    """Logistic boosting with second-order leaves. ``monotone[j]`` is 1, -1 or 0: how the score may go with feature j.

    Constraints hold by bounds: a split on a constrained feature must order its leaves, and their midpoint bounds
    all values further down on either side. No rows, or one class alone: a constant.
    """
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1) if len(x) else np.zeros(x.shape, int)
    score = np.full(len(y), base)
    nodes: list[list[float]] = []  # feature, cut, left, right, value
    roots = []
    both = 0 < y.sum() < len(y)
    for _ in range(trees if both else 0):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([-1, 0, 0, 0, 0.0])
        open_nodes = [(roots[-1], np.arange(len(y)), -np.inf, np.inf, 0)]
        while open_nodes:
            at, rows, low, high, level = open_nodes.pop()
            value = float(np.clip(-grad[rows].sum() / (hess[rows].sum() + l2), low, high))
            best = _split(code, cuts, grad, hess, rows, monotone, low, high, l2, least) if level < depth else None
            if best is None:
                nodes[at][4] = value * rate
                score[rows] += value * rate
                continue
            j, k, left_value, right_value = best
            goes_left = code[rows, j] <= k
            a, b = len(nodes), len(nodes) + 1
            nodes[at][:4] = [j, cuts[j][k], a, b]
            nodes += [[-1, 0, 0, 0, 0.0], [-1, 0, 0, 0, 0.0]]
            middle = (left_value + right_value) / 2
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[monotone[j]]
            open_nodes += [(a, rows[goes_left], *bounds[0], level + 1), (b, rows[~goes_left], *bounds[1], level + 1)]
    table = np.array(nodes, float).reshape(-1, 5)
    whole = lambda c: table[:, c].astype(np.int64)
    return Trees(whole(0), table[:, 1], whole(2), whole(3), table[:, 4], np.array(roots, np.int64), base, depth)


def _split(code, cuts, grad, hess, rows, monotone, low, high, l2, least):
    """Feature, bin and child values of the best allowed split, or None."""
    g_all, h_all = grad[rows].sum(), hess[rows].sum()
    best, found = 1e-6, None
    for j, c in enumerate(cuts):
        if not len(c):
            continue
        g = np.cumsum(np.bincount(code[rows, j], grad[rows], len(c) + 1))[:-1]
        h = np.cumsum(np.bincount(code[rows, j], hess[rows], len(c) + 1))[:-1]
        left, right = np.clip(-g / (h + l2), low, high), np.clip(-(g_all - g) / (h_all - h + l2), low, high)
        loss = lambda gs, hs, v: gs * v + (hs + l2) * v * v / 2
        own = np.clip(-g_all / (h_all + l2), low, high)
        gain = loss(g_all, h_all, own) - loss(g, h, left) - loss(g_all - g, h_all - h, right)
        allowed = (h >= least) & (h_all - h >= least)
        if monotone[j]:
            allowed &= (right - left) * monotone[j] >= 0
        gain = np.where(allowed, gain, -np.inf)
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, found = gain[k], (j, k, float(left[k]), float(right[k]))
    return found
