"""Gradient-boosted trees in numpy: small, deterministic, with monotonic constraints.

Trees are flattened into node arrays, so scoring walks all rows of a batch through all trees at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Arrays of shape (trees, nodes): a leaf has feature -1; value holds its share of the log odds."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = self.feature[t, at]
                inner = f >= 0
                goes_left = x[rows, np.where(inner, f, 0)] <= self.threshold[t, at]
                at = np.where(inner, np.where(goes_left, self.left[t, at], self.right[t, at]), at)
            out += self.value[t, at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.log_odds(x)))


def constant(p: float) -> Forest:
    none = np.zeros((0, 1))
    return Forest(none.astype(np.int64), none, none.astype(np.int64), none.astype(np.int64), none, float(np.log(p / (1 - p))), 0)


def fit(x, y, monotone, rounds=60, depth=3, rate=0.2, bins=64, l2=1.0, least=1.0) -> Forest:
    """Newton boosting of the logistic loss over feature histograms.

    monotone has +1, -1 or 0 for each feature: the log odds never fall, never rise, or do as they like in it.
    A split is refused if its children stand in the wrong order; children also inherit the middle of their
    parent's split as a bound, so no later split undoes the order. With fewer than two classes the forest is
    a constant.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    if len(y) == 0 or y.min() == y.max():
        return constant(0.5 if len(y) == 0 else min(max(float(y[0]), 0.001), 0.999))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    bias = float(np.log(y.mean() / (1 - y.mean())))
    score, trees = np.full(len(y), bias), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = _tree(binned, edges, y - p, np.maximum(p * (1 - p), 1e-9), monotone, depth, l2, least)
        score += rate * tree["value"][tree["leaf"]]
        trees.append(tree)
    wide = max(len(t["feature"]) for t in trees)

    def pad(name, fill, kind):
        return np.array([t[name] + [fill] * (wide - len(t[name])) if isinstance(t[name], list) else np.r_[t[name], np.full(wide - len(t[name]), fill)] for t in trees], kind)

    return Forest(pad("feature", -1, np.int64), pad("threshold", 0, float), pad("left", 0, np.int64), pad("right", 0, np.int64), rate * pad("value", 0, float), bias, depth)


def _tree(binned, edges, grad, hess, monotone, depth, l2, least):
    feature, threshold, left, right, value = [-1], [0.0], [0], [0], [0.0]
    leaf = np.zeros(len(grad), np.int64)

    def weight(g, h, bound):
        return min(max(g / (h + l2), bound[0]), bound[1])

    def gain(g, h, w):
        return g * w - 0.5 * (h + l2) * w * w

    level = [(0, (-np.inf, np.inf))]
    value[0] = weight(grad.sum(), hess.sum(), level[0][1])
    for _ in range(depth):
        following = []
        for node, bound in level:
            rows = np.flatnonzero(leaf == node)
            g, h = grad[rows], hess[rows]
            base, best = gain(g.sum(), h.sum(), value[node]), None
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                gs = np.cumsum(np.bincount(binned[rows, j], g, len(e) + 1))
                hs = np.cumsum(np.bincount(binned[rows, j], h, len(e) + 1))
                for b in np.flatnonzero((hs[:-1] >= least) & (hs[-1] - hs[:-1] >= least)):
                    wl, wr = weight(gs[b], hs[b], bound), weight(gs[-1] - gs[b], hs[-1] - hs[b], bound)
                    if monotone[j] * (wr - wl) < 0:
                        continue
                    won = gain(gs[b], hs[b], wl) + gain(gs[-1] - gs[b], hs[-1] - hs[b], wr) - base
                    if won > 1e-6 and (best is None or won > best[0]):
                        best = (won, j, b, wl, wr)
            if best is None:
                continue
            _, j, b, wl, wr = best
            middle = (wl + wr) / 2
            lo, hi = bound
            bounds = [(lo, hi), (lo, hi)]
            if monotone[j]:
                bounds = [(lo, middle), (middle, hi)] if monotone[j] > 0 else [(middle, hi), (lo, middle)]
            feature[node], threshold[node] = j, float(edges[j][b])
            for side, kids, w, bnd in ((rows[binned[rows, j] <= b], left, wl, bounds[0]), (rows[binned[rows, j] > b], right, wr, bounds[1])):
                kids[node] = len(feature)
                leaf[side] = len(feature)
                following.append((len(feature), bnd))
                for column, fill in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, w)):
                    column.append(fill)
        level = following
    return {"feature": feature, "threshold": threshold, "left": left, "right": right, "value": np.array(value), "leaf": leaf}
