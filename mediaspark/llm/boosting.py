"""Gradient boosting of small regression trees for a yes/no label, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth: feature and limit of each inner node, value of each leaf."""

    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray
    start: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        depth = self.leaf.shape[1].bit_length() - 1
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > limit[at])
            total += leaf[at - (len(leaf) - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> Trees:
    """Newton boosting; a node splits where the loss falls most, among the feature's distinct values."""
    p0 = np.clip(y.mean(), 0.01, 0.99)
    start = float(np.log(p0 / (1 - p0)))
    total = np.full(len(y), start)
    inner, leaves = 2**depth - 1, 2**depth
    limits = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)))[:-1] for j in range(x.shape[1])]
    features, cuts, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for node in range(inner):
            own = np.flatnonzero(at == node)
            best = 1e-6
            if len(own) > 1:
                gs, hs = g[own].sum(), h[own].sum()
                for j, tries in enumerate(limits):
                    if not len(tries):
                        continue
                    left = x[own, j][:, None] <= tries
                    gl, hl = g[own] @ left, h[own] @ left
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, feature[node], cut[node] = gain[k], j, tries[k]
            at[own] = 2 * node + 1 + (x[own, feature[node]] > cut[node])
        leaf_of = at - inner
        value = -rate * np.bincount(leaf_of, g, leaves) / (np.bincount(leaf_of, h, leaves) + ridge)
        total += value[leaf_of]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    return Trees(np.array(features), np.array(cuts), np.array(values), start)
