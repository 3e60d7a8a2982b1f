"""Gradient-boosted regression trees for two classes, in numpy.

Features are cut once into bins at quantiles; each tree is grown level by level from histograms
of gradients and curvatures, on a part of the rows, to a fixed depth, so that a tree is two arrays
and a prediction is ``depth`` look-ups a tree for all rows at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TREES, DEPTH, RATE, BINS = 60, 4, 0.3, 24
#: share of the rows that a tree sees
ROWS = 0.4
#: added to the curvature of a leaf; least curvature on either side of a cut
RIDGE, LEAST = 1.0, 1.0


@dataclass(frozen=True)
class Boosted:
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray  # (trees, inner nodes): a value above goes right
    leaf: np.ndarray  # (trees, leaves)
    bias: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.bias), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += leaf[at - inner]
        return total


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, seed: int = 5) -> Boosted:
    """Fit on rows ``x`` with labels 0 and 1."""
    rng = np.random.default_rng(seed)
    n, width = x.shape
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    binned = np.column_stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T, strict=True)]).astype(np.int64)
    # bin b holds what is above cut b - 1 and at most cut b
    cells = binned + np.arange(width) * BINS
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    total = np.full(n, bias)
    inner = (1 << depth) - 1
    out = ([], [], [])
    for _ in range(trees):
        picked = np.flatnonzero(rng.random(n) < ROWS) if n > 200 else np.arange(n)
        p = 1 / (1 + np.exp(-total[picked]))
        slope, curve = y[picked] - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(picked), np.int64)
        for level in range(depth):
            low, nodes = (1 << level) - 1, 1 << level
            index = ((at - low)[:, None] * (width * BINS) + cells[picked]).ravel()
            shape = (nodes, width, BINS)
            g = np.bincount(index, np.repeat(slope, width), nodes * width * BINS).reshape(shape).cumsum(axis=2)
            h = np.bincount(index, np.repeat(curve, width), nodes * width * BINS).reshape(shape).cumsum(axis=2)
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all**2 / (h_all + RIDGE)
            gain[(h < LEAST) | (h_all - h < LEAST)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for k, b in enumerate(best):
                f, bin_ = divmod(int(b), BINS)
                if gain[k, f, bin_] > 1e-9 and bin_ < len(cuts[f]):
                    feature[low + k], cut[low + k] = f, cuts[f][bin_]
            at = 2 * at + 1 + (x[picked, feature[at]] > cut[at])
        g = np.bincount(at - inner, slope, inner + 1)
        h = np.bincount(at - inner, curve, inner + 1)
        tree = Boosted(feature[None], cut[None], (rate * g / (h + RIDGE))[None], 0.0)
        total += tree.log_odds(x)
        for held, value in zip(out, (tree.feature, tree.cut, tree.leaf), strict=True):
            held.append(value)
    return Boosted(*(np.concatenate(v) for v in out), bias)
