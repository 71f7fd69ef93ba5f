"""Gradient-boosted trees for a few classes, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Softmax boosting: each round fits one regression tree a class to the gradients.

    Trees are complete binary trees of ``depth`` levels over features cut into at most ``bins``
    values; a node that no split improves sends all rows left.
    """

    def __init__(self, depth: int = 4, rounds: int = 40, rate: float = 0.25, bins: int = 32, ridge: float = 1.0, least: float = 2.0):
        self.depth, self.rounds, self.rate, self.bins, self.ridge, self.least = depth, rounds, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray, classes: int, weight: np.ndarray | None = None) -> "Boosted":
        n, width = x.shape
        w = np.ones(n) if weight is None else weight
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        codes = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(self.cuts)], axis=1)
        offset = np.arange(width) * self.bins
        onehot = np.eye(classes)[y]
        prior = (onehot * w[:, None]).sum(axis=0) + 1.0
        self.base = np.log(prior / prior.sum())
        score = np.tile(self.base, (n, 1))
        self.trees = []
        for _ in range(self.rounds):
            p = softmax(score)
            trees = []
            for c in range(classes):
                g, h = (p[:, c] - onehot[:, c]) * w, np.maximum(p[:, c] * (1 - p[:, c]), 1e-6) * w
                tree, leaf = self._tree(codes, offset, g, h)
                score[:, c] += self.rate * tree[2][leaf]
                trees.append(tree)
            self.trees.append(trees)
        return self

    def _tree(self, codes, offset, g, h):
        """(feature, threshold, leaf values) and each row's leaf."""
        n, width = codes.shape
        inner = 2 ** self.depth - 1
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        place = np.zeros(n, np.int64)
        flat = codes + offset
        span = width * self.bins
        for level in range(self.depth):
            first, nodes = 2 ** level - 1, 2 ** level
            spot = (flat + (place * span)[:, None]).ravel()
            sums = [np.bincount(spot, np.repeat(v, width), nodes * span).reshape(nodes, width, self.bins) for v in (g, h)]
            left = [np.cumsum(s, axis=2) for s in sums]
            whole = [v[:, :, -1:] for v in left]
            gain = sum(a * a / (b + self.ridge) for a, b in ((left[0], left[1]), (whole[0] - left[0], whole[1] - left[1])))
            gain -= whole[0] ** 2 / (whole[1] + self.ridge)
            gain[(left[1] < self.least) | (whole[1] - left[1] < self.least)] = 0.0
            for f, cuts in enumerate(self.cuts):
                gain[:, f, len(cuts):] = 0.0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for i in range(nodes):
                f, b = divmod(int(best[i]), self.bins)
                if gain[i, f, b] > 1e-9:
                    feature[first + i], threshold[first + i] = f, self.cuts[f][b]
            cut = np.where(np.isfinite(threshold[first:first + nodes]), best % self.bins, self.bins)
            place = 2 * place + (codes[np.arange(n), feature[first + place]] > cut[place])
        grads, hess = np.bincount(place, g, 2 ** self.depth), np.bincount(place, h, 2 ** self.depth)
        return (feature, threshold, -grads / (hess + self.ridge)), place

    def log_proba(self, x: np.ndarray) -> np.ndarray:
        score = np.tile(self.base, (len(x), 1))
        rows = np.arange(len(x))
        for trees in self.trees:
            for c, (feature, threshold, value) in enumerate(trees):
                place = np.zeros(len(x), np.int64)
                for _ in range(self.depth):
                    place = 2 * place + 1 + (x[rows, feature[place]] > threshold[place])
                score[:, c] += self.rate * value[place - (2 ** self.depth - 1)]
        return score - np.logaddexp.reduce(score, axis=1, keepdims=True)


def softmax(score: np.ndarray) -> np.ndarray:
    e = np.exp(score - score.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)
