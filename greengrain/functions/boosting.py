"""A small boosted regression on binned features, for one bounded group of rows inside a task."""

from __future__ import annotations

import numpy as np


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Cut points of each feature at quantiles of its values."""
    return [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T)], axis=1)


class Trees:
    """Additive trees for squared error: the leaf with the largest gain is split first, until `leaves` are reached."""

    def __init__(self, rounds: int = 300, step: float = 0.045, leaves: int = 15, least: int = 20, ridge: float = 1.0, bins: int = 64):
        self.rounds, self.step, self.leaves, self.least, self.ridge, self.bins = rounds, step, leaves, least, ridge, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges, self.start, self.trees = bin_edges(x, self.bins), float(y.mean()), []
        code = binned(x, self.edges)
        flat = code + np.arange(code.shape[1]) * self.bins
        rest = y - self.start
        for _ in range(self.rounds):
            tree, fitted = self._grow(code, flat, rest)
            if len(tree) == 1:
                break
            self.trees.append(tree)
            rest = rest - fitted
        return self

    def _best(self, flat: np.ndarray, rest: np.ndarray, rows: np.ndarray) -> tuple[float, int, int]:
        """(gain, feature, last bin of the left side) of the best split of these rows."""
        if len(rows) < 2 * self.least:
            return 0.0, -1, -1
        cells, shape = flat[rows].ravel(), (flat.shape[1], self.bins)
        n = np.cumsum(np.bincount(cells, minlength=shape[0] * shape[1]).reshape(shape), axis=1)
        s = np.cumsum(np.bincount(cells, np.repeat(rest[rows], shape[0]), shape[0] * shape[1]).reshape(shape), axis=1)
        m, total = len(rows), rest[rows].sum()
        part = lambda sums, count: sums ** 2 / np.maximum(count + self.ridge, 1e-12)
        gain = part(s, n) + part(total - s, m - n) - part(total, m)
        gain[(n < self.least) | (m - n < self.least)] = 0.0
        # a gain beyond the noise of summation; the first feature and bin win a tie
        best = int(np.argmax(np.round(gain, 9)))
        return float(gain.flat[best]), best // self.bins, best % self.bins

    def _grow(self, code: np.ndarray, flat: np.ndarray, rest: np.ndarray) -> tuple[list, np.ndarray]:
        """Nodes (feature, bin, left, right, value) and the fitted values of the rows."""
        nodes, held = [[-1, -1, -1, -1, 0.0]], {0: np.arange(len(rest))}
        offers = {0: self._best(flat, rest, held[0])}
        while len(held) < self.leaves:
            leaf = max(offers, key=lambda k: (offers[k][0], -k))
            gain, feature, cut = offers.pop(leaf)
            if gain <= 1e-9:
                break
            rows = held.pop(leaf)
            left = code[rows, feature] <= cut
            nodes[leaf][:4] = feature, cut, len(nodes), len(nodes) + 1
            for part in (rows[left], rows[~left]):
                held[len(nodes)] = part
                offers[len(nodes)] = self._best(flat, rest, part)
                nodes.append([-1, -1, -1, -1, 0.0])
        fitted = np.zeros(len(rest))
        for leaf, rows in held.items():
            nodes[leaf][4] = self.step * rest[rows].sum() / (len(rows) + self.ridge)
            fitted[rows] = nodes[leaf][4]
        return nodes, fitted

    def predict(self, x: np.ndarray) -> np.ndarray:
        code, out = binned(x, self.edges), np.full(len(x), self.start)
        every = np.arange(len(x))
        for tree in self.trees:
            t = np.array(tree)
            at = np.zeros(len(x), int)
            while (inner := t[at, 0] >= 0).any():
                f, c = t[at, 0].astype(int), t[at, 1]
                at = np.where(inner, np.where(code[every, np.maximum(f, 0)] <= c, t[at, 2], t[at, 3]).astype(int), at)
            out += t[at, 4]
        return out
