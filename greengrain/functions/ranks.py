"""Small numpy helpers for daily series, used inside Arrow batches."""

from __future__ import annotations

import hashlib
import math

import numpy as np

# Gauss-Legendre nodes of student_p, made once
NODES, WEIGHTS = np.polynomial.legendre.leggauss(96)


def average_ranks(values: np.ndarray) -> np.ndarray:
    """1-based ranks; equal values share their mean rank."""
    _, where, counts = np.unique(values, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2.0)[where]


def centered_ranks(rows: np.ndarray) -> np.ndarray:
    """Twice the rank minus its mean for every row of a matrix; equal values share their mean rank.

    The values are whole numbers, so sums of their products are exact in any order.
    """
    n = rows.shape[1]
    order = np.argsort(rows, axis=1, kind="stable")
    ordered = np.take_along_axis(rows, order, axis=1)
    place = np.arange(n)
    opens = np.ones(rows.shape, bool)
    opens[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    closes = np.ones(rows.shape, bool)
    closes[:, :-1] = opens[:, 1:]
    first = np.maximum.accumulate(np.where(opens, place, 0), axis=1)
    last = np.minimum.accumulate(np.where(closes, place, n)[:, ::-1], axis=1)[:, ::-1]
    out = np.empty(rows.shape)
    np.put_along_axis(out, order, first + last - (n - 1.0), axis=1)
    return out


def rank_products(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Spearman's rho of every row of u with every row of v, both as centered ranks; 0 where a side is constant."""
    scale = np.sqrt(np.outer((u * u).sum(axis=1), (v * v).sum(axis=1)))
    return np.divide(u @ v.T, scale, out=np.zeros(scale.shape), where=scale > 0)


def common_days(x: np.ndarray, y: np.ndarray):
    """(rows of x, rows of y, days) for each combination of observed days in two blocks of series."""
    def patterns(block: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        seen, which = np.unique(np.isfinite(block), axis=0, return_inverse=True)
        return [(np.flatnonzero(which.ravel() == k), mask) for k, mask in enumerate(seen)]
    left, right = patterns(x), patterns(y)
    for rows, a in left:
        for columns, b in right:
            yield rows, columns, np.flatnonzero(a & b)


def resampled(x: np.ndarray, y: np.ndarray, days: np.ndarray) -> np.ndarray:
    """[draw, row of x, row of y] rank correlations on drawn days; every draw ranks a block of series at once.

    Drawn values are ranked by counting how often each distinct value was drawn, without sorting.
    """
    def codes(block: np.ndarray) -> np.ndarray:
        return np.stack([np.unique(row, return_inverse=True)[1] for row in block])

    def ranked(code: np.ndarray, base: np.ndarray, width: int, drawn: np.ndarray) -> np.ndarray:
        at = code[:, drawn] + base
        counts = np.bincount(at.ravel(), minlength=len(code) * width).reshape(len(code), width)
        twice = (2 * np.cumsum(counts, axis=1) - counts).astype(float)
        return twice.ravel()[at] - len(drawn)
    sides = []
    for block in (x, y):
        code = codes(block)
        width = int(code.max()) + 1
        sides.append((code, (np.arange(len(code)) * width)[:, None], width))
    return np.stack([rank_products(*(ranked(*side, drawn) for side in sides)) for drawn in days])


def student_p(r: float, n: int) -> float:
    """Two-sided p of one correlation from Student's t."""
    return float(student_ps(np.array([r]), n)[0])


def student_ps(r: np.ndarray, n: int) -> np.ndarray:
    """Two-sided p of correlations over n days from Student's t, as the incomplete beta I(1 - r^2; (n-2)/2, 1/2)."""
    size = np.abs(r)
    if n < 3:
        return np.ones(r.shape)
    # I(x) = integral of u^(a-1) (1-u)^(-1/2) / B; with u = 1 - s^2 the end point singularity goes away
    a = (n - 2) / 2.0
    log_scale = math.lgamma(a + 0.5) - math.lgamma(a) - math.lgamma(0.5)
    low, high = np.minimum(size, 1.0), np.minimum(1.0, size + 14.0 / math.sqrt(2.0 * a + 1.0))
    s = low[..., None] + (high - low)[..., None] * (NODES + 1.0) / 2.0
    inner = np.maximum(1.0 - s * s, 1e-300)
    density = np.exp(log_scale + (a - 1.0) * np.log(inner))
    # two tails of (high - low) / 2 each
    return np.where(size >= 1.0, 0.0, np.minimum(1.0, (high - low) * (density @ WEIGHTS)))


def block_starts(seed: int, reps: int, blocks: int) -> np.ndarray:
    """(reps, blocks) draws, the same values as exprs.draw(seed, rep, block)."""
    return np.array([[int(hashlib.md5(f"{seed}:{r}:{b}".encode()).hexdigest()[:8], 16)
                      for b in range(blocks)] for r in range(reps)], dtype=np.int64)


def _stacked_bins(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 0/1 column per quantile bin, for every bin count side by side; equal values share a bin."""
    place = (average_ranks(values)[:, None] - 1.0) * counts / len(values)
    own = np.minimum(place.astype(np.int64), counts - 1) + np.cumsum(counts) - counts
    out = np.zeros((len(values), int(counts.sum())))
    out[np.arange(len(values))[:, None], own] = 1.0
    return out


def _weighted_logs(hits: np.ndarray) -> np.ndarray:
    return hits * np.log(np.maximum(hits, 1.0))


def information_score(x: np.ndarray, y: np.ndarray, exponent: float = 0.6, max_bins: int = 12) -> float:
    """Largest mutual information over bin grids, each divided by the log of its shorter side.

    One matrix product counts the cells of all grids. A grid's information is H(x) + H(y) - H(x, y), and each entropy
    is log n minus the mean of count * log count over its cells, which is a block sum.
    """
    n = len(x)
    budget = max(4, int(n ** exponent))
    counts = np.arange(2, min(max_bins, budget // 2) + 1)
    if n == 0 or not len(counts):
        return 0.0
    left, right = _stacked_bins(x, counts), _stacked_bins(y, counts)
    starts = np.cumsum(counts) - counts
    cells = np.add.reduceat(np.add.reduceat(_weighted_logs(left.T @ right), starts, axis=0), starts, axis=1)
    rows = np.add.reduceat(_weighted_logs(left.sum(axis=0)), starts)
    columns = np.add.reduceat(_weighted_logs(right.sum(axis=0)), starts)
    information = np.log(n) + (cells - rows[:, None] - columns) / n
    share = information / np.log(np.minimum.outer(counts, counts))
    return float(np.clip(share[np.multiply.outer(counts, counts) <= budget], 0.0, 1.0).max(initial=0.0))
