"""Maximum-likelihood fits of one positive sample, used inside Arrow batches."""

from __future__ import annotations

import math

import numpy as np

FAMILIES = ("Normal", "Lognormal", "Gamma", "Weibull")


def _digamma(x: float, order: int = 0) -> float:
    """Digamma (order 0) or trigamma (order 1) by upward recurrence and an asymptotic series."""
    total = 0.0
    while x < 8.0:
        total += -1.0 / x if order == 0 else 1.0 / (x * x)
        x += 1.0
    f = 1.0 / (x * x)
    if order == 0:
        return total + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f / 240)))
    return total + 1.0 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f / 30)))


def gamma_shape(mean: float, mean_log: float, steps: int = 30) -> float:
    gap = math.log(mean) - mean_log
    k = (3.0 - gap + math.sqrt((gap - 3.0) ** 2 + 24.0 * gap)) / (12.0 * gap)
    for _ in range(steps):
        k = max(k - (math.log(k) - _digamma(k) - gap) / (1.0 / k - _digamma(k, 1)), 1e-9)
    return k


def weibull_shape(x: np.ndarray, steps: int = 60) -> float:
    logs = np.log(x)
    scaled, mean_log = logs - logs.max(), float(logs.mean())
    k = 1.2 / max(float(logs.std()), 1e-9)
    for _ in range(steps):
        w = np.exp(k * scaled)
        m0, m1, m2 = w.sum(), (w * logs).sum(), (w * logs * logs).sum()
        slope = (m2 * m0 - m1 * m1) / (m0 * m0) + 1.0 / (k * k)
        k = max(k - (m1 / m0 - 1.0 / k - mean_log) / slope, k / 2)
    return k


def gamma_cdf(shape: float, x: np.ndarray) -> np.ndarray:
    """Regularized lower incomplete gamma function by its power series, all values at once."""
    term = np.full(len(x), 1.0 / shape)
    total, n = term.copy(), shape
    for _ in range(2000):
        n += 1.0
        term = term * x / n
        total += term
        if np.all(term <= total * 1e-15):
            break
    return np.clip(total * np.exp(shape * np.log(x) - x - math.lgamma(shape)), 0.0, 1.0)


def kolmogorov_p(distance: float, n: int) -> float:
    t = distance * math.sqrt(n)
    if t < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2.0 * sum((-1) ** (j - 1) * math.exp(-2.0 * j * j * t * t) for j in range(1, 101))))


def fit_all(x: np.ndarray) -> list[tuple]:
    """(family, parameter_1, parameter_2, log_likelihood, aic, ks_statistic, ks_p) per family."""
    x = np.sort(x)
    n, logs = len(x), np.log(x)
    mean, std, mean_log, std_log = x.mean(), x.std(), logs.mean(), logs.std()
    if std <= 0:
        return []
    erf = np.vectorize(math.erf)
    k, c = gamma_shape(mean, mean_log), weibull_shape(x)
    theta = mean / k
    scale = float(np.exp(logs.max()) * np.mean(np.exp(c * (logs - logs.max()))) ** (1.0 / c))
    fitted = [
        ("Normal", mean, std, -n / 2 * (math.log(2 * math.pi * std**2) + 1), 0.5 * (1 + erf((x - mean) / std / math.sqrt(2)))),
        ("Lognormal", std_log, math.exp(mean_log), -n / 2 * (math.log(2 * math.pi * std_log**2) + 1) - logs.sum(),
         0.5 * (1 + erf((logs - mean_log) / std_log / math.sqrt(2)))),
        ("Gamma", k, theta, n * ((k - 1) * mean_log - mean / theta - k * math.log(theta) - math.lgamma(k)), gamma_cdf(k, x / theta)),
        ("Weibull", c, scale, n * (math.log(c) - c * math.log(scale) + (c - 1) * mean_log) - float(np.sum((x / scale) ** c)),
         1.0 - np.exp(-((x / scale) ** c))),
    ]
    rank = np.arange(1, n + 1)
    out = []
    for name, p1, p2, likelihood, cdf in fitted:
        distance = float(max(np.max(rank / n - cdf), np.max(cdf - (rank - 1) / n)))
        out.append((name, float(p1), float(p2), float(likelihood), float(4 - 2 * likelihood), distance, kolmogorov_p(distance, n)))
    return out
