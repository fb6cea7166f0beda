"""Column expressions used across operators. All of them stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Season names in order, and the months of each season.
SEASONS = ("spring", "summer", "autumn", "winter")
LOG_LIMIT = 700.0


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fixed(c: Column | str, digits: int = 6) -> Column:
    """Round half up through floor, the same on every engine (plain round is not)."""
    scale = float(10**digits)
    scaled = col(c) * F.lit(scale) + F.lit(0.5)
    # floor gives a BIGINT; a double beyond 2^53 has no digits left to round
    return F.when(F.abs(scaled) >= F.lit(2.0**53), col(c)).otherwise(F.floor(scaled) / F.lit(scale))


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den, NULL when the denominator is 0."""
    return col(num) / F.nullif(col(den), F.lit(0.0))


def clip(c: Column | str, low, high) -> Column:
    """Clamp to [low, high]; NULL stays NULL (least/greatest alone would skip it)."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(col(c).isNotNull(), F.least(F.greatest(col(c), low), high))


def at_least(c: Column | str, floor) -> Column:
    floor = floor if isinstance(floor, Column) else F.lit(floor)
    return F.when(col(c).isNotNull(), F.greatest(col(c), floor))


def draw(*keys: Column | str | int) -> Column:
    """A reproducible 32-bit draw from a key: the first 8 hex digits of its md5.

    Unlike rand(), the value depends on the key alone, so a lost executor, a retry or
    another partitioning gives the same draw.
    """
    parts = [k.cast("string") if isinstance(k, Column) else
             (F.col(k).cast("string") if isinstance(k, str) else F.lit(str(k))) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def season_of(month: Column | str) -> Column:
    m = col(month)
    return (F.when(m.between(3, 5), SEASONS[0]).when(m.between(6, 8), SEASONS[1])
            .when(m.between(9, 11), SEASONS[2]).otherwise(SEASONS[3]))


def season_rank(season: Column | str) -> Column:
    s = col(season)
    return (F.when(s == SEASONS[0], 1).when(s == SEASONS[1], 2)
            .when(s == SEASONS[2], 3).otherwise(4))


def sales_year(date: Column | str) -> Column:
    """A sales year starts in July and carries the calendar year of its start."""
    return F.year(col(date)) - F.when(F.month(col(date)) < 7, 1).otherwise(0)


def log_qty(c: Column | str) -> Column:
    return F.log1p(at_least(c, 0.0))


def log_price(c: Column | str) -> Column:
    return F.log(at_least(c, 1e-6))


def level_from_log(c: Column | str) -> Column:
    """Back from log1p to a quantity, floored at 0; unknown stays unknown. The clip only keeps a double from overflowing."""
    return at_least(F.expm1(clip(c, -LOG_LIMIT, LOG_LIMIT)), 0.0)


def markup(price: Column | str, cost: Column | str) -> Column:
    return ratio(price, cost) - F.lit(1.0)


def elastic_response(price: Column | str, reference: Column | str, elasticity: Column | str) -> Column:
    return F.pow(col(price) / col(reference), col(elasticity))


def tenth(c: Column | str) -> Column:
    return F.floor(col(c) * 10.0 + 0.5) / F.lit(10.0)


def tenth_up(c: Column | str) -> Column:
    return F.ceil(col(c) * 10.0 - 1e-9) / F.lit(10.0)


def tenth_down(c: Column | str) -> Column:
    return F.floor(col(c) * 10.0 + 1e-9) / F.lit(10.0)


def _poly(x: Column, coefficients) -> Column:
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + F.lit(c)
    return out


# The published error-function polynomial of Abramowitz and Stegun, 7.1.26
# (highest power first), and its argument scale.
ERF_POLY = (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592, 0.0)
ERF_SCALE = 0.3275911

# Acklam's published rational approximation of the normal quantile.
QUANTILE_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
              1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
QUANTILE_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
              6.680131188771972e01, -1.328068155288572e01, 1.0)
QUANTILE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
              -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
QUANTILE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
              3.754408661907416e00, 1.0)
QUANTILE_TAIL = 0.02425


def two_sided_normal_p(z: Column | str) -> Column:
    """P(|N(0,1)| >= |z|), absolute error below 2e-7."""
    x = F.abs(col(z)) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_SCALE) * x)
    return _poly(t, ERF_POLY) * F.exp(-x * x)


def correlation_p(r: Column | str, n: Column | str) -> Column:
    """Two-sided p of a correlation by Fisher's z; 0 when |r| reaches 1."""
    r, n = col(r), col(n)
    inside = F.abs(r) < 1.0
    z = F.when(inside, 0.5 * F.log((1.0 + F.when(inside, r)) / (1.0 - F.when(inside, r)))
               * F.sqrt(F.greatest(n - 3, F.lit(0)).cast("double")))
    return F.coalesce(two_sided_normal_p(z), F.lit(0.0))


def normal_quantile(p: Column | str) -> Column:
    p = col(p)
    centre = p - 0.5
    square = centre * centre
    middle = _poly(square, QUANTILE_A) * centre / _poly(square, QUANTILE_B)
    low_q = F.sqrt(-2.0 * F.log(p))
    high_q = F.sqrt(-2.0 * F.log(1.0 - p))
    low = _poly(low_q, QUANTILE_C) / _poly(low_q, QUANTILE_D)
    high = -_poly(high_q, QUANTILE_C) / _poly(high_q, QUANTILE_D)
    return F.when(p < QUANTILE_TAIL, low).when(p > 1 - QUANTILE_TAIL, high).otherwise(middle)
