"""Ledger lines to daily tables, at SKU, item and category grain."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greengrain.functions.exprs import ratio

# Exact integer sums: every value in units of its own scale, products in units of both. Whole numbers add up the
# same in any order, so a retry or another partitioning cannot change a digit, and they stay inside code
# generation (wide decimals do not).
SUMS = ("gross_u", "return_u", "all_u", "revenue_u", "cost_u", "loss_u")


class Digits(NamedTuple):
    """Decimal places of the ledger: weights have three, prices and rates two."""
    quantity: int = 3
    money: int = 2
    rate: int = 2


DIGITS = Digits()


def _units(name: str, digits: int) -> Column:
    """The value in units of 10^-digits; a value with more places stops the job instead of being rounded."""
    scaled = F.col(name).cast("double") * float(10 ** digits)
    whole = F.round(scaled)
    fits = scaled.isNull() | ((F.abs(scaled - whole) <= 1e-9 * F.greatest(F.lit(1e3), F.abs(scaled))) & (F.abs(whole) < 2.0 ** 53))
    return F.when(fits, whole.cast("long")).otherwise(
        F.raise_error(F.concat(F.lit(f"{name} has more than {digits} decimal places: "), F.col(name).cast("string"))).cast("long"))


def daily_sku_sums(ledger: DataFrame, digits: Digits = DIGITS) -> DataFrame:
    """Ledger (date, sku, is_return, quantity, amount, discount, loss) to one row per (date, sku).

    Runs before any join: a SKU with a third of all lines leaves each map task as at
    most one row per day.
    """
    q, sold = _units("quantity", digits.quantity), ~F.col("is_return")
    paid = _units("amount", digits.money) * (10 ** digits.rate - _units("discount", digits.rate))
    return ledger.groupBy("date", "sku").agg(
        F.sum(F.when(sold, q).otherwise(0)).alias("gross_u"),
        F.sum(F.when(sold, 0).otherwise(q)).alias("return_u"),
        F.sum(q).alias("all_u"),
        F.sum(F.when(sold, paid).otherwise(0)).alias("revenue_u"),
        F.sum(q * _units("loss", digits.rate)).alias("loss_u"),
        F.count(F.lit(1)).alias("line_count"),
    )


def sku_totals(ledger: DataFrame, digits: Digits = DIGITS) -> DataFrame:
    """Ledger to exact gross sums per SKU over all days; a map task leaves one row per SKU, not one per SKU and day."""
    q, sold = _units("quantity", digits.quantity), ~F.col("is_return")
    paid = _units("amount", digits.money) * (10 ** digits.rate - _units("discount", digits.rate))
    return ledger.groupBy("sku").agg(
        F.sum(F.when(sold, q).otherwise(0)).alias("gross_u"), F.sum(F.when(sold, paid).otherwise(0)).alias("revenue_u"))


def totals_per_sku(named: DataFrame, digits: Digits = DIGITS) -> DataFrame:
    """Totals in units with a category to one row (sku, category_name, qty, revenue)."""
    return named.groupBy("sku").agg(F.first("category_name").alias("category_name"),
                                    (F.sum("gross_u") / float(10 ** digits.quantity)).alias("qty"),
                                    (F.sum("revenue_u") / float(10 ** (digits.money + digits.rate))).alias("revenue"))


def attach_dimension(sums: DataFrame, dimension: DataFrame, digits: Digits = DIGITS) -> DataFrame:
    """Join SKU attributes (sku, category_name, item_name, sku_name, unit_cost) and cost out the day.

    Sales of a SKU that the dimension does not know stay, under the names `unknown` and without a cost.
    """
    named = sums.join(dimension, "sku", "left")
    return named.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in ("category_name", "item_name", "sku_name")}
                             ).withColumn("cost_u", F.col("all_u") * _units("unit_cost", digits.money))


def measures(df: DataFrame, keys: list[str], extra: list[str] = (), digits: Digits = DIGITS) -> DataFrame:
    """Turn exact sums into the daily measures; prices are NULL on a day without gross sales."""
    per_quantity = float(10 ** digits.quantity)
    gross, everything = F.col("gross_u") / per_quantity, F.col("all_u") / per_quantity
    revenue = F.col("revenue_u") / float(10 ** (digits.money + digits.rate))
    return df.select(
        *keys, *extra,
        gross.alias("gross_sales_qty"),
        (F.col("return_u") / per_quantity).alias("return_qty"),
        (gross - F.col("return_u") / per_quantity).alias("net_sales_qty"),
        revenue.alias("gross_revenue"),
        ratio(revenue, gross).alias("gross_weighted_avg_price"),
        ratio(F.col("cost_u") / (per_quantity * 10 ** digits.money), everything).alias("wholesale_price"),
        ratio(F.lit(100.0) * (F.col("loss_u") / (per_quantity * 10 ** digits.rate)), everything).alias("loss_rate_pct"),
    )


COUNTS = ["active_sku_count", "available_sku_count"]


def rolled_sums(sku_sums: DataFrame, keys: list[str]) -> DataFrame:
    """Daily SKU sums to exact sums per (date, *keys), with SKU counts.

    The input has one row per (date, sku), so plain counts replace distinct ones.
    """
    return sku_sums.groupBy("date", *keys).agg(
        *[F.sum(s).alias(s) for s in SUMS],
        F.count_if(F.col("gross_u") > 0).alias("active_sku_count"),
        F.count(F.lit(1)).alias("available_sku_count"))


def add_up(rolled: DataFrame, keys: list[str]) -> DataFrame:
    """Rolled sums to coarser keys: whole numbers and counts add up to what a pass over the SKUs gives."""
    return rolled.groupBy("date", *keys).agg(*[F.sum(s).alias(s) for s in (*SUMS, *COUNTS)])


def daily_measures(rolled: DataFrame, keys: list[str]) -> DataFrame:
    return measures(rolled, ["date", *keys], COUNTS)


def roll_up(sku_sums: DataFrame, keys: list[str]) -> DataFrame:
    """Daily SKU sums to daily measures per (date, *keys), with SKU counts."""
    return daily_measures(rolled_sums(sku_sums, keys), keys)
