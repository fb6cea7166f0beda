"""Calendars, fills, lags and rolling measures over daily series.

Windows here are partitioned by entity on a daily grid, so a partition holds at most one
row per calendar day whatever the size of the ledger behind it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from greengrain.functions.exprs import clip, ratio


def by_day(entity: str) -> Window:
    return Window.partitionBy(entity).orderBy("date")


def date_bounds(df: DataFrame) -> tuple[Column, Column]:
    """First and last date as scalar subqueries, evaluated once inside the plan."""
    return (df.select(F.min("date")).scalar(), df.select(F.max("date")).scalar())


def dense_calendar(df: DataFrame, entity: str, zero: list[str], extra_days: int = 0,
                   keep: list[str] = ()) -> DataFrame:
    """Every entity on every day of the whole range; `zero` columns become 0 on missing days.

    With `extra_days`, future rows follow with is_history false and NULL measures.
    """
    first, last = date_bounds(df)
    days = F.sequence(first, F.date_add(last, extra_days), F.expr("interval 1 day"))
    grid = df.select(entity).distinct().select(entity, F.explode(days).alias("date"))
    is_history = F.col("date") <= last
    out = grid.join(df.select("date", entity, *zero, *keep), [entity, "date"], "left")
    filled = [F.when(is_history, F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType))).alias(c)
              for c in zero]
    flag = [is_history.alias("is_history")] if extra_days else []
    return out.select(entity, "date", *flag, *filled, *keep)


def span_calendar(df: DataFrame, entity: str, value: str) -> DataFrame:
    """0 on missing days inside the entity's own first..last positive day, NULL outside."""
    spans = df.where(F.col(value) > 0).groupBy(entity).agg(
        F.min("date").alias("_first"), F.max("date").alias("_last"))
    dense = dense_calendar(df, entity, [value])
    return (dense.join(spans, entity, "left")
            .select(entity, "date", F.when(F.col("date").between(F.col("_first"), F.col("_last")),
                                           F.col(value)).alias(value)))


def calendar_features(df: DataFrame, entity: str) -> DataFrame:
    """Cyclic weekday, day-of-year and month, and a 0..1 trend over each entity's rows."""
    def cycle(name: str, value: Column, period: float) -> list[Column]:
        angle = value * F.lit(2 * math.pi) / F.lit(period)
        return [F.sin(angle).alias(f"{name}_sin"), F.cos(angle).alias(f"{name}_cos")]

    last_row = F.greatest(F.lit(1), F.count(F.lit(1)).over(Window.partitionBy(entity)) - 1)
    trend = (F.row_number().over(by_day(entity)) - 1) / last_row
    return df.select("*", *cycle("dow", F.weekday("date"), 7.0),
                     *cycle("doy", F.dayofyear("date"), 365.25),
                     *cycle("month", F.month("date"), 12.0), trend.alias("trend"))


def lag_of(value: str, days: int, entity: str) -> Column:
    return F.lag(value, days).over(by_day(entity))


def rolling(value: str, entity: str, length: int, shift: int, how: str = "mean") -> Column:
    """Mean or sample deviation of `length` rows ending `shift` rows ago; NULL unless all are there."""
    frame = by_day(entity).rowsBetween(-(shift + length - 1), -shift)
    measure = F.avg(value) if how == "mean" else F.stddev_samp(value)
    return F.when(F.count(value).over(frame) == length, measure.over(frame))


def fill_gaps(value: str, entity: str, within: Column | None = None) -> Column:
    """Last known value, and before the first one the next known value.

    The backward part looks ahead on leading rows.
    """
    seen = F.col(value) if within is None else F.when(within, F.col(value))
    past = by_day(entity).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # only leading rows lack a past value, and the next one they see is the first of all;
    # a frame that starts at the current row would be rescanned for every row
    whole = by_day(entity).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = F.coalesce(F.last(seen, ignorenulls=True).over(past),
                        F.first(seen, ignorenulls=True).over(whole))
    return filled if within is None else F.when(within, filled)


def month_demeaned_log(value: str, entity: str) -> Column:
    """log1p of the quantity minus its mean over the same entity and calendar month of the same year."""
    logged = F.when(F.col(value).isNotNull(), F.log1p(F.greatest(F.col(value), F.lit(0.0))))
    return logged - F.avg(logged).over(Window.partitionBy(entity, F.trunc("date", "month")))


def daily_share(df: DataFrame, value: str) -> DataFrame:
    """Share of the day's total; NULL on a day without sales and where the value is NULL.

    The day totals are aggregated and joined back: a window by date would hold all
    entities of a day in one task.
    """
    totals = df.groupBy("date").agg(F.sum(value).alias("_total"))
    return (df.join(totals, "date")
            .withColumn("share", ratio(value, "_total")).drop("_total"))


def winsorized(df: DataFrame, entity: str, values: dict[str, str], low: float = 0.01,
               high: float = 0.99) -> DataFrame:
    """Clip each value at the entity's own tail quantiles and subtract the mean of the clipped values.

    `values` maps a column to the name of its centered copy; all share one pass.
    """
    tails = df.groupBy(entity).agg(*[
        F.percentile(v, F.array(F.lit(low), F.lit(high))).alias(f"_{v}") for v in values])
    clipped = df.join(tails, entity).select("*", *[
        clip(v, F.col(f"_{v}")[0], F.col(f"_{v}")[1]).alias(f"_c_{v}") for v in values])
    whole = Window.partitionBy(entity)
    return (clipped.select("*", *[(F.col(f"_c_{v}") - F.avg(f"_c_{v}").over(whole)).alias(name)
                                  for v, name in values.items()])
            .drop(*[f"_{v}" for v in values], *[f"_c_{v}" for v in values]))


def change_quantile(df: DataFrame, entity: str, value: str, p: float = 0.90) -> DataFrame:
    """Quantile of the absolute day-to-day change."""
    change = df.withColumn("_change", F.abs(F.col(value) - lag_of(value, 1, entity)))
    return change.groupBy(entity).agg(F.percentile("_change", F.lit(p)).alias("change_quantile"),
                                      F.count("_change").alias("n_changes"))


def last_rows(df: DataFrame, entity: str, n: int) -> DataFrame:
    newest = Window.partitionBy(entity).orderBy(F.desc("date"))
    return df.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n).drop("_rn")


def decompose(df: DataFrame, entity: str, value: str, half_window: int = 182) -> DataFrame:
    """Additive split: centered moving average, weekday mean, day-of-year mean, remainder."""
    centered = by_day(entity).rowsBetween(-half_window, half_window)
    weekday = Window.partitionBy(entity, F.weekday("date"))
    yearday = Window.partitionBy(entity, F.dayofyear("date"))
    out = df.withColumn("trend", F.avg(value).over(centered))
    out = out.withColumn("weekly", F.avg(F.col(value) - F.col("trend")).over(weekday))
    out = out.withColumn("yearly", F.avg(F.col(value) - F.col("trend") - F.col("weekly")).over(yearday))
    return out.withColumn("residual", F.col(value) - F.col("trend") - F.col("weekly") - F.col("yearly"))
