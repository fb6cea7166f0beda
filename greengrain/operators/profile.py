"""Activity, monthly and seasonal profiles, and zero-inflation summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from greengrain.functions.exprs import SEASONS, at_least, fixed, ratio, sales_year, season_of
from greengrain.functions.ordered import exact_quantiles
from greengrain.operators.calendar import date_bounds

MONTHS = list(range(1, 13))


def activity(df: DataFrame, entity: str, value: str, min_span: int = 730, min_days: int = 90,
             min_total: float = 100.0, min_coverage: float | None = None) -> DataFrame:
    """Span, sale days and totals per entity, with pass flags and the reasons for leaving it out."""
    sold = F.col(value) > 0
    stats = df.groupBy(entity).agg(
        F.count(F.lit(1)).alias("record_days"),
        F.min(F.when(sold, F.col("date"))).alias("first_date"),
        F.max(F.when(sold, F.col("date"))).alias("last_date"),
        F.count_if(sold).alias("sales_days"),
        F.sum(value).alias("total_qty"))
    span = F.coalesce(F.datediff("last_date", "first_date") + 1, F.lit(0))
    out = stats.withColumn("span_days", span)
    out = out.withColumn("coverage", ratio("record_days", "span_days"))
    rules = {"span": F.col("span_days") >= min_span, "sales_days": F.col("sales_days") >= min_days,
             "total_qty": F.coalesce(F.col("total_qty"), F.lit(0.0)) >= min_total}
    if min_coverage is not None:
        rules["coverage"] = F.coalesce(F.col("coverage"), F.lit(0.0)) >= min_coverage
    failed = F.concat_ws(";", *[F.when(~ok, F.lit(label)) for label, ok in rules.items()])
    for label, ok in rules.items():
        out = out.withColumn(f"pass_{label}", ok)
    return (out.withColumn("included", failed == "")
            .withColumn("selection_reason", F.when(failed == "", F.lit("included")).otherwise(failed)))


def month_totals(df: DataFrame, entity: str, value: str) -> DataFrame:
    """Sum, active days and calendar days per entity and calendar month of the whole date range.

    Facts are summed by month first; only the (entity, month) grid is made dense, never the
    (entity, day) grid. A month cut by the range counts only its days inside it.
    """
    first, last = date_bounds(df)
    month = F.trunc("date", "month")
    facts = df.groupBy(entity, month.alias("month_start")).agg(
        F.sum(value).alias("qty"), F.count_if(F.col(value) > 0).alias("active_days"))
    months = F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))
    grid = df.select(entity).distinct().select(entity, F.explode(months).alias("month_start"))
    days = (F.datediff(F.least(F.last_day("month_start"), last),
                       F.greatest(F.col("month_start"), first)) + 1)
    return grid.join(facts, [entity, "month_start"], "left").select(
        entity, sales_year("month_start").alias("sales_year"), F.month("month_start").alias("month"),
        F.coalesce("qty", F.lit(0.0)).alias("qty"),
        F.coalesce("active_days", F.lit(0)).alias("active_days"), days.alias("days"))


def monthly_profile(df: DataFrame, entity: str, value: str) -> DataFrame:
    """Mean daily rate, share of the sales year, active rate and seasonal index for 12 months."""
    per_month = month_totals(df, entity, value)
    year = Window.partitionBy(entity, "sales_year")
    year_total = F.sum("qty").over(year)
    rates = per_month.select(
        entity, "month", (F.col("qty") / F.col("days")).alias("_rate"),
        F.when(year_total > 0, F.col("qty") / year_total).alias("_share"),
        (F.col("active_days") / F.col("days")).alias("_active"))
    means = rates.groupBy(entity, "month").agg(
        F.avg("_rate").alias("avg_daily_sales"), F.avg("_share").alias("sales_proportion"),
        F.avg("_active").alias("active_rate"))
    # a range shorter than a year leaves months out; they are 0
    grid = means.select(entity).distinct().select(
        entity, F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    full = grid.join(means, [entity, "month"], "left").na.fill(0.0)
    mean_rate = F.avg("avg_daily_sales").over(Window.partitionBy(entity))
    return full.withColumn("seasonal_index",
                           F.coalesce(ratio(F.col("avg_daily_sales"), mean_rate), F.lit(0.0)))


def seasonal_profile(monthly: DataFrame, entity: str) -> DataFrame:
    """Season means of rate, active rate and index; shares add up over the season's months."""
    return monthly.groupBy(entity, season_of("month").alias("season")).agg(
        F.avg("avg_daily_sales").alias("avg_daily_sales"),
        F.sum("sales_proportion").alias("sales_proportion"),
        F.avg("active_rate").alias("active_rate"),
        F.avg("seasonal_index").alias("seasonal_index"))


def peaks(monthly: DataFrame, entity: str) -> DataFrame:
    """Peak month, its season and index, and how concentrated the seasons are.

    The earliest month wins a tie; indices that agree to nine digits are tied.
    """
    best = F.max_by(F.struct("month", "seasonal_index"), F.struct(fixed("seasonal_index", 9), -F.col("month")))
    season_share = [F.sum(F.when(season_of("month") == s, F.col("sales_proportion"))).alias(s)
                    for s in SEASONS]
    agg = monthly.groupBy(entity).agg(best.alias("_best"), *season_share)
    return agg.select(
        entity, F.col("_best.month").alias("peak_month"),
        F.col("_best.seasonal_index").alias("peak_month_index"),
        season_of("_best.month").alias("peak_season"),
        (F.greatest(*SEASONS) / (F.least(*SEASONS) + F.lit(1e-12))).alias("season_concentration"))


def index_table(monthly: DataFrame, entity: str) -> DataFrame:
    """One row per entity with the 12 seasonal indices side by side."""
    wide = monthly.groupBy(entity).pivot("month", MONTHS).agg(F.first("seasonal_index"))
    return wide.select(entity, *[F.col(str(m)).alias(f"month_{m}") for m in MONTHS])


def zero_inflation(df: DataFrame, entity: str, value: str) -> DataFrame:
    """Moments over all days of a dense series, and over its positive days."""
    v, positive = F.col(value), F.when(F.col(value) > 0, F.col(value))
    return df.groupBy(entity).agg(
        F.count(v).alias("n_days"),
        (F.count_if(v <= 0) / F.count(v)).alias("zero_share"),
        F.avg(v).alias("mean_qty"), F.percentile(v, F.lit(0.5)).alias("median_qty"),
        F.stddev_pop(v).alias("std_qty"),
        # a constant series has no skewness
        F.when(F.stddev_pop(v) > 0, F.skewness(v)).alias("skewness"),
        F.count(positive).alias("n_positive"), F.avg(positive).alias("positive_mean"),
        F.percentile(positive, F.lit(0.5)).alias("positive_median"),
        F.stddev_pop(positive).alias("positive_std"))


def distinct_counts(df: DataFrame, entity: str, columns: list[str]) -> DataFrame:
    """Distinct non-NULL values per entity, one column at a time.

    Each (entity, value) pair is collapsed before counting, so a hot entity is spread over
    its values, and no row is copied once per counted column.
    """
    out = None
    for c in columns:
        one = (df.where(F.col(c).isNotNull()).groupBy(entity, c).agg(F.lit(1).alias("_one"))
               .groupBy(entity).agg(F.count("_one").alias(f"distinct_{c}")))
        out = one if out is None else out.join(one, entity, "full_outer")
    return out.na.fill(0)


def box_stats(df: DataFrame, entity: str, value: str) -> DataFrame:
    """Quartiles, whisker ends within 1.5 IQR and outlier count of log10(1 + positive values)."""
    logged = df.where(F.col(value) > 0).select(
        entity, (F.log1p(at_least(value, 0.0)) / F.log(F.lit(10.0))).alias("_v"))
    quartiles = exact_quantiles(logged, [entity], "_v", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    inside = F.col("_v").between(F.col("q1") - reach, F.col("q3") + reach)
    return (logged.join(quartiles, entity).groupBy(entity, "q1", "median", "q3")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
                 F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
                 F.count_if(~inside).alias("outliers")))


def cluster_features(monthly: DataFrame, entity: str, group: list[str] = ()) -> DataFrame:
    """12 month shares and 12 active rates, each standardized over the entities of a group; constant columns are 0."""
    names = [f"prop_month_{m}" for m in MONTHS] + [f"active_month_{m}" for m in MONTHS]
    wide = monthly.groupBy(*group, entity).agg(
        *[F.max(F.when(F.col("month") == m, F.col("sales_proportion"))).alias(f"prop_month_{m}") for m in MONTHS],
        *[F.max(F.when(F.col("month") == m, F.col("active_rate"))).alias(f"active_month_{m}") for m in MONTHS])
    # one row of means and deviations per group, a scalar subquery where there is one group
    spread = F.struct(*[F.avg(n).alias(f"mean_{n}") for n in names], *[F.stddev_pop(n).alias(f"std_{n}") for n in names]).alias("_s")
    out = wide.join(wide.groupBy(*group).agg(spread), [*group]) if group else wide.withColumn("_s", wide.agg(spread).scalar())
    return out.select(*group, entity, *[
        F.coalesce(ratio(F.col(n) - F.col(f"_s.mean_{n}"), F.col(f"_s.std_{n}")), F.lit(0.0)).alias(n)
        for n in names])
