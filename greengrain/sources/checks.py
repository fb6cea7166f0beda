"""Data-quality rules as queries: each returns rows of (check, passed, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greengrain.functions.ordered import weighted_positions
from greengrain.functions.staging import stage


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def stack(df: DataFrame, violations: dict[str, Column], keys: list[str] = ()) -> DataFrame:
    """Count every violation in one pass, one output row per rule."""
    counts = df.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in violations.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in violations])
    return counts.select(*keys, F.explode(rows).alias("r")).select(
        *keys, "r.check", (F.col("r.violations") == 0).alias("passed"), "r.violations")


def table_rules(df: DataFrame, keys: list[str], non_negative: list[str]) -> DataFrame:
    """Rows, duplicate keys, negatives and NULLs of a daily table."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[
        F.count_if(F.col(c) < 0).alias(f"neg_{c}") for c in non_negative], *[
        F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in non_negative])
    return per_key.agg(F.sum("_n").alias("row_count"), F.count_if(F.col("_n") > 1).alias("duplicate_keys"),
                       F.min("date").alias("first_date"), F.max("date").alias("last_date"),
                       *[F.sum(f"{p}_{c}").alias(f"{p}_{c}") for p in ("neg", "null") for c in non_negative])


def reconcile(fine: DataFrame, coarse: DataFrame, keys: list[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    """Totals of the finer table against the coarser one, per key."""
    sums = fine.groupBy(*keys).agg(F.sum(value).alias("fine_total"))
    both = sums.join(coarse.groupBy(*keys).agg(F.sum(value).alias("coarse_total")), keys, "full_outer")
    gap = F.abs(F.coalesce("fine_total", F.lit(0.0)) - F.coalesce("coarse_total", F.lit(0.0)))
    return both.withColumn("gap", gap).withColumn("passed", gap <= tolerance)


def shares_sum_to_one(df: DataFrame, keys: list[str], share: str, tolerance: float = 1e-9) -> DataFrame:
    out = df.groupBy(*keys).agg(F.sum(share).alias("total"))
    return out.withColumn("passed", F.abs(F.col("total") - 1) <= tolerance)


def missing_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of left that right does not have."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti")


def completeness(df: DataFrame, entity: str, member: str, expected: int) -> DataFrame:
    out = df.groupBy(entity, member).agg(F.count(F.lit(1)).alias("_n")).groupBy(entity).agg(
        F.count(F.lit(1)).alias("found"), F.max("_n").alias("copies"))
    return out.withColumn("passed", (F.col("found") == expected) & (F.col("copies") == 1))


def monotone(df: DataFrame, order: str, value: str, keys: list[str] = (), falling: bool = False) -> DataFrame:
    """Whether value never moves the wrong way along the ordered variants (a few rows per key)."""
    from pyspark.sql import Window
    by = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(order)
    step = F.col(value) - F.lag(value).over(by)
    wrong = (step > 1e-9) if falling else (step < -1e-9)
    steps = df.withColumn("_wrong", wrong)
    agg = [F.count_if("_wrong").alias("wrong_steps"), F.count(F.lit(1)).alias("variants")]
    return (steps.groupBy(*keys).agg(*agg) if keys else steps.agg(*agg)).withColumn("passed", F.col("wrong_steps") == 0)


def ledger_quality(lines: DataFrame) -> DataFrame:
    """Per category: lines, returns, unknown and low prices, 1.5 IQR outliers, repeated lines, days with a cost but no sale.

    Lines are counted by (category, price) first; quartiles and outliers come from those counts, and the quartiles
    travel as one map, so no line is joined on its category.
    """
    priced = stage(lines.groupBy("category_name", "price").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_return").alias("returns")), "price_counts")
    limits = weighted_positions(priced.where("price is not null"), ["category_name"], "price", "n", {"q1": 0.25, "q3": 0.75})
    bounds = limits.agg(F.map_from_entries(F.collect_list(F.struct("category_name", F.struct("q1", "q3"))))).scalar()
    q = bounds[F.col("category_name")]
    reach = 1.5 * (q["q3"] - q["q1"])
    outside = (F.col("price") < q["q1"] - reach) | (F.col("price") > q["q3"] + reach)
    n = F.col("n")
    count = lambda test: F.sum(F.when(test, n).otherwise(0)).alias
    facts = priced.groupBy("category_name").agg(
        F.sum("n").alias("row_count"), F.sum("returns").alias("returns"), count(F.col("price").isNull())("null_prices"),
        count(F.col("price") <= 0.1)("low_prices"), count(outside)("outliers"), F.first(q["q1"]).alias("q1"), F.first(q["q3"]).alias("q3"))
    again = lines.groupBy("category_name", "sku", "date", "quantity", "price", "is_return").agg((F.count(F.lit(1)) - 1).alias("n")).groupBy(
        "category_name").agg(F.sum("n").alias("duplicate_lines"))
    sold = lines.groupBy("category_name", "sku", "date").agg(F.sum(F.when(~F.col("is_return"), F.col("quantity")).otherwise(0)).alias("q")).groupBy(
        "category_name").agg(F.count_if(F.col("q") == 0).alias("zero_sale_cost_pairs"))
    return facts.join(again, "category_name").join(sold, "category_name")
