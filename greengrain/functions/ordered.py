"""Running totals, ranks and exact quantiles for groups of any size.

A window partitioned by a hot key pulls the whole group into one task, and the built-in
exact percentile keeps every distinct value of a group in one buffer. The helpers here
first collapse equal values, then cut each group into value ranges at approximate
quantiles (a mergeable sketch of fixed size), total the ranges, and only then order the
rows inside each range. No task sees more than one range of one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from greengrain.functions.staging import stage

FINE, RANGE_ROWS = 1024, 50_000


def with_range(df: DataFrame, keys: list[str], value: str, range_rows: int | None = None) -> DataFrame:
    """Add `_range`, a value range number that rises with `value` inside each group (all rows without keys).

    The number of ranges follows from the group's rows, up to FINE. Rows that equal a cut have a range of their own (odd
    numbers), so a value that most rows share does not draw its neighbours along. The cuts are written once: a few groups
    make a small table, which Spark broadcasts by its size, so no hot key is a join key.
    """
    steps = F.array(*[F.lit(i / FINE) for i in range(1, FINE)])
    found = df.groupBy(*keys).agg(F.percentile_approx(value, steps, 4 * FINE).alias("_fine"), F.count(F.lit(1)).alias("_rows"))
    # every step-th fine cut
    step = F.greatest(F.lit(1), F.floor(F.lit(FINE) / F.ceil(F.col("_rows") / (range_rows or RANGE_ROWS)))).cast("int")
    cuts = found.select(*keys, F.array_distinct(F.filter("_fine", lambda c, i: (i + 1) % step == 0)).alias("_cuts"))
    if keys:
        cut = df.join(stage(cuts, "cuts"), keys)
    else:
        cut = df.withColumn("_cuts", cuts.scalar())
    below = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    return (cut.withColumn("_range", 2 * below + F.coalesce(F.array_contains("_cuts", F.col(value)), F.lit(False)).cast("int"))
            .drop("_cuts"))


def running_total(df: DataFrame, keys: list[str], value: str, weight: str,
                  before: str = "before", total: str = "total") -> DataFrame:
    """For rows with distinct `value` per group: weight of all smaller values, and of all values."""
    ranged = with_range(df, keys, value)
    per_range = ranged.groupBy(*keys, "_range").agg(F.sum(weight).alias("_w"))
    # at most 2 x FINE rows per group
    over_ranges = Window.partitionBy(*keys).orderBy("_range")
    offsets = per_range.select(
        *keys, "_range",
        (F.sum("_w").over(over_ranges) - F.col("_w")).alias("_offset"),
        F.sum("_w").over(Window.partitionBy(*keys)).alias(total))
    inside = Window.partitionBy(*keys, "_range").orderBy(value)
    return (ranged.join(offsets, [*keys, "_range"])
            .withColumn(before, F.col("_offset") + F.sum(weight).over(inside) - F.col(weight))
            .drop("_range", "_offset"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles, one column per name in `probs`, for groups of any size."""
    counted = (df.where(F.col(value).isNotNull()).groupBy(*keys, value)
               .agg(F.count(F.lit(1)).alias("_n")))
    return weighted_positions(counted, keys, value, "_n", probs)


def weighted_positions(counted: DataFrame, keys: list[str], value: str, count: str, probs: dict[str, float]) -> DataFrame:
    """The same quantiles of values that are already counted."""
    placed = running_total(counted, keys, value, count, "_before", "_all")
    out = []
    for name, p in probs.items():
        at = (F.col("_all") - 1) * F.lit(p)
        low, high = F.floor(at), F.ceil(at)
        holds = lambda k: (F.col("_before") <= k) & (k < F.col("_before") + F.col(count))
        low_v = F.max(F.when(holds(low), F.col(value)))
        high_v = F.max(F.when(holds(high), F.col(value)))
        share = F.max(at - low)
        out.append((low_v + (high_v - low_v) * share).alias(name))
    return placed.groupBy(*keys).agg(*out)


def _prefix(df: DataFrame, name: str) -> Column:
    """A number that rises with a column: itself, or the first bytes of a text."""
    if df.schema[name].dataType.simpleString() != "string":
        return F.col(name).cast("double")
    return F.conv(F.rpad(F.hex(F.encode(F.substring(name, 1, 12), "UTF-8")), 12, "0"), 16, 10).cast("double")


def row_numbers(df: DataFrame, keys: list[str], order: str, tie: list[str],
                number: str = "rn", total: str = "n") -> DataFrame:
    """Dense 1-based positions by (order, *tie) with the group size, for groups of any size.

    A range that holds a single value is cut once more by the first tie column, so a value on most rows is no task.
    """
    ranged = with_range(df, keys, order)
    if tie:
        ranged = with_range(ranged.withColumnRenamed("_range", "_first").withColumn("_tie", F.when(F.col("_first") % 2 == 1, _prefix(df, tie[0])).otherwise(0.0)),
                            [*keys, "_first"], "_tie").withColumnRenamed("_range", "_second").drop("_tie")
    else:
        ranged = ranged.withColumnRenamed("_range", "_first").withColumn("_second", F.lit(0))
    part = ["_first", "_second"]
    per_range = ranged.groupBy(*keys, *part).agg(F.count(F.lit(1)).alias("_w"))
    over_ranges = Window.partitionBy(*keys).orderBy(*part)
    offsets = per_range.select(
        *keys, *part, (F.sum("_w").over(over_ranges) - F.col("_w")).alias("_offset"),
        F.sum("_w").over(Window.partitionBy(*keys)).alias(total))
    inside = Window.partitionBy(*keys, *part).orderBy(order, *tie)
    return (ranged.join(offsets, [*keys, *part])
            .withColumn(number, F.col("_offset") + F.row_number().over(inside))
            .drop("_offset", *part))


def following_minimum(df: DataFrame, keys: list[str], value: str, measure: str,
                      name: str = "following_min") -> DataFrame:
    """For rows with distinct `value` per group: smallest `measure` at this or any larger value."""
    ranged = with_range(df, keys, value)
    per_range = ranged.groupBy(*keys, "_range").agg(F.min(measure).alias("_m"))
    later = Window.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = per_range.select(*keys, "_range", F.min("_m").over(later).alias("_beyond"))
    # descending order turns the suffix into a prefix, which is one pass
    inside = (Window.partitionBy(*keys, "_range").orderBy(F.desc(value))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (ranged.join(beyond, [*keys, "_range"])
            .withColumn(name, F.least(F.min(measure).over(inside), F.col("_beyond")))
            .drop("_range", "_beyond"))


def weighted_quantiles(df: DataFrame, keys: list[str], value: str, weight: str, tie: list[str],
                       probs: dict[str, float]) -> DataFrame:
    """Weighted quantiles by linear interpolation between mid-weight positions, flat beyond the ends.

    A row sits at (weight before it + half its own) / total, in the order (value, *tie).
    Equal values form a flat run from the position of the first to that of the last, so
    they are collapsed to one row that remembers both; this keeps the result exact.
    """
    use = df.where(F.col(value).isNotNull() & (F.col(weight) > 0))
    runs = use.groupBy(*keys, value).agg(
        F.sum(weight).alias("_w"), F.min_by(weight, F.struct(*tie)).alias("_first"),
        F.max_by(weight, F.struct(*tie)).alias("_last"))
    placed = running_total(runs, keys, value, "_w", "_before", "_all")
    placed = placed.withColumn("_enter", (F.col("_before") + F.col("_first") / 2) / F.col("_all"))
    placed = placed.withColumn("_leave", (F.col("_before") + F.col("_w") - F.col("_last") / 2) / F.col("_all"))
    aggs = []
    for name, p in probs.items():
        left = F.max(F.when(F.col("_enter") <= p, F.struct(F.least(F.lit(p), "_leave").alias("at"), F.col(value).alias("v"))))
        right = F.min(F.when(F.col("_leave") >= p, F.struct(F.greatest(F.lit(p), "_enter").alias("at"), F.col(value).alias("v"))))
        aggs += [left.alias(f"{name}_l"), right.alias(f"{name}_r")]
    sides = placed.groupBy(*keys).agg(*aggs)
    out = []
    for name, p in probs.items():
        a, b = F.col(f"{name}_l"), F.col(f"{name}_r")
        gap = F.nullif(b["at"] - a["at"], F.lit(0.0))
        between = a["v"] + (b["v"] - a["v"]) * F.coalesce((F.lit(p) - a["at"]) / gap, F.lit(0.0))
        out.append(F.coalesce(between, a["v"], b["v"]).alias(name))
    return sides.select(*keys, *out)
