"""Relationships between the daily series of entity pairs.

The result of these operators is one row per unordered pair of entities, so it grows with
the square of the entity count by definition. What must not grow with it is shuffled
data: each entity travels as one packed array per period, copied once per tile row or
column, and the pairs of a tile are formed inside one task. Nothing is grouped by date.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from greengrain.functions import ranks
from greengrain.functions.exprs import clip, draw, normal_quantile, ratio, season_of
from greengrain.functions.ordered import following_minimum, row_numbers, running_total
from greengrain.functions.staging import stage

WHOLE = "all"
SEED = 20230907


def by_period(df: DataFrame) -> DataFrame:
    """Each row once for the whole range and once for its season."""
    periods = F.array(F.lit(WHOLE), season_of(F.month("date")))
    return df.withColumn("period", F.explode(periods))


def packed(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per key with the values in date order; at most one value per calendar day."""
    rows = F.array_sort(F.collect_list(F.struct("date", F.col(value).alias("v"))))
    return df.groupBy(*keys).agg(F.transform(rows, lambda r: r["v"]).alias("series"))


def entity_pairs(df: DataFrame, entity: str, payload: str = "series", within: list[str] = (),
                 tiles: int = 4) -> DataFrame:
    """All pairs source < target inside each `within` key, as an equi-join on tiles.

    An entity is copied `tiles` times per side, and tiles x tiles tasks share the pairs
    evenly however the `within` keys are distributed. Raise `tiles` with the entity count.
    """
    block = F.pmod(F.xxhash64("_e"), F.lit(tiles)).cast("int")
    every = F.sequence(F.lit(0), F.lit(tiles - 1))
    df = df.select(*within, F.col(entity).alias("_e"), F.col(payload).alias("_p"))
    left = df.select(*within, F.col("_e").alias("source"), F.col("_p").alias("x"),
                     block.alias("_row"), F.explode(every).alias("_column"))
    right = df.select(*within, F.col("_e").alias("target"), F.col("_p").alias("y"),
                      F.explode(every).alias("_row"), block.alias("_column"))
    return (left.join(right, [*within, "_row", "_column"])
            .where(F.col("source") < F.col("target")).drop("_row", "_column"))


def same_day_pairs(df: DataFrame, entity: str, value: str) -> DataFrame:
    """Long form (source, target, date, x, y) of the days where both sides are observed.

    The day itself is exploded after the tiled join, so no date holds all entities in one task.
    """
    dated = F.array_sort(F.collect_list(F.struct("date", F.col(value).alias("v"))))
    series = df.where(F.col(value).isNotNull()).groupBy(entity).agg(
        F.map_from_entries(dated).alias("series"))
    pairs = entity_pairs(series, entity)
    day = F.explode(F.array_intersect(F.map_keys("x"), F.map_keys("y")))
    return (pairs.withColumn("date", day)
            .select("source", "target", "date", F.col("x")[F.col("date")].alias("x"),
                    F.col("y")[F.col("date")].alias("y")))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def pearson(df: DataFrame, entity: str, order: list[str], value: str, within: list[str] = ()) -> DataFrame:
    """Pearson r between entities that share the same index; 0 where one side is constant.

    Each series is standardized once before pairing, so a pair costs one dot product.
    """
    stats = df.groupBy(*within, entity).agg(
        F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"),
        F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("v")))),
                    lambda r: r["v"]).alias("_v"))
    unit = stats.select(*within, entity, F.transform("_v", lambda v: F.coalesce(
        ratio(v - F.col("_mean"), F.col("_std")), F.lit(0.0))).alias("_unit"))
    return entity_pairs(unit, entity, "_unit", within).select(
        *within, "source", "target", (_dot(F.col("x"), F.col("y")) / F.size("x")).alias("r"))


def index_correlation(monthly: DataFrame, entity: str, value: str = "seasonal_index", within: list[str] = ()) -> DataFrame:
    """Pearson r between 12-month index vectors."""
    return pearson(monthly, entity, ["month"], value, within)


def day_bits(series: DataFrame, entity: str, within: list[str] = ()) -> tuple[DataFrame, int]:
    """(entity, flags) with one bit per day, packed 63 to a number: active days and observed days; and the count of numbers."""
    longest = series.agg(F.max(F.size("series"))).first()[0] or 0
    words = -(-longest // 63)
    bits = lambda test: F.array(*[F.aggregate(
        F.slice("series", 1 + 63 * w, 63), F.lit(0).cast("long"),
        lambda s, v: F.shiftleft(s, 1).bitwiseOR(F.coalesce(test(v), F.lit(False)).cast("long"))) for w in range(words)])
    flags = F.struct(bits(lambda v: v > 0).alias("active"), bits(lambda v: v.isNotNull()).alias("seen"))
    return series.select(*within, entity, flags.alias("flags")), words


def overlap(x: str, y: str, words: int) -> list[Column]:
    """both_days, either_days and jaccard of two `flags`; every number is a bit count in generated code."""
    a, b, seen_a, seen_b = (F.col(f"{c}.{f}") for f in ("active", "seen") for c in (x, y))
    total = lambda parts: sum(parts, F.lit(0)).cast("int")
    both = total([F.bit_count(a[w].bitwiseAND(b[w])) for w in range(words)])
    either = total([F.bit_count(a[w].bitwiseOR(b[w]).bitwiseAND(seen_a[w]).bitwiseAND(seen_b[w])) for w in range(words)])
    return [both.alias("both_days"), either.alias("either_days"), F.coalesce(ratio(both, either), F.lit(0.0)).alias("jaccard")]


def active_overlap(series: DataFrame, entity: str, within: list[str] = ()) -> DataFrame:
    """Days with sales on both sides over days with sales on either, on days both are observed."""
    flags, words = day_bits(series, entity, within)
    return entity_pairs(flags, entity, "flags", within).select(*within, "source", "target", *overlap("x", "y", words))


def overlap_of(pairs: DataFrame, series: DataFrame, entity: str) -> DataFrame:
    """The overlap of the given pairs (source, target, ...) alone."""
    flags, words = day_bits(series, entity)
    flags = stage(flags, "day_bits")
    side = lambda end, name: flags.select(F.col(entity).alias(end), F.col("flags").alias(name))
    both = pairs.join(side("source", "_x"), "source").join(side("target", "_y"), "target")
    return both.select(*pairs.columns, *overlap("_x", "_y", words))


def _common(x, y) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    seen = np.isfinite(x) & np.isfinite(y)
    return x[seen], y[seen]


def series_blocks(series: DataFrame, entity: str, within: list[str] = (), block: int = 64) -> DataFrame:
    """Cells of the pair matrix: each block of about `block` series meets itself and every later block of its group.

    One row per cell with two packed blocks. A group's number of blocks follows from its count of entities, entities
    are dealt to blocks by a hash of their name, and a block travels once per block of its group; the pairs
    themselves are only formed inside a cell.
    """
    keys = [*within, "_all"]
    named = series.select(*within, F.lit(0).alias("_all"), F.col(entity).cast("string").alias("_e"), F.col("series"))
    counts = named.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block))).cast("int").alias("_blocks"))
    dealt = named.join(counts, keys).withColumn("_b", F.pmod(F.xxhash64("_e"), F.col("_blocks")).cast("int"))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.select(*keys, "_blocks", "_b").schema)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_e")
        values = np.stack([np.asarray(v, dtype=float) for v in rows["series"]])
        head = rows.iloc[:1][[*keys, "_blocks", "_b"]].reset_index(drop=True)
        head["_count"], head["_days"], head["_names"] = len(rows), values.shape[1], [list(rows["_e"])]
        head["_series"] = [values.tobytes()]
        return head

    packed_ = dealt.groupBy(*keys, "_blocks", "_b").applyInPandas(pack, f"{types}, _count int, _days int, _names array<string>, _series binary")
    packed_ = stage(packed_, "series_blocks")
    side = lambda df, n: df.select(*keys, "_i", "_j", F.struct("_count", "_days", "_names", "_series").alias(n))
    left = packed_.withColumns({"_i": F.col("_b"), "_j": F.explode(F.sequence(F.col("_b"), F.col("_blocks") - 1))})
    right = packed_.withColumns({"_j": F.col("_b"), "_i": F.explode(F.sequence(F.lit(0), F.col("_b")))})
    cells = side(left, "left").join(side(right, "right"), [*keys, "_i", "_j"])
    # few large rows: spread the cells, each is a task's work
    return cells.repartition(series.sparkSession.sparkContext.defaultParallelism * 2, *keys, "_i", "_j")


def rank_correlation(series: DataFrame, entity: str, within: list[str] = (), min_days: int = 30, p_values: bool = False,
                     interval: dict | None = None, block: int = 64) -> DataFrame:
    """Spearman r of all pairs source < target inside each `within` key, ranked on the pair's common days only.

    `series` holds one packed array per entity and key, all of a key over the same days, NULL where not observed. Blocks
    of series meet in cells: series with the same observed days are ranked once per cell, and their correlations are one
    matrix product of whole numbers. With `p_values`, Student p. With `interval` (arguments of `block_draws` and
    `min_abs_r`), a moving-block bootstrap interval: the days of all draws are the same for a block, whose series are
    ranked together; pairs below `min_abs_r` have none. `same_sign` is the share of draws with the sign of r.
    """
    cells, keys = series_blocks(series, entity, within, block), list(within)
    types = [(f.name, f.dataType.simpleString()) for f in cells.schema if f.name in keys]
    extra = (["p_value"] if p_values else []) + (["ci_lower", "ci_upper", "same_sign"] if interval is not None else [])
    schema = ", ".join([*(f"{n} {t}" for n, t in types), "source string", "target string", "n_days int", "r double",
                        *(f"{c} double" for c in extra)])
    rule = dict(interval or {})
    gate = rule.pop("min_abs_r", 0.30) if interval is not None else None

    def read(b) -> tuple[np.ndarray, np.ndarray]:
        return np.array(b["_names"], dtype=object), np.frombuffer(b["_series"]).reshape(b["_count"], b["_days"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        drawn: dict[int, np.ndarray] = {}
        for batch in batches:
            for cell in batch.to_pylist():
                (a, x), (b, y) = read(cell["left"]), read(cell["right"])
                own = cell["_i"] == cell["_j"]
                for i, j, days in ranks.common_days(x, y):
                    if len(days) < min_days:
                        continue
                    wanted = a[i][:, None] < b[j] if own else np.ones((len(i), len(j)), bool)
                    if not wanted.any():
                        continue
                    u, v = x[np.ix_(i, days)], y[np.ix_(j, days)]
                    r = ranks.rank_products(ranks.centered_ranks(u), ranks.centered_ranks(v))
                    one, two = a[i][np.nonzero(wanted)[0]], b[j][np.nonzero(wanted)[1]]
                    swap = one > two
                    out = {k: cell[k] for k in keys} | {
                        "source": np.where(swap, two, one), "target": np.where(swap, one, two), "n_days": np.int32(len(days)), "r": r[wanted]}
                    if p_values:
                        out["p_value"] = ranks.student_ps(r[wanted], len(days))
                    if interval is not None:
                        asked = wanted if gate is None else wanted & (np.abs(r) >= gate)
                        bounds = block_interval(u, v, r, asked, drawn, **rule)
                        out |= {c: bound[wanted] for c, bound in zip(("ci_lower", "ci_upper", "same_sign"), bounds)}
                    frame = pd.DataFrame(out)[[*keys, "source", "target", "n_days", "r", *extra]]
                    yield from pa.Table.from_pandas(frame, preserve_index=False).to_batches()

    return cells.mapInArrow(score, schema)


def block_interval(x: np.ndarray, y: np.ndarray, r: np.ndarray, wanted: np.ndarray, drawn: dict, reps: int = 200, block: int = 7,
                   level: float = 0.95, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interval bounds of the wanted pairs of two blocks and the share of draws with the sign of r, NaN for other pairs.

    Fewer than two blocks of days, or fewer than 50 draws, give the point value and the share 1.
    """
    low, high, same = (np.where(wanted, v, np.nan) for v in (r, r, 1.0))
    n, tail = x.shape[1], 100 * (1 - level) / 2
    if wanted.any() and n >= 2 * block and reps >= 50:
        blocks = -(-n // block)
        if blocks not in drawn:
            drawn[blocks] = ranks.block_starts(seed, reps, blocks)
        starts = drawn[blocks] % (n - block + 1)
        days = (starts[:, :, None] + np.arange(block)).reshape(reps, -1)[:, :n]
        place = np.ix_(np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0)))
        values = ranks.resampled(x[place[0].ravel()], y[place[1].ravel()], days)
        agree = (np.sign(values) == np.sign(r[place])).mean(axis=0)
        for side, bound in zip((low, high, same), (*np.percentile(values, [tail, 100 - tail], axis=0), agree)):
            side[place] = np.where(wanted[place], bound, np.nan)
    return low, high, same


def strength(r: Column | str, low: Column | str, high: Column | str) -> Column:
    """clear: |r| >= 0.30 and the interval leaves out 0; weak: 0.15 <= |r| < 0.30; else retained."""
    size = F.abs(F.col(r) if isinstance(r, str) else r)
    low, high = (F.col(c) if isinstance(c, str) else c for c in (low, high))
    off_zero = F.coalesce((low > 0) | (high < 0), F.lit(False))
    return (F.when((size >= 0.30) & off_zero, "clear")
            .when((size >= 0.15) & (size < 0.30), "weak").otherwise("retained"))


def fdr(df: DataFrame, keys: list[str], p: str = "p_value") -> DataFrame:
    """Benjamini-Hochberg q value within each key, for groups of any size.

    Equal p values share one q, so they are collapsed before anything is ordered.
    """
    counted = df.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_total(counted, keys, p, "_n", "_before", "_all")
    raw = placed.withColumn("_raw", F.col(p) * F.col("_all") / (F.col("_before") + F.col("_n")))
    q = following_minimum(raw, keys, p, "_raw", "_q").select(
        *keys, p, F.least(F.lit(1.0), "_q").alias("q_value"))
    return df.join(q, [*keys, p], "left")


def average_rank(df: DataFrame, keys: list[str], value: str, name: str = "avg_rank") -> DataFrame:
    """Ranks inside a bounded group (one entity's days), equal values sharing their mean rank."""
    place = F.rank().over(Window.partitionBy(*keys).orderBy(value))
    same = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return df.withColumn(name, place + (same - 1) / 2.0)


def bin_label(rank: str, keys: list[str], bins: int) -> Column:
    """Quantile bin 0..bins-1 from average ranks."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return F.least(F.floor((F.col(rank) - 1) * bins / n), F.lit(bins - 1)).cast("int")


def normal_scores(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rank-based normal scores, standardized to mean 0 and sample deviation 1."""
    group = Window.partitionBy(*keys)
    ranked = average_rank(df, keys, value, "_rank")
    u = clip((F.col("_rank") - 0.5) / F.count(F.lit(1)).over(group), 1e-6, 1 - 1e-6)
    scored = ranked.withColumn("_u", u).withColumn("_z", normal_quantile("_u"))
    return (scored.withColumn("score", (F.col("_z") - F.avg("_z").over(group))
                              / F.nullif(F.stddev_samp("_z").over(group), F.lit(0.0)))
            .drop("_rank", "_u", "_z"))


def information_scores(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Largest normalized mutual information over bin grids, per pair row."""
    schema = ", ".join(f"{k} string" for k in keys) + ", score double"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(*[getattr(row, k) for k in keys], ranks.information_score(*_common(row.x, row.y)))
                                for row in batch.itertuples(index=False)], columns=[*keys, "score"])

    return pairs.select(*keys, "x", "y").mapInPandas(score, schema)


def shifted_pairs(series: DataFrame, entity: str, draws: int, seed: int = SEED) -> DataFrame:
    """Random pairs with the second series rotated: same serial dependence, no alignment.

    Entities are numbered by the draw of their name; each draw picks two different numbers and a shift.
    """
    names = series.select(entity, draw(entity).alias("_order"))
    places = row_numbers(names, [], "_order", [entity], "_k", "_n").select(entity, (F.col("_k") - 1).alias("_k"))
    numbered = series.join(places, entity)
    count = series.agg(F.count(F.lit(1))).scalar()
    n = series.agg(F.max(F.size("series"))).scalar()
    spark = series.sparkSession
    least = F.least(F.lit(14), F.greatest(F.lit(1), F.floor(n / 4)))
    d = spark.range(draws).withColumnRenamed("id", "draw")
    d = d.withColumn("_a", draw(F.lit(str(seed)), "draw", F.lit("a")) % count)
    d = d.withColumn("_b0", draw(F.lit(str(seed)), "draw", F.lit("b")) % (count - 1))
    d = d.withColumn("_b", F.col("_b0") + F.when(F.col("_b0") >= F.col("_a"), 1).otherwise(0))
    d = d.withColumn("shift", least + draw(F.lit(str(seed)), "draw", F.lit("s")) % (n - 2 * least + 1))
    left = numbered.select(F.col("_k").alias("_a"), F.col(entity).alias("source"), F.col("series").alias("x"))
    right = numbered.select(F.col("_k").alias("_b"), F.col(entity).alias("target"), F.col("series").alias("y"))
    both = d.join(left, "_a").join(right, "_b")
    size = F.size("y")
    # value at position i comes from position i - shift
    turned = F.concat(F.expr("slice(y, size(y) - shift + 1, shift)"), F.expr("slice(y, 1, size(y) - shift)"))
    return both.where(size > F.col("shift")).select(
        F.col("draw").cast("string").alias("draw"), "source", "target", "shift", "x", turned.alias("y"))


def symmetric_matrix(pairs: DataFrame, value: str, entities: DataFrame, entity: str,
                     columns: list[str]) -> DataFrame:
    """Wide matrix with both triangles and a unit diagonal, for the named columns."""
    long = (pairs.select(F.col("source").alias("row"), F.col("target").alias("column"), value)
            .unionByName(pairs.select(F.col("target").alias("row"), F.col("source").alias("column"), value))
            .unionByName(entities.select(F.col(entity).alias("row"), F.col(entity).alias("column"),
                                         F.lit(1.0).alias(value))))
    return long.groupBy("row").pivot("column", columns).agg(F.first(value))
