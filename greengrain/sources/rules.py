"""A table of declared rules, compiled to one pass per table for its rows and one join per reference for its sets.

Every rule gives one row (table, check, violations, passed). NULL breaks no row rule but `known`.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-9


@dataclass(frozen=True)
class Row:
    """A condition that no row may meet."""
    name: str
    broken: Column


@dataclass(frozen=True)
class Keys:
    """Keys of the table against a reference table: all known there, and with `both` all of the reference present."""
    name: str
    keys: tuple[str, ...]
    reference: str
    both: bool = False


@dataclass(frozen=True)
class Grid:
    """A number that must be one of the reference's numbers of the same keys."""
    name: str
    keys: tuple[str, ...]
    value: str
    reference: str
    tolerance: float = 1e-6


@dataclass(frozen=True)
class Pairs:
    """All n (n - 1) / 2 pairs (source < target) of the reference's entities, once per group; counts missing and surplus ones."""
    name: str
    group: tuple[str, ...]
    reference: str
    entity: str


def within(name: str, value: str, low: Column | float, high: Column | float, tolerance: float = TOLERANCE) -> Row:
    low, high = (b if isinstance(b, Column) else F.lit(b) for b in (low, high))
    return Row(name, (F.col(value) < low - tolerance) | (F.col(value) > high + tolerance))


def identity(name: str, left: Column, right: Column, tolerance: float = 1e-6) -> Row:
    return Row(name, F.abs(left - right) > tolerance)


def probability(name: str, value: str) -> Row:
    return within(name, value, 0.0, 1.0)


def known(name: str, *values: str) -> Row:
    """Every value is there and finite."""
    bad = [F.col(v).isNull() | F.isnan(F.col(v).cast("double")) | (F.abs(F.col(v).cast("double")) == float("inf")) for v in values]
    out = bad[0]
    for b in bad[1:]:
        out = out | b
    return Row(name, out)


def _rows(df: DataFrame, rules: list[Row]) -> DataFrame:
    counts = df.agg(*[F.count_if(r.broken).alias(f"r{i}") for i, r in enumerate(rules)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(r.name).alias("check"), F.col(f"r{i}").alias("violations"))
                                             for i, r in enumerate(rules)])).alias("r")).select("r.*")


def _keys(df: DataFrame, reference: DataFrame, rules: list[Keys]) -> DataFrame:
    """Rules over the same keys and reference share one join."""
    keys = list(rules[0].keys)
    flag = lambda d, name: d.select(*keys).distinct().withColumn(name, F.lit(True))
    both = flag(df, "_a").join(flag(reference, "_b"), keys, "full_outer")
    return _rows(both, [Row(r.name, F.col("_b").isNull() | (F.col("_a").isNull() if r.both else F.lit(False))) for r in rules])


def _grid(df: DataFrame, reference: DataFrame, rule: Grid) -> DataFrame:
    keys = list(rule.keys)
    options = reference.groupBy(*keys).agg(F.collect_set(rule.value).alias("_options"))  # a grid is a short list
    near = F.exists("_options", lambda x: F.abs(x - F.col(rule.value)) <= rule.tolerance)
    return _rows(df.join(options, keys, "left"), [Row(rule.name, ~F.coalesce(near, F.lit(False)))])


def _pairs(df: DataFrame, reference: DataFrame, rule: Pairs) -> DataFrame:
    group = list(rule.group)
    n = F.count_distinct(rule.entity)
    wanted = reference.groupBy(*group).agg((n * (n - 1) / 2).cast("long").alias("_wanted"))
    ordered = F.col("source") < F.col("target")
    found = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"), F.count_distinct(F.when(ordered, F.struct("source", "target"))).alias("_found"))
    both = wanted.join(found, group, "full_outer") if group else wanted.join(found)
    gap = F.abs(F.coalesce("_wanted", F.lit(0)) - F.coalesce("_found", F.lit(0))) + F.coalesce("_rows", F.lit(0)) - F.coalesce("_found", F.lit(0))
    return both.agg(F.coalesce(F.sum(gap), F.lit(0)).cast("long").alias("violations")).select(F.lit(rule.name).alias("check"), "violations")


def compiled(tables: dict[str, DataFrame], rules: dict[str, list]) -> DataFrame:
    """One row per rule of the tables named in `rules`; references are names of `tables` as well."""
    out = []
    for table, own in rules.items():
        df = tables[table]
        if plain := [r for r in own if isinstance(r, Row)]:
            out.append((table, _rows(df, plain)))
        sets = sorted((r for r in own if isinstance(r, Keys)), key=lambda r: (r.reference, r.keys))
        out += [(table, _keys(df, tables[ref], list(part))) for (ref, _), part in groupby(sets, key=lambda r: (r.reference, r.keys))]
        out += [(table, _grid(df, tables[r.reference], r)) for r in own if isinstance(r, Grid)]
        out += [(table, _pairs(df, tables[r.reference], r)) for r in own if isinstance(r, Pairs)]
    rows = None
    for table, found in out:
        one = found.select(F.lit(table).alias("table"), "check", "violations", (F.col("violations") == 0).alias("passed"))
        rows = one if rows is None else rows.unionByName(one)
    return rows
