"""Boosted tree models of the daily category series, one fit per (category, target, fold), all in one job.

A fit sees the days of one category, so a group is bounded by the calendar; more categories are more groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from greengrain.functions.boosting import Trees
from greengrain.functions.staging import stage
from greengrain.operators.elasticity import CAT


def _fitter(**rules):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        train, test = rows[rows["train"]], rows[~rows["train"]]
        out = test[[CAT, "date", "fold", "target"]].copy()
        out["hat"] = np.nan
        if len(train) and len(test):
            model = Trees(**rules).fit(np.stack(train["x"].to_numpy()).astype(float), train["y"].to_numpy(float))
            out["hat"] = model.predict(np.stack(test["x"].to_numpy()).astype(float))
        return out
    return run


def _long(df: DataFrame, features: list[str], targets: list[str], *keep) -> DataFrame:
    """A row per target with packed features."""
    x = F.array(*[F.col(c).cast("double") for c in features])
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("y")) for t in targets]))
    return df.select(CAT, "date", *keep, x.alias("x"), each.alias("t")).select(CAT, "date", *keep, "x", "t.target", "t.y")


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Few rows, much work for each group: a number of partitions that is not merged for its small size."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def crossfit(folded: DataFrame, features: list[str], targets: list[str], **rules) -> DataFrame:
    """Out-of-fold predictions `<target>_hat`: the rows of fold k from a fit on all rows of earlier folds.

    `rules` are the arguments of Trees (rounds, step, leaves, ...).
    """
    rows = _long(folded, features, targets, "fold")
    last = F.lit(folded.agg(F.max("fold")).first()[0] or 0)
    # a row is tested in its own fold and trains all later ones
    tasks = rows.withColumn("task", F.explode(F.sequence(F.greatest("fold", F.lit(1)), F.greatest(last, F.lit(1)))))
    tasks = tasks.withColumn("train", F.col("fold") < F.col("task"))
    hats = _spread(tasks, CAT, "target", "task").groupBy(CAT, "target", "task").applyInPandas(_fitter(**rules), f"{CAT} string, date date, fold int, target string, hat double")
    wide = hats.groupBy(CAT, "date", "fold").agg(*[F.max(F.when(F.col("target") == t, F.col("hat"))).alias(f"{t}_hat") for t in targets])
    return stage(folded.select(CAT, "date", "fold", *targets).join(wide, [CAT, "date", "fold"]), "predictions")


def fit_predict(train: DataFrame, future: DataFrame, features: list[str], target: str, **rules) -> DataFrame:
    """Fit on all history of each category and predict its future rows."""
    both = _long(train.na.drop(subset=[*features, target]), features, [target]).withColumn("train", F.lit(True)).unionByName(
        _long(future, features, [target]).withColumn("train", F.lit(False))).withColumn("fold", F.lit(0))
    out = _spread(both, CAT).groupBy(CAT).applyInPandas(_fitter(**rules), f"{CAT} string, date date, fold int, target string, hat double")
    return out.select(CAT, "date", F.col("hat").alias(f"{target}_hat"))
