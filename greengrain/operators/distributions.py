"""Distribution fits of positive daily sales per entity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from greengrain.functions import fits


def candidate_fits(df: DataFrame, entity: str, value: str, min_n: int = 30) -> DataFrame:
    """Four families per entity with at least `min_n` positive days.

    An entity travels as one array, bounded by the days of the calendar; Spark spreads the
    entities, and a batch holds several.
    """
    packed = df.where(F.col(value) > 0).groupBy(entity).agg(F.collect_list(value).alias("x")).where(F.size("x") >= min_n)
    schema = (f"{entity} string, distribution string, n_positive int, parameter_1 double, parameter_2 double, "
              "log_likelihood double, aic double, ks_statistic double, ks_p_value double")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(e, f[0], len(x), *f[1:]) for e, x in zip(batch[entity], batch["x"])
                    for f in fits.fit_all(np.asarray(x, dtype=float))]
            yield pd.DataFrame(rows, columns=[p.split()[0] for p in schema.split(", ")])

    return packed.mapInPandas(fit, schema)


def best_fit(candidates: DataFrame, summary: DataFrame, entity: str, accept: float = 0.05) -> DataFrame:
    """Lowest AIC, its lead over the second, and whether it may be used; four rows per entity."""
    ordered = F.array_sort(F.collect_list(F.struct("aic", "distribution", "ks_p_value")))
    best = candidates.groupBy(entity).agg(ordered.alias("a")).select(
        entity, F.col("a")[0]["distribution"].alias("best_distribution"), F.col("a")[0]["aic"].alias("best_aic"),
        (F.get("a", F.lit(1))["aic"] - F.col("a")[0]["aic"]).alias("delta_aic_second"), F.col("a")[0]["ks_p_value"].alias("best_ks_p"))
    verdict = F.when(F.col("best_ks_p") >= accept, "parametric_accepted").otherwise("kde_fallback")
    return summary.join(best, entity, "left").withColumn(
        "fit_conclusion", F.when(F.col("best_distribution").isNull(), "insufficient").otherwise(verdict)).withColumn(
        "best_distribution", F.coalesce("best_distribution", F.lit("insufficient")))
