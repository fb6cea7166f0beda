"""Edges, nodes and groups of a relationship network given as a pair table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from greengrain.functions.ordered import exact_quantiles, row_numbers
from greengrain.functions.staging import stage


def kth_largest(df: DataFrame, value: Column, k: int, p: float = 0.95) -> Column:
    """The k-th largest value as a scalar; the p quantile when k is 0."""
    base = df.select(value.alias("_v")).where(F.col("_v").isNotNull())
    if k == 0:
        return exact_quantiles(base, [], "_v", {"q": p}).select("q").scalar()
    placed = row_numbers(base, [], "_v", [], "_rn", "_n")
    return placed.where(F.col("_rn") == F.col("_n") - (k - 1)).select("_v").scalar()


def edge_table(pairs: DataFrame, weight: str, candidate: Column, tolerance: float = 1e-6) -> DataFrame:
    """Candidate and final flags, and the kind of association by sign."""
    w = F.col(weight)
    return (pairs.withColumn("is_candidate", candidate)
            .withColumn("is_edge", candidate & (F.abs(w) > tolerance))
            .withColumn("association_type", F.when(w > 0, "complement").otherwise("substitute")))


def node_metrics(edges: DataFrame, nodes: DataFrame, node: str, weight: str, core: int = 10) -> DataFrame:
    """Degree, weighted degree and core rank; nodes without edges are kept with 0."""
    ends = edges.select(F.explode(F.array("source", "target")).alias(node), F.abs(F.col(weight)).alias("_w"))
    degrees = ends.groupBy(node).agg(F.count(F.lit(1)).alias("degree"), F.sum("_w").alias("weighted_degree"))
    full = (nodes.join(degrees, node, "left").na.fill({"degree": 0, "weighted_degree": 0.0})
            .withColumn("_order", -F.col("weighted_degree")))
    ranked = row_numbers(full.withColumn("_less", -F.col("degree")), [], "_order",
                         ["_less", node], "core_rank", "_n")
    return (ranked.withColumn("is_core_node", F.col("core_rank") <= F.least(F.lit(core), F.col("_n")))
            .drop("_order", "_less", "_n", "_range"))


def components(edges: DataFrame, nodes: DataFrame, node: str, max_rounds: int = 200) -> DataFrame:
    """Connected components: every node takes the smallest label in reach until none changes.

    Each round also follows the label of its label, so the rounds grow with the logarithm
    of the longest chain. Rounds are written out, which cuts the lineage.
    """
    both = edges.select("source", "target").unionByName(
        edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    both = stage(both, "links")
    labels = stage(nodes.select(F.col(node).alias("node"), F.col(node).alias("label")), "labels")
    for _ in range(max_rounds):
        reach = (both.join(labels, both["source"] == labels["node"])
                 .groupBy("target").agg(F.min("label").alias("seen")))
        nearer = (labels.join(reach, labels["node"] == reach["target"], "left")
                  .select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label")))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        fresh = stage(nearer.join(hop, "label", "left")
                      .select("node", "old", F.least("label", "further").alias("label")), "labels")
        labels = fresh.select("node", "label")
        if fresh.where(F.col("old") != F.col("label")).isEmpty():
            return labels.withColumnRenamed("node", node).withColumnRenamed("label", "community")
    raise RuntimeError("labels still change after the last round")


def category_edges(edges: DataFrame, weight: str, stability: str) -> DataFrame:
    """Edge counts and means per unordered pair of categories."""
    key = F.concat_ws("--", F.least("source_category", "target_category"),
                      F.greatest("source_category", "target_category"))
    w = F.col(weight)
    return edges.groupBy(key.alias("category_pair")).agg(
        F.count(F.lit(1)).alias("edge_count"), F.count_if(w > 0).alias("positive_edges"),
        F.count_if(w < 0).alias("negative_edges"), F.avg(F.abs(w)).alias("mean_abs_weight"),
        F.avg(stability).alias("mean_stability"))


def sensitivity(pairs: DataFrame, base: Column, options: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """(parameter, value, threshold, edge_count, jaccard with the base edges) of each (parameter, value, threshold, edges).

    All options are counted in one pass over the pairs; two empty sets have Jaccard 1.
    """
    aggs = []
    for i, (_, _, _, chosen) in enumerate(options):
        aggs += [F.count_if(chosen).alias(f"n{i}"), F.count_if(chosen & base).alias(f"both{i}"), F.count_if(chosen | base).alias(f"either{i}")]
    rows = F.array(*[F.struct(
        F.lit(parameter).alias("parameter"), F.lit(value).alias("value"), threshold.cast("double").alias("threshold"), F.col(f"n{i}").alias("edge_count"),
        F.when(F.col(f"either{i}") == 0, 1.0).otherwise(F.col(f"both{i}") / F.nullif(F.col(f"either{i}"), F.lit(0))).alias("jaccard"))
        for i, (parameter, value, threshold, _) in enumerate(options)])
    return pairs.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def set_overlap(left: DataFrame, right: DataFrame, keys: list[str], group: list[str] = ()) -> DataFrame:
    """Jaccard of two key sets, per group; 1 when both are empty."""
    a = left.select(*group, *keys).distinct().withColumn("_a", F.lit(1))
    b = right.select(*group, *keys).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, [*group, *keys], "full_outer")
    aggs = [F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("both"),
            F.count(F.lit(1)).alias("either")]
    counted = both.groupBy(*group).agg(*aggs) if group else both.agg(*aggs)
    return counted.withColumn("jaccard", F.when(F.col("either") == 0, 1.0)
                              .otherwise(F.col("both") / F.nullif(F.col("either"), F.lit(0))))


def top_by_sign(pairs: DataFrame, value: str, positive: int = 7, negative: int = 3) -> DataFrame:
    """The strongest pairs of each sign, ranked inside their sign.

    limit() keeps a bounded heap per task before anything is ordered globally.
    """
    up = pairs.where(F.col(value) > 0).orderBy(F.desc(value), "source", "target").limit(positive)
    down = pairs.where(F.col(value) < 0).orderBy(value, "source", "target").limit(negative)
    side = lambda df, name, order: df.withColumn("side", F.lit(name)).withColumn(
        "place", F.row_number().over(Window.partitionBy("side").orderBy(order, "source", "target")))
    return side(up, "positive", F.desc(value)).unionByName(side(down, "negative", F.asc(value)))
