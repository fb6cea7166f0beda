"""Mixing sources to target weights by pivotal (dependent) rounding of copy counts.

Every document of a source starts with the same fractional number of copies, target / source size. Two documents at a
time pass words to each other until one of them is whole; which way the words go is drawn so that no expected copy
count changes, and the words of the two together never change. One document per chunk stays fractional; the residuals
of all chunks are the input of the next level, until one per source is left. Chunks hold a bounded number of
documents, so a source with a third of all rows is many chunks. Only (doc_id, source, size) travels.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from greengrain.functions.staging import stage
from greengrain.llm.common import word_count

CHUNK = 4096


def positions(df: DataFrame, order, name: str) -> DataFrame:
    """0-based positions in a global order: ranges are numbered apart and moved by the rows before them."""
    ranged = stage(df.repartitionByRange(16, order).withColumn("_part", F.spark_partition_id()), "ranged")
    # one row per range
    before = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_c")).select(
        "_part", (F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return ranged.withColumn("_in", inside).join(before, "_part").withColumn(
        name, F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def source_targets(units: DataFrame, weights: list[int], limit: int) -> DataFrame:
    """(source, source_size, target) from (source, mass): shares by weight, at most limit * size, excess reshared.

    Sources take the weights in the order of their code points, NULL last, starting over after the last weight.
    The level at which the uncapped sources share what the capped ones leave is found round by round.
    """
    sized = units.groupBy("source").agg(F.sum("mass").alias("source_size"))
    placed = positions(sized, F.col("source").asc_nulls_last(), "place")
    table = F.array(*[F.lit(float(w)) for w in weights])
    placed = stage(placed.withColumn("weight", F.element_at(table, (F.col("place") % len(weights) + 1).cast("int")))
                   .withColumn("most", F.col("source_size") * float(limit)), "sources")
    capped, level = F.lit(False), None
    while True:
        sums = placed.agg(F.sum("source_size").alias("all"), F.sum(F.when(capped, F.col("most")).otherwise(0.0)).alias("used"),
                          F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("open"), F.count_if(capped).alias("n")).first()
        if level is not None and sums["n"] == known:
            break
        known = sums["n"]
        level = ((sums["all"] or 0) - (sums["used"] or 0.0)) / sums["open"] if sums["open"] else 0.0
        capped = capped | (F.col("weight") * level > F.col("most"))
    target = F.when(capped, F.col("most")).otherwise(F.col("weight") * level)
    return stage(placed.select("source", "source_size", target.alias("target")), "targets")


def pivot(mass: np.ndarray, p: np.ndarray, rng: np.random.Generator, last: bool) -> np.ndarray:
    """Round shares p in (0, 1) so that sum(mass * p) stays; one share may stay fractional unless `last`."""
    p = p.copy()
    draws = rng.random(len(p) + 1)
    held = 0
    for j in range(1, len(p)):
        i = held
        up = min(mass[i] * (1 - p[i]), mass[j] * p[j])
        down = min(mass[i] * p[i], mass[j] * (1 - p[j]))
        if draws[j] * (up + down) < down:
            whole_i, move = mass[i] * (1 - p[i]) <= mass[j] * p[j], up
            goal_i, goal_j = 1.0, 0.0
        else:
            whole_i, move = mass[i] * p[i] <= mass[j] * (1 - p[j]), -down
            goal_i, goal_j = 0.0, 1.0
        if whole_i:
            p[i], p[j] = goal_i, p[j] - move / mass[j]
            held = j
        else:
            p[i], p[j] = p[i] + move / mass[i], goal_j
        if not 1e-12 < p[held] < 1 - 1e-12:
            p[held] = round(p[held])
    if last and len(p) and 0 < p[held] < 1:
        p[held] = float(draws[-1] < p[held])
    return p


def chunk_rounder(seed: int, level: int, last: bool):
    """Rounds one chunk of one source; the order and the draws depend on its rows alone."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id"], ascending=[False, True], ignore_index=True)
        name = rows["source"].iloc[0]
        mark = 1 + zlib.crc32(name.encode("utf-8", "surrogatepass")) if isinstance(name, str) else 0
        rng = np.random.default_rng([seed, level, int(rows["chunk"].iloc[0]), mark])
        rows["p"] = pivot(rows["mass"].to_numpy(float), rows["p"].to_numpy(float), rng, last)
        return rows.drop(columns="chunk")
    return run


def copies(docs: DataFrame, weights: list[int] = (1, 2, 3), limit: int = 3, seed: int = 7, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, source, size, rows, copies, source_size, target) for each distinct (doc_id, source, size).

    `rows` counts equal rows of documents (doc_id, source, text); all of them get the same copies. A text without
    words has size 0 and never moves a word: its copies are the nearest whole number drawn on its own. A NULL doc_id
    is an id like any other, a NULL source is a source. Equal input gives equal copies in every run. No rows give
    no rows; further columns are not read.
    """
    units = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        word_count(F.col("text").cast("string")).alias("size"))
    units = units.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    units = stage(units.withColumn("mass", F.col("size") * F.col("rows")), "units")
    targets = source_targets(units, list(weights), limit)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    open_ = (units.join(targets, F.equal_null(units["source"], targets["source"])).drop(targets["source"])
             .withColumn("base", F.floor(share)).withColumn("p", share - F.floor(share)))
    own = F.pmod(F.xxhash64("doc_id", "source", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    open_ = open_.withColumn("p", F.when(F.col("mass") == 0, (own < F.col("p")).cast("double")).otherwise(F.col("p")))
    done = None
    for level in range(64):
        counts = stage(open_.where("p > 0 and p < 1").groupBy("source").agg(
            F.ceil(F.count(F.lit(1)) / chunk).alias("chunks")), "chunks")
        last = not counts.where("chunks > 1").head(1)
        put = open_.join(counts, F.equal_null(open_["source"], counts["source"]), "left").drop(counts["source"])
        whole = put.where("p <= 0 or p >= 1").drop("chunks")
        part = put.where("p > 0 and p < 1").withColumn(
            "chunk", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed + level)), "chunks")).drop("chunks")

        schema = part.drop("chunk").schema
        out = stage(whole.unionByName(part.groupBy("source", "chunk").applyInPandas(chunk_rounder(seed, level, last), schema)), "rounded")
        fixed = out.where("p <= 0 or p >= 1")
        done = fixed if done is None else done.unionByName(fixed)
        if last:
            break
        open_ = out.where("p > 0 and p < 1")
    return done.select("doc_id", "source", "size", "rows", (F.col("base") + F.col("p")).cast("long").alias("copies"),
                       "source_size", "target")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """Documents repeated by their copies, with the columns of the input; documents without copies go."""
    packed = docs.select(F.struct(*docs.columns).alias("doc_row"), F.col("doc_id").cast("long").alias("_id"),
                         F.col("source").cast("string").alias("_src"), word_count(F.col("text").cast("string")).alias("_size"))
    plan = copies(docs, **options).where("copies > 0").select(
        F.col("doc_id").alias("_a"), F.col("source").alias("_b"), F.col("size").alias("_c"), F.col("copies").alias("_n"))
    same = F.equal_null("_id", "_a") & F.equal_null("_src", "_b") & F.equal_null("_size", "_c")
    return (packed.join(plan, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
            .select("doc_row.*"))
