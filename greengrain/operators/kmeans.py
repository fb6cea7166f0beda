"""K-means with many starts and many groups at once (replicates of a bootstrap, or numbers of clusters).

Groups run side by side: every step is one job over all of them. Entities are packed into blocks of a bounded number of
rows; a step gives each block the centers of all starts of its group, and a block answers with sums, counts and costs
per cluster, which are added up per group. So no task holds more than a block and the centers (starts x k x features),
and the number of entities only adds blocks. Starts are k-means++: an entity is drawn with probability proportional to
its squared distance, as the smallest value of an exponential draw divided by that distance, so a draw is a minimum over
blocks. Draws depend on (seed, group, start, round, entity), not on the order or the place of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from greengrain.functions.staging import stage

BLOCK_ROWS, STEPS, SEED = 4096, 60, 20230907
BLOCKS = "grp int, k int, block long, parts int, n int, names array<string>, hashes binary, x binary"
# One row per group: centers [start, cluster, feature] and the clusters chosen so far, costs [start], counts [start, cluster].
STATE = "grp int, k int, chosen int, centers binary, costs binary, counts binary, moving boolean"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _exponential(hashes: np.ndarray, group: int, starts: int, turn: int, seed: int) -> np.ndarray:
    """Draws [entity, start] of an exponential distribution."""
    key = _mix(np.arange(starts, dtype=np.uint64) + np.uint64((seed * 1_000_003 + group * 1009 + turn) % 2 ** 63) * np.uint64(2654435761))
    u = (_mix(hashes[:, None] ^ key[None, :]) >> np.uint64(11)).astype(float)
    return -np.log((u + 0.5) / 2.0 ** 53)


def _squared(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances [row, start, cluster], exact enough near 0 to keep a center's own row at 0."""
    flat = centers.reshape(-1, centers.shape[-1])
    d = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ flat.T) + (flat * flat).sum(axis=1)[None, :]
    return np.where(d < 1e-9, 0.0, d).reshape(len(x), *centers.shape[:2])


def blocks_of(features: DataFrame, entity: str, names: list[str], groups: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Features (grp, entity, names) as packed blocks; `groups` is (grp, k)."""
    counts = features.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block_rows))).cast("int").alias("_parts"))
    rows = features.select("grp", F.col(entity).cast("string").alias("name"), F.array(*names).alias("v")).join(counts, "grp").join(groups, "grp")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("name"), F.col("_parts")))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("name")
        return pd.DataFrame([(part["grp"].iloc[0], part["k"].iloc[0], part["block"].iloc[0], part["_parts"].iloc[0], len(part), list(part["name"]),
                              part["h"].to_numpy(np.int64).tobytes(), np.stack(part["v"].to_numpy()).astype(float).tobytes())],
                            columns=["grp", "k", "block", "parts", "n", "names", "hashes", "x"])
    rows = rows.withColumn("h", F.xxhash64("name"))
    return stage(rows.groupBy("grp", "k", "block").applyInPandas(pack, BLOCKS), "kmeans_blocks")


def _read(cell: dict, starts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(cell["x"]).reshape(cell["n"], -1)
    centers = np.frombuffer(cell["centers"]).reshape(starts, cell["chosen"], x.shape[1]) if cell["chosen"] else np.empty((starts, 0, x.shape[1]))
    return x, np.frombuffer(cell["hashes"], np.uint64), centers


def _cells(blocks: DataFrame, state: DataFrame) -> DataFrame:
    spread = blocks.sparkSession.sparkContext.defaultParallelism
    return blocks.join(state.drop("k"), "grp").repartition(spread, "grp", "block")


def _seeded(blocks: DataFrame, state: DataFrame, starts: int, seed: int) -> DataFrame:
    """One more center per start, for groups that still need one."""
    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.to_pylist():
                x, hashes, centers = _read(cell, starts)
                draws = _exponential(hashes, cell["grp"], starts, cell["chosen"], seed)
                if cell["chosen"]:
                    near = _squared(x, centers).min(axis=2)
                    # where every row is a center already, any row will do
                    draws = np.where(near > 0, draws / np.maximum(near, 1e-300), draws * 1e300)
                best = draws.argmin(axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cell["grp"]], pa.int32()), pa.array([cell["k"]], pa.int32()), pa.array([cell["chosen"]], pa.int32()),
                     pa.array([cell["centers"]], pa.binary()), pa.array([draws[best, np.arange(starts)].tobytes()], pa.binary()),
                     pa.array([hashes[best].tobytes()], pa.binary()), pa.array([x[best].tobytes()], pa.binary())],
                    names=["grp", "k", "chosen", "centers", "draws", "who", "rows"])

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        draws, who = (np.stack([np.frombuffer(b, t) for b in part[c]]) for c, t in (("draws", float), ("who", np.uint64)))
        rows = np.stack([np.frombuffer(b).reshape(starts, -1) for b in part["rows"]])
        # the smallest draw of each start; the hash of the name decides a tie
        pick = np.lexsort((who, draws), axis=0)[0]
        new = rows[pick, np.arange(starts)][:, None, :]
        chosen, k = int(part["chosen"].iloc[0]), int(part["k"].iloc[0])
        old = np.frombuffer(part["centers"].iloc[0]).reshape(starts, chosen, new.shape[2]) if chosen else new[:, :0]
        centers = np.concatenate([old, new], axis=1)
        return pd.DataFrame([(part["grp"].iloc[0], k, chosen + 1, centers.tobytes(), b"", b"", True)],
                            columns=["grp", "k", "chosen", "centers", "costs", "counts", "moving"])
    offers = _cells(blocks, state.where("chosen < k")).mapInArrow(
        propose, "grp int, k int, chosen int, centers binary, draws binary, who binary, rows binary")
    made = offers.groupBy("grp").applyInPandas(choose, STATE)
    return stage(made.unionByName(state.where("chosen >= k")), "kmeans_state")


def _stepped(blocks: DataFrame, state: DataFrame, starts: int, steps: int) -> DataFrame:
    """Centers as means of their members; a cluster without members keeps its center."""
    def sums_of(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = _squared(x, centers)
        k = centers.shape[1]
        at = (d.argmin(axis=2) + np.arange(starts) * k).ravel()
        counts = np.bincount(at, minlength=starts * k).astype(float)
        sums = np.stack([np.bincount(at, np.repeat(x[:, f], starts), starts * k) for f in range(x.shape[1])], axis=1)
        return sums, counts, d.min(axis=2).sum(axis=0)

    def moved(old: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.where(counts[:, None] > 0, sums / np.maximum(counts, 1.0)[:, None], old)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.to_pylist():
                x, _, centers = _read(cell, starts)
                sums, counts, costs = sums_of(x, centers)
                # a group of one block needs no other task for its next steps
                for _ in range(steps if cell["parts"] == 1 else 0):
                    new = moved(centers.reshape(sums.shape), sums, counts).reshape(centers.shape)
                    if np.abs(new - centers).max(initial=0.0) <= 1e-9:
                        break
                    centers = new
                    sums, counts, costs = sums_of(x, centers)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cell["grp"]], pa.int32()), pa.array([cell["k"]], pa.int32()), pa.array([cell["block"]], pa.int64()),
                     *(pa.array([v.tobytes()], pa.binary()) for v in (centers, sums, counts, costs))],
                    names=["grp", "k", "block", "centers", "sums", "counts", "costs"])

    def move(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block")  # the order of addition is fixed
        k = int(part["k"].iloc[0])
        total = lambda c: sum(np.frombuffer(b) for b in part[c])
        counts, costs = total("counts"), total("costs")
        old = np.frombuffer(part["centers"].iloc[0]).reshape(starts * k, -1)
        sums = total("sums").reshape(old.shape)
        new = moved(old, sums, counts)
        moving = bool(np.abs(new - old).max(initial=0.0) > 1e-9)
        return pd.DataFrame([(part["grp"].iloc[0], k, k, new.tobytes(), costs.tobytes(), counts.tobytes(), moving)],
                            columns=["grp", "k", "chosen", "centers", "costs", "counts", "moving"])
    parts = _cells(blocks, state.where("moving")).mapInArrow(
        add, "grp int, k int, block long, centers binary, sums binary, counts binary, costs binary")
    return stage(parts.groupBy("grp").applyInPandas(move, STATE).unionByName(state.where("not moving")), "kmeans_state")


def fit(blocks: DataFrame, starts: int, seed: int = SEED, steps: int = STEPS) -> DataFrame:
    """The state of every group after its last step: Lloyd steps until no center moves, or `steps` of them."""
    groups = blocks.select("grp", "k").distinct()
    state = groups.selectExpr("grp", "k", "0 as chosen", "cast('' as binary) as centers", "cast('' as binary) as costs",
                              "cast('' as binary) as counts", "true as moving")
    most = groups.agg(F.max("k")).first()[0] or 0
    for _ in range(most):
        state = _seeded(blocks, state, starts, seed)
    for _ in range(steps):
        state = _stepped(blocks, state, starts, steps)
        if state.where("moving").isEmpty():
            break
    return state


def best_start(state: DataFrame, starts: int, min_size: int = 0) -> DataFrame:
    """(grp, k, start, cost, smallest, centers of that start): the lowest cost, the first start on a tie.

    With `min_size`, the first start whose smallest cluster is that large, else the one with the largest smallest cluster.
    """
    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                costs, counts = np.frombuffer(r["costs"]), np.frombuffer(r["counts"]).reshape(starts, -1)
                smallest = counts.min(axis=1)
                if min_size:
                    enough = np.flatnonzero(smallest >= min_size)
                    pick = int(enough[0]) if len(enough) else int(smallest.argmax())
                else:
                    pick = int(np.floor(costs * 1e9).argmin())
                centers = np.frombuffer(r["centers"]).reshape(starts, -1)[pick]
                rows.append((r["grp"], r["k"], pick, float(costs[pick]), int(smallest[pick]), centers.tobytes()))
            yield pd.DataFrame(rows, columns=["grp", "k", "start", "cost", "smallest", "centers"])
    return stage(state.select("grp", "k", "centers", "costs", "counts").mapInPandas(
        choose, "grp int, k int, start int, cost double, smallest long, centers binary"), "kmeans_best")


def labels(blocks: DataFrame, best: DataFrame, entity: str) -> DataFrame:
    """(grp, entity, cluster_id): the nearest center of the chosen start."""
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.to_pylist():
                x = np.frombuffer(cell["x"]).reshape(cell["n"], -1)
                near = _squared(x, np.frombuffer(cell["centers"]).reshape(1, cell["k"], -1))[:, 0].argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([cell["grp"]] * cell["n"], pa.int32()), pa.array(cell["names"]), pa.array(near, pa.int32())],
                                                 names=["grp", entity, "cluster_id"])
    return _cells(blocks, best).select("grp", "k", "n", "names", "x", "centers").mapInArrow(assign, f"grp int, {entity} string, cluster_id int")
