"""Hard-negative mining with exact scores from subset-sum tables (the method of Four Russians).

Vectors become whole numbers. A block of candidates is kept as bit planes: with its smallest component taken off,
plane p of eight dimensions is one byte per row. For an anchor, a table of 256 subset sums per eight dimensions answers
such a byte with one lookup, and scores come from the highest plane down: double, then add one lookup per byte. The
smallest component returns as a multiple of the anchor's own sum. All numbers are whole, so scores are exact.

Candidates are packed once into blocks, anchors into slabs. Every slab meets every block of its dimension in a cell:
block rows x slab rows of work for two packed rows of input, so what travels is small against the work of a cell.
A first pass keeps the best rows of the anchor's label per cell, then per anchor; a second one, with those scores, the
best rows of other labels inside the window of each positive. At most `top` rows leave a cell per anchor and positive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from greengrain.functions.staging import stage

BLOCK_ROWS, SLAB_ROWS, LEAST_ROWS = 65536, 4096, 1024
TILE, WIDE = 256, 512  # rows and anchors of one lookup, sized for a core's cache
WHOLE = np.iinfo(np.int64)


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; NULL for a vector that is NULL or holds a NULL or non-finite component."""
    wide = lambda x: x.cast("double")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(wide(x)) & (F.abs(wide(x)) < float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(vector, lambda x: F.floor(wide(x) * float(scale))))


def bit_planes(v: np.ndarray) -> tuple[int, np.ndarray]:
    """(smallest component, bytes [plane, eight dimensions, row]) of vectors [row, dimension]."""
    low = int(v.min(initial=0))
    above = v.astype(np.uint64) - np.uint64(low % 2 ** 64)  # a difference of two longs fits an unsigned one
    above = np.pad(above, ((0, 0), (0, -v.shape[1] % 8)))
    count = max(1, int(above[:, :v.shape[1]].max(initial=0)).bit_length())
    # the padding is no component; it stays 0 and the anchors are 0 there as well
    return low, np.stack([np.packbits((above >> np.uint64(p) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").T
                          for p in range(count)])


def subset_sums(anchors: np.ndarray, dtype: type) -> np.ndarray:
    """Tables [eight dimensions, byte, anchor]: the sum of the components whose bits the byte has."""
    a = np.pad(anchors, ((0, 0), (0, -anchors.shape[1] % 8))).astype(dtype)
    a = a.T.reshape(-1, 8, len(anchors))
    tables = np.zeros((len(a), 256, len(anchors)), dtype)
    for j in range(8):
        tables[:, 1 << j:2 << j] = tables[:, :1 << j] + a[:, j:j + 1]
    return tables


def scores(low: int, planes: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products [row, anchor]. Wide components use Python's whole numbers, with the same tables; scores
    beyond 64 bits are the end of the range."""
    longest = max((sum(abs(int(x)) for x in a) for a in anchors), default=0) if np.abs(anchors.astype(float)).max(initial=0) > 2 ** 40 \
        else int(np.abs(anchors).sum(axis=1).max(initial=0))
    bound = longest * (2 ** len(planes) + abs(low))
    dtype = np.int32 if bound < 2 ** 31 else np.int64 if bound < 2 ** 56 else object
    out = np.empty((planes.shape[2], len(anchors)), dtype)
    for c in range(0, len(anchors), WIDE):
        part = anchors[c:c + WIDE].astype(dtype)
        tables = subset_sums(part, dtype)
        base = low * part.sum(axis=1) if low else 0
        for r in range(0, planes.shape[2], TILE):
            got = np.zeros((min(TILE, planes.shape[2] - r), len(part)), dtype)
            for plane in planes[::-1, :, r:r + TILE]:
                got += got
                for table, byte in zip(tables, plane):
                    got += table[byte]
            got = got + base
            out[r:r + TILE, c:c + WIDE] = np.clip(got, WHOLE.min, WHOLE.max) if dtype == object else got
    return out


def first(score: np.ndarray, rows: np.ndarray, top: int) -> np.ndarray:
    """The `top` of these rows by score; `rows` rise with vec_id, so the smaller one wins a tie."""
    value = score[rows]
    if len(rows) > top:
        if value.dtype == object:
            worst = sorted(value)[-top]
        else:
            worst = np.partition(value, len(value) - top)[len(value) - top]
        near = np.flatnonzero(value >= worst)
        rows, value = rows[near], value[near]
    return rows[np.argsort(-value, kind="stable")[:top]]


def block_maker(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["vec_id", "row"])
    low, planes = bit_planes(np.stack(rows["v"].to_numpy()).astype(np.int64))
    return pd.DataFrame([(rows["dim"].iloc[0], rows["block"].iloc[0], low, len(rows), planes.tobytes(), rows["vec_id"].to_numpy(np.int64).tobytes(),
                          rows["label"].to_numpy(np.int64).tobytes(), rows["row"].to_numpy(np.int64).tobytes())],
                        columns=["dim", "block", "low", "n", "planes", "ids", "labels", "rows"])


BLOCKS = "dim int, block long, low long, n int, planes binary, ids binary, labels binary, rows binary"


def slab_maker(rows: pd.DataFrame) -> pd.DataFrame:
    """Anchors of a slab; `positives` holds (place, vec_id, score) of each anchor, none in the first pass."""
    found = [list(p) if p is not None else [] for p in rows["positives"]]
    flat = [(p["place"], p["vec_id"], p["score"]) for f in found for p in f]
    return pd.DataFrame([(rows["dim"].iloc[0], rows["slab"].iloc[0], len(rows), np.stack(rows["v"].to_numpy()).astype(np.int64).tobytes(),
                          rows["vec_id"].to_numpy(np.int64).tobytes(), rows["label"].to_numpy(np.int64).tobytes(),
                          rows["row"].to_numpy(np.int64).tobytes(), np.array([len(f) for f in found], np.int64).tobytes(),
                          np.array(flat, np.int64).tobytes())],
                        columns=["dim", "slab", "a_n", "a_v", "a_ids", "a_labels", "a_rows", "a_found", "a_positives"])


SLABS = ("dim int, slab long, a_n int, a_v binary, a_ids binary, a_labels binary, a_rows binary, a_found binary, "
         "a_positives binary")
FOUND = "anchor_row long, anchor_id long, place int, positive_id long, positive_score long, vec_id long, row long, score long"


def miner(top: int, window: tuple[int, int] | None):
    """Cells to rows of FOUND: positives without a window, else negatives with score in [positive * window / 100]."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.to_pylist():
                yield from cut(cell)

    def cut(cell: dict) -> Iterator[pa.RecordBatch]:
        number = lambda c: np.frombuffer(cell[c], np.int64)
        ids, labels, rows = number("ids"), number("labels"), number("rows")
        planes = np.frombuffer(cell["planes"], np.uint8).reshape(-1, -(-cell["dim"] // 8), cell["n"])
        anchors = number("a_v").reshape(cell["a_n"], cell["dim"])
        a_ids, a_labels, a_rows = number("a_ids"), number("a_labels"), number("a_rows")
        positives = number("a_positives").reshape(-1, 3)
        start = np.append(0, np.cumsum(number("a_found")))
        own = {label: np.flatnonzero(labels == label) for label in np.unique(labels).tolist()}
        others: dict[int, np.ndarray] = {}
        none = np.empty(0, np.int64)
        for c in range(0, len(anchors), WIDE):
            table, out = scores(cell["low"], planes, anchors[c:c + WIDE]), []
            for k, score in enumerate(table.T, c):
                score = np.ascontiguousarray(score)
                label = int(a_labels[k])
                if window is None:
                    same = own.get(label, none)
                    out += [(k, 0, 0, 0, same_row, score[same_row]) for same_row in first(score, same[rows[same] != a_rows[k]], top)]
                    continue
                wanted = positives[start[k]:start[k + 1]]
                if len(wanted):
                    if label not in others:
                        others[label] = np.flatnonzero(labels != label)
                    away = others[label]
                    # the widest window first: what is left is short
                    value = score[away]
                    if value.dtype == np.int32:
                        value = value.astype(np.int64)
                    near = away[(100 * value >= window[0] * int(wanted[:, 2].min())) & (100 * value <= window[1] * int(wanted[:, 2].max()))]
                    value = score[near].astype(object) if score.dtype == object else score[near].astype(np.int64)
                    for place, vec_id, best in wanted.tolist():
                        fits = near[(100 * value >= window[0] * best) & (100 * value <= window[1] * best)]
                        out += [(k, place, vec_id, best, r, score[r]) for r in first(score, fits, top)]
            if out:
                k, place, vec_id, best, r, score = zip(*out)
                k, r = np.array(k), np.array(r)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a_rows[k]), pa.array(a_ids[k]), pa.array(place, pa.int32()), pa.array(vec_id, pa.int64()), pa.array(best, pa.int64()),
                     pa.array(ids[r]), pa.array(rows[r]), pa.array(map(int, score), pa.int64())],
                    names=[c.split()[0] for c in FOUND.split(", ")])
    return run


def hard_negatives(vectors: DataFrame, label: Column, is_anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 5,
                   window: tuple[int, int] = (80, 100), block_rows: int = BLOCK_ROWS, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of (vec_id, embedding) rows.

    An anchor's positives are its best other rows of the same label; for each of them, the best rows of other labels
    whose score is within `window` percent of the positive's. Ties go to the smaller vec_id. Rows without vec_id or
    label, and vectors that are NULL or hold NULL or non-finite components, take no part; vectors meet vectors of
    their own length. Equal rows count as often as they occur, as anchors too. An empty table gives no rows; further
    columns are not read. A score beyond 64 bits counts as the end of the range.
    """
    spark = vectors.sparkSession
    read = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"),
                          whole_numbers(F.col("embedding"), scale).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    read = read.where("vec_id is not null and label is not null and v is not null").withColumn("dim", F.size("v"))
    rows = stage(read.where("dim > 0").withColumn("row", F.monotonically_increasing_id()), "vectors")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("anchors")).first()
    n, cores = facts["n"], spark.sparkContext.defaultParallelism
    blocks = max(1, -(-n // block_rows), min(2 * cores, -(-n // LEAST_ROWS)))
    slabs = max(1, -(-facts["anchors"] // slab_rows))
    deal = lambda parts: F.pmod(F.xxhash64("row"), F.lit(parts))
    packed = stage(rows.withColumn("block", deal(blocks)).groupBy("dim", "block").applyInPandas(block_maker, BLOCKS), "blocks")
    each = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    anchors = rows.where("anchor").withColumn("slab", deal(slabs))

    def mine(slab_rows_: DataFrame, top: int, inside: tuple[int, int] | None) -> DataFrame:
        made = stage(slab_rows_.groupBy("dim", "slab").applyInPandas(slab_maker, SLABS), "slabs")
        cells = packed.withColumn("slab", each(slabs)).repartition(min(blocks * slabs, 4096), "block", "slab").join(made, ["dim", "slab"])
        return stage(cells.mapInArrow(miner(top, inside), FOUND), "found")

    none = F.lit(None).cast("array<struct<place int, vec_id long, score long>>")
    same = mine(anchors.withColumn("positives", none), positives, None)
    order = Window.partitionBy("anchor_row").orderBy(F.desc("score"), "vec_id", "row")
    best = same.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    best = best.groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("positives"))
    other = mine(anchors.join(best.withColumnRenamed("anchor_row", "row"), "row"), negatives, window)
    order = Window.partitionBy("anchor_row", "place").orderBy(F.desc("score"), "vec_id", "row")
    return (other.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))


# The production parameters over the table of embeddings; row numbers tell equal rows apart.
SQL = """
with e as (select row_number() over () as row, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
             list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
           from embeddings where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.row as anchor_row, a.vec_id as anchor_id, a.label = b.label as same, b.row, b.vec_id,
        cast(list_inner_product(a.v, b.v) as bigint) as score
      from e a join e b on a.row <> b.row and len(a.v) = len(b.v) where a.vec_id % 100 = 0),
p as (select *, row_number() over (partition by anchor_row order by score desc, vec_id, row) as place
      from s where same qualify place <= 5),
n as (select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
        row_number() over (partition by p.anchor_row, p.place order by s.score desc, s.vec_id, s.row) as rank
      from p join s on s.anchor_row = p.anchor_row and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score
      qualify rank <= 5)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n
"""
