"""Best-fit packing of tokenized documents into sequences of fixed length by the sum-of-squares rule.

A document goes where the sum of squared counts of open bins per residual gap becomes smallest: an open bin, or a new
one. Ties go to the fullest bin, and to an open bin before a new one. Only what is longer than a sequence is cut: into
a first piece with the rest and full pieces, which are sequences of their own and need no packing.

Shorter pieces are dealt to groups of about `group_rows` by a hash of their row number, so no key decides a group's
size. Each group is packed in one task. Bins that stay open, the emptiest first and up to a part of 1 / `FAN` of the
group's pieces, are dissolved and packed again in the next level of a tree, which has that many groups less; the last
level is one group. What cannot go up stays packed as it is. So the loss is that of the root, not that of every group,
and a task holds two numbers per piece of one group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from greengrain.functions.staging import stage
from greengrain.llm.tokens import ByteLevelTokens, pointers, read_bytes, slices

ROOM, GROUP_ROWS, FAN = 2048, 65536, 4
MEMO, SLICE = 600_000, 1 << 24
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, length) of the pieces of documents with these sizes: the rest first, then full pieces."""
    count = np.maximum(1, -(-sizes // room))
    doc = np.repeat(np.arange(len(sizes)), count)
    first = np.zeros(len(doc), bool)
    first[np.cumsum(count) - count] = True
    return doc, np.where(first, sizes[doc] - (count[doc] - 1) * room, room)


def pieces(docs: DataFrame, model: str, room: int = ROOM, end: int = 0, with_ids: bool = False) -> DataFrame:
    """Token pieces (doc_id, piece, start, length, ids_crc32[, ids]) of documents (doc_id, text).

    A document is its ids and `end`; a NULL or empty text is `end` alone. Whole texts are encoded, rows stay as they
    are (repeated ones and NULL doc_ids too), an empty table gives an empty one, and further columns are not read.
    """
    table = read_bytes(model)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            for part in slices(batch, SLICE):
                coder = coder or ByteLevelTokens(table, memo=MEMO)
                ids, ptr = coder.encode(part.column("text"))
                flat = np.insert(ids, ptr[1:], end).astype("<u4")
                doc, length = cut(np.diff(ptr) + 1, room)
                at = pointers(length)
                first = np.searchsorted(doc, doc)
                raw = flat.data
                sums = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                out = [part.column("doc_id").take(pa.array(doc)), pa.array(np.arange(len(doc)) - first, pa.int32()),
                       pa.array(at[:-1] - at[first]), pa.array(length), pa.array(sums, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view("<i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(make, PIECE + (", ids array<int>" if with_ids else ""))


def sum_of_squares(lengths: np.ndarray, room: int, spare: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, taken in the given order; without `spare` a new bin only where nothing fits.

    A move from level h to h + s changes the sum of squares by 2 (count[h + s] - count[h] + 1), a move that fills a
    bin by 1 - 2 count[h], a new bin by 2 count[s] + 1. Only counts decide, so one vector expression judges all levels.
    """
    count, held = np.zeros(room + 1, np.int64), [[] for _ in range(room + 1)]
    where, offset, bins = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, s in enumerate(lengths.tolist()):
        level = 0
        if s < room:
            have = count[1:room - s + 1]
            change = 2 * (count[s + 1:] - have) + 2
            change[-1] -= 1
            change[have == 0] = np.iinfo(np.int64).max
            best = room - s - int(change[::-1].argmin())  # from the fullest level down
            if count[best] and (change[best - 1] <= 2 * count[s] + 1 or not spare):
                level = best
        if level:
            count[level] -= 1
            b = held[level].pop()
        else:
            b, bins = bins, bins + 1
        where[k], offset[k] = b, level
        if level + s < room:
            count[level + s] += 1
            held[level + s].append(b)
    return where, offset


def pack(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of squares, then once more over the pieces of the open bins, longest first, if that saves bins."""
    where, offset = sum_of_squares(lengths, room)
    filled = np.bincount(where, lengths)
    loose = np.flatnonzero(filled[where] < room)
    loose = loose[np.argsort(-lengths[loose], kind="stable")]
    again, at = sum_of_squares(lengths[loose], room, spare=False)
    if len(loose) and again.max() + 1 < (filled < room).sum():
        closed = np.cumsum(filled == room) - 1
        where = closed[where]
        where[loose], offset[loose] = again + max(0, int(closed[-1]) + 1), at
    return where, offset


def packer(room: int, level: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "row"], ignore_index=True)
        lengths = rows["length"].to_numpy()
        where, offset = pack(lengths, room)
        up = np.zeros(len(rows), bool)
        if not last:
            filled, members = np.bincount(where, lengths), np.bincount(where)
            emptiest = np.argsort(filled, kind="stable")
            goes = (np.cumsum(members[emptiest]) * FAN <= len(rows)) & (filled[emptiest] < room)
            up = np.isin(where, emptiest[goes])
        rows["sequence_id"] = (level << 56) + (int(rows["part"].iloc[0]) << 24) + where
        rows["offset"], rows["up"] = offset, up
        return rows.drop(columns=["order", "part"])
    return run


def placed(cut_pieces: DataFrame, room: int = ROOM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pieces with `row`, `sequence_id` and `offset`; `cut_pieces` holds the columns of PIECE and a unique `row`."""
    full = cut_pieces.where(F.col("length") >= room).withColumns(
        {"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("long")})
    schema = f"row long, {PIECE}, sequence_id long, offset long, up boolean"
    todo, out, level, n = cut_pieces.where(F.col("length") < room), [full], 0, None
    while True:
        n = todo.count()
        parts = max(1, -(-n // group_rows))
        deal = F.xxhash64("row", F.lit(level))
        groups = todo.withColumns({"order": deal, "part": F.pmod(F.shiftright(deal, 8), F.lit(parts))}).groupBy("part")
        done = stage(groups.applyInPandas(packer(room, level, parts == 1), schema), "packed")
        out.append(done.where(~F.col("up")).drop("up"))
        if parts == 1:
            break
        todo, level = done.where("up").drop("up", "sequence_id", "offset"), level + 1
    first = out[0].select(*out[1].columns)
    for other in out[1:]:
        first = first.unionByName(other)
    return first


def packed(docs: DataFrame, model: str, room: int = ROOM, end: int = 0, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per piece: the columns of `pieces` with its sequence and its place in there, gapless from 0."""
    rows = stage(pieces(docs, model, room, end).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return placed(rows, room, group_rows).drop("row")


def sequences(docs: DataFrame, model: str, room: int = ROOM, end: int = 0, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids, doc_ids, starts), at most `room` ids each."""
    rows = stage(pieces(docs, model, room, end, with_ids=True).withColumn("row", F.monotonically_increasing_id()), "pieces")
    where = placed(rows.drop("ids"), room, group_rows).select("row", "sequence_id", "offset", "doc_id")
    part = F.struct("offset", "doc_id", "ids")
    held = where.join(rows.select("row", "ids"), "row").groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("_p"))
    return held.select("sequence_id", F.flatten(F.col("_p")["ids"]).alias("ids"), F.col("_p")["doc_id"].alias("doc_ids"),
                       F.col("_p")["offset"].alias("starts"))
