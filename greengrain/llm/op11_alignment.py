"""Cross-tokenizer alignment by sparse products of token-byte incidence matrices.

A matrix is kept by hand in compressed rows: `Rows(ptr, column, value)`. Row i of A holds the bytes of token i of the
first tokenizer, B the same for the second. The Gustavson product A B^T, row by row, gives the overlap links with the
number of shared bytes. Two neighbouring overlap links that share no token have a common token end between them, so
they start a new group. With the group-incidence matrices G_A (groups x ids of A) and G_B, the product G_A^T G_B gives
the shared-group links of a document, each with its number of token pairs. Ids of a group are counted before they are
multiplied, and products are expanded in blocks of rows, so a group of a million tokens costs its distinct ids.

How many documents hold a pair of ids linked is a sum over the corpus. Documents are taken in chunks of bounded text:
one row per chunk holds the links of its documents as a sparse matrix over the chunk's distinct pairs. Only distinct
pairs per chunk travel to be counted, and the counts travel back to the chunk, where a sparse matrix-vector product
gives the sums per document. The best count of an A id is a window over its pairs, at most one per id of B. Outside
Python the matrix stays compressed: what an executor holds for a chunk is a fraction of its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from greengrain.functions.staging import stage
from greengrain.llm.common import give_back
from greengrain.llm.tokens import ByteLevelTokens, PieceTokens, gather, pointers, read_bytes, slices

CHUNK_BYTES, SLICE_BYTES, EXPAND = 1 << 23, 1 << 19, 1 << 21
ROW_GROUP = {"parquet.block.row.count.limit": "8"}  # chunks that a reader decodes at once, however large the files are
BITS = 20  # a pair of ids is one number: a << BITS | b


class Rows(NamedTuple):
    """A sparse matrix in compressed rows."""
    ptr: np.ndarray
    column: np.ndarray
    value: np.ndarray


def combined(row: np.ndarray, column: np.ndarray, value: np.ndarray, shape: tuple[int, int]) -> Rows:
    """A matrix of entries (row, column, value); equal places are added."""
    rows, bits = shape[0], shape[1].bit_length()
    key = row << bits | column
    if len(key) > 1 and not (key[1:] >= key[:-1]).all():
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    key = key[first]
    total = np.add.reduceat(value, first) if len(first) else value[:0]
    return Rows(pointers(np.bincount(key >> bits, minlength=rows)), key & ((1 << bits) - 1), total)


def row_of(m: Rows) -> np.ndarray:
    return np.repeat(np.arange(len(m.ptr) - 1), np.diff(m.ptr))


def gustavson(left: Rows, right: Rows, columns: int) -> Rows:
    """left x right: each row of the result adds up the rows of `right` that the entries of the left row name."""
    sizes = np.diff(right.ptr)[left.column]
    block = (np.cumsum(sizes) - sizes) // EXPAND
    bounds = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(sizes))
    of, shape = row_of(left), (len(left.ptr) - 1, columns)
    done = [np.empty(0, np.int64)] * 3
    for a, b in zip(bounds[:-1], bounds[1:]):
        at = gather(right.ptr, left.column[a:b])
        more = (np.repeat(of[a:b], sizes[a:b]), right.column[at], np.repeat(left.value[a:b], sizes[a:b]) * right.value[at])
        part = combined(*(np.concatenate(p) for p in zip(done, more)), shape)
        done = [row_of(part), part.column, part.value]
    return combined(*done, shape)


class Aligned(NamedTuple):
    """Token pairs of the documents of a slice; documents without tokens have empty rows."""
    a_ids: np.ndarray
    a_ptr: np.ndarray
    b_ids: np.ndarray
    b_ptr: np.ndarray
    overlap: Rows
    a_group: np.ndarray
    b_group: np.ndarray
    group_ptr: np.ndarray


class Aligner:
    def __init__(self, a_model: bytes, b_model: bytes):
        self.a, self.b = ByteLevelTokens(a_model), PieceTokens(b_model)
        self.bytes = [t.token_bytes() for t in (self.a, self.b)]
        self.length = [np.array([len(x) for x in b], np.int64) for b in self.bytes]
        self.blob = [np.frombuffer(b"".join(b), np.uint8) for b in self.bytes]
        self.at = [pointers(n) for n in self.length]
        width = max(len(str(len(n))) for n in self.length)
        ids = np.arange(max(map(len, self.length)))
        self.digits = (ids[:, None] // 10 ** np.arange(width - 1, -1, -1) % 10 + 48).astype(np.uint8)
        self.n_digits = np.maximum(1, (ids[:, None] >= 10 ** np.arange(width)).sum(axis=1))

    def align(self, texts: list[str]) -> Aligned:
        """Tokens, overlap links and groups of texts; a text whose tokens do not spell blank + text has none."""
        raw = [(" " + t).encode("utf-8") if t else b"" for t in texts]
        found = []
        for side, (ids, ptr) in enumerate((self.a.encode([" " + t if t else "" for t in texts]), self.b.encode(texts))):
            spelt = self.blob[side][gather(self.at[side], ids)].tobytes()
            ends = pointers(self.length[side][ids])[ptr].tolist()
            found.append((ids, ptr, [spelt[x:y] == r for x, y, r in zip(ends[:-1], ends[1:], raw)]))
        fits = np.array(found[0][2], bool) & np.array(found[1][2], bool) if texts else np.zeros(0, bool)
        kept = []
        for ids, ptr, _ in found:
            rows = np.flatnonzero(fits)
            kept.append((ids[gather(ptr, rows)], pointers(np.where(fits, np.diff(ptr), 0))))
        (a_ids, a_ptr), (b_ids, b_ptr) = kept
        # rows of A are tokens, columns bytes; row x of B^T is the one token of the second side at byte x
        a_len, b_len = self.length[0][a_ids], self.length[1][b_ids]
        n = int(a_len.sum())
        a = Rows(pointers(a_len), np.arange(n), np.ones(n, np.int64))
        bt = Rows(np.arange(n + 1), np.repeat(np.arange(len(b_ids)), b_len), np.ones(n, np.int64))
        overlap = gustavson(a, bt, len(b_ids))
        i, j = row_of(overlap), overlap.column
        group = np.cumsum((np.diff(i, prepend=-1) > 0) & (np.diff(j, prepend=-1) > 0)) - 1
        a_group, b_group = np.empty(len(a_ids), np.int64), np.empty(len(b_ids), np.int64)
        a_group[i], b_group[j] = group, group
        ends = np.append(a_group, group[-1] + 1 if len(group) else 0)
        return Aligned(a_ids, a_ptr, b_ids, b_ptr, overlap, a_group, b_group, ends[a_ptr])

    def links(self, x: Aligned) -> Rows:
        """Shared-group links: a row per document, a column per pair of ids, the number of token pairs as value."""
        groups, docs = int(x.group_ptr[-1]), len(x.group_ptr) - 1
        doc = np.repeat(np.arange(docs), np.diff(x.group_ptr))
        a, b = (combined(g, ids, np.ones(len(ids), np.int64), (groups, 1 << BITS))
                for g, ids in ((x.a_group, x.a_ids), (x.b_group, x.b_ids)))
        # rows of the transposed group matrix: (document, id of A), columns: groups
        entry = np.arange(len(a.column))
        left = Rows(np.arange(len(entry) + 1), row_of(a), a.value)
        made = gustavson(left, b, 1 << BITS)
        of = row_of(made)
        return combined(doc[left.column[of]], a.column[of] << BITS | made.column, made.value, (docs, 1 << 2 * BITS))

    def group_texts(self, x: Aligned) -> list[bytes]:
        """`a1,a2|b1;a3|b2,b3` of each document: decimal ids, groups in order."""
        groups = int(x.group_ptr[-1])
        a_at, b_at = (np.searchsorted(g, np.arange(groups + 1)) for g in (x.a_group, x.b_group))
        n = len(x.a_ids) + len(x.b_ids)
        ids, mark = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        ids[np.arange(len(x.a_ids)) + b_at[x.a_group]] = x.a_ids
        ids[np.arange(len(x.b_ids)) + a_at[x.b_group + 1]] = x.b_ids
        mark[a_at[1:] + b_at[:-1] - 1] = ord("|")
        mark[a_at[1:] + b_at[1:] - 1] = ord(";")
        width = self.digits.shape[1]
        cells = np.empty((n, width + 1), np.uint8)
        cells[:, :width], cells[:, width] = self.digits[ids], mark
        keep = np.arange(width + 1) >= (width - self.n_digits[ids])[:, None]
        flat = cells[keep].tobytes()
        ends = pointers(self.n_digits[ids] + 1)[x.a_ptr + x.b_ptr].tolist()
        return [flat[s:e - 1] if e > s else b"" for s, e in zip(ends[:-1], ends[1:])]


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, compressed: their lowest bytes, then the next ones; the first byte tells how many each has."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(raw: bytes, n: int) -> np.ndarray:
    width = raw[0]
    cells = np.zeros((n, 8), np.uint8)
    cells[:, :width] = np.frombuffer(pa.decompress(raw[1:], n * width, codec="zstd"), np.uint8).reshape(width, n).T
    return cells.view("<i8").ravel()


FACTS = pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                   ("groups_sha256", pa.string())])
CHUNK = pa.schema([("chunk", pa.int64()), ("docs", pa.list_(FACTS)), ("pairs", pa.list_(pa.int64())),
                   ("held", pa.list_(pa.int64())), ("sizes", pa.binary()), ("places", pa.binary()), ("times", pa.binary())])
CHUNK_SQL = ("chunk long, docs array<struct<doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string>>, "
             "pairs array<long>, held array<long>, sizes binary, places binary, times binary")


class Chunk:
    """Documents of about CHUNK_BYTES of text, their links collected as one sparse matrix."""

    def __init__(self):
        self.docs, self.pairs, self.times, self.sizes, self.bytes = [], [], [], [], 0

    def add(self, part: pa.RecordBatch, aligner: Aligner) -> None:
        texts = part.column("text").fill_null("").to_pylist()
        x = aligner.align(texts)
        m = aligner.links(x)
        digests = [hashlib.sha256(t).hexdigest() if t else "" for t in aligner.group_texts(x)]
        self.docs.append(pa.StructArray.from_arrays(
            [part.column("doc_id"), *(pa.array(np.diff(p)) for p in (x.a_ptr, x.b_ptr, x.group_ptr)), pa.array(digests, pa.string())],
            fields=list(FACTS)))
        self.pairs.append(m.column)
        self.times.append(m.value)
        self.sizes.append(np.diff(m.ptr))
        self.bytes += sum(map(len, texts))

    def row(self, number: int) -> pa.RecordBatch:
        """The chunk as one row; the places of a document's pairs are kept as their differences."""
        pairs, place, held = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        sizes = np.concatenate(self.sizes)
        step = np.diff(place, prepend=0)
        starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        step[starts] = place[starts]
        one = lambda v: pa.array([v])
        docs = pa.concat_arrays(self.docs)
        return pa.RecordBatch.from_arrays(
            [one(number), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs), one(pairs), one(held),
             one(packed(sizes)), one(packed(step)), one(packed(np.concatenate(self.times)))], schema=CHUNK)


def chunks(docs: DataFrame, a_model: str, b_model: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Documents (doc_id, text) aligned chunk by chunk, inside the tasks that read them."""
    tables = read_bytes(a_model), read_bytes(b_model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, chunk, number = None, Chunk(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                aligner = aligner or Aligner(*tables)
                chunk.add(part, aligner)
                if chunk.bytes >= chunk_bytes:
                    yield chunk.row(number)
                    chunk, number = Chunk(), number + 1
        if chunk.docs:
            yield chunk.row(number)
        aligner = chunk = batch = part = None
        give_back()
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, CHUNK_SQL)


def pair_counts(made: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold the pair linked, and whether no pair of its A id has more."""
    each = made.select(F.explode(F.arrays_zip("pairs", "held")).alias("p")).select("p.pairs", "p.held")
    counted = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("held").alias("n"))
    top = F.max("n").over(Window.partitionBy(F.shiftright("pair", BITS)))
    return counted.withColumn("best", F.col("n") == top)


def sums(made: pa.Table, counts: pa.Table) -> pa.Table:
    """Per document of one chunk: its links, those with the best count, and the sum of counts."""
    docs = made.column("docs").combine_chunks().flatten()
    raw = {c: made.column(c)[0].as_py() for c in ("sizes", "places", "times")}
    sizes = unpacked(raw["sizes"], len(docs))
    ptr = pointers(sizes)
    step, times = (unpacked(raw[c], int(ptr[-1])) for c in ("places", "times"))
    # differences back to places: a running sum that starts anew with each document
    run = pointers(step)
    place = run[1:] - np.repeat(run[ptr[:-1]], sizes)
    n, best = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, np.int64)
    at = counts.column("place").to_numpy()
    n[at], best[at] = counts.column("n").to_numpy(), counts.column("best").to_numpy()
    total = lambda v: np.diff(pointers(v)[ptr])
    out = [pa.array(total(v)) for v in (times, times * best[place], times * n[place])]
    fields = dict(zip(FACTS.names, docs.flatten()))
    return pa.table({**{k: fields[k] for k in ("doc_id", "n_a", "n_b", "n_groups")},
                     **dict(zip(("n_links", "n_best", "count_sum"), out)), "groups_sha256": fields["groups_sha256"]})


def aligned(docs: DataFrame, a_model: str, b_model: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of documents (doc_id, text).

    A text that is NULL or empty, or that either tokenizer does not spell as blank + text, has zeros and ''. Whole texts
    are aligned. Repeated rows and NULL doc_ids stay, each row counts as a document; an empty table gives an empty
    one, and further columns are not read.
    """
    made = stage(chunks(docs, a_model, b_model, chunk_bytes), "alignment", **ROW_GROUP)
    asked = made.select("chunk", F.posexplode("pairs").alias("place", "pair"))
    counts = asked.join(pair_counts(made), "pair").select(F.col("chunk").alias("of"), "place", "n", "best")
    rows = made.select("chunk", "docs", "sizes", "places", "times")
    return rows.groupBy("chunk").cogroup(counts.groupBy("of")).applyInArrow(
        sums, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def translations(docs: DataFrame, a_model: str, b_model: str) -> DataFrame:
    """(a_id, b_id, n, best): the pairs of ids linked in any document, with the number of documents."""
    counts = pair_counts(stage(chunks(docs, a_model, b_model), "alignment", **ROW_GROUP))
    return counts.select(F.shiftright("pair", BITS).cast("int").alias("a_id"),
                         F.col("pair").bitwiseAND((1 << BITS) - 1).cast("int").alias("b_id"), "n", "best")


def spans(docs: DataFrame, a_model: str, b_model: str) -> DataFrame:
    """(doc_id, a_ids, b_ids, a_group, b_group, overlap_a, overlap_b, shared): tokens, the group of each, overlap links."""
    tables = read_bytes(a_model), read_bytes(b_model)
    names = ["a_ids", "b_ids", "a_group", "b_group", "overlap_a", "overlap_b", "shared"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                aligner = aligner or Aligner(*tables)
                x = aligner.align(part.column("text").fill_null("").to_pylist())
                doc = np.arange(len(x.a_ptr) - 1)
                a_doc, b_doc = np.repeat(doc, np.diff(x.a_ptr)), np.repeat(doc, np.diff(x.b_ptr))
                i, o_ptr = row_of(x.overlap), x.overlap.ptr[x.a_ptr]
                cols = [(x.a_ids, x.a_ptr), (x.b_ids, x.b_ptr), (x.a_group - x.group_ptr[a_doc], x.a_ptr),
                        (x.b_group - x.group_ptr[b_doc], x.b_ptr), (i - x.a_ptr[a_doc[i]], o_ptr),
                        (x.overlap.column - x.b_ptr[a_doc[i]], o_ptr), (x.overlap.value, o_ptr)]
                lists = [pa.ListArray.from_arrays(pa.array(p, pa.int32()), pa.array(v, pa.int32())) for v, p in cols]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *lists], names=["doc_id", *names])
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} array<int>" for c in names))
