"""Byte-level BPE encoding and decoding with a bitmap queue over merge ranks.

Each pre-token is a linked list of parts. Pairs wait in one bucket per merge rank; a two-level bitmap marks the ranks
that have a bucket, so the next merge is found by two find-first-set steps, whatever the length of the pre-token.
A bucket gives its positions from left to right. A merge changes the pairs on both sides and does not search for
their old entries: an entry whose pair has another rank by now is stale and skipped. Work grows as n log n, so one
pre-token of a million characters is no special case.

Pre-tokens that are new in a slice of texts share one queue, which takes a bucket as a whole (`merge_queue`).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable
from heapq import heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from greengrain.llm.common import by_batch
from greengrain.llm.merge_queue import BIT, WIDTH, MergeQueue
from greengrain.llm.tokens import Numbers, gather, numbered, pointers, slices

MEMO, MEMO_IDS, FEW, SLICE = 600_000, 5_000_000, 256, 1 << 24


class Codec:
    """Encoder and decoder of one rank table: lines of base64 token and rank."""

    def __init__(self, table: bytes, pattern: str):
        import regex
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, table.splitlines() if table else ())}
        self.token = {b: a for a, b in self.rank.items()}
        self.split = regex.compile(pattern).findall
        self.low = [0] * (max(self.rank.values(), default=0) // WIDTH + 1)
        self.queue: MergeQueue | None = None
        self.forget()

    def forget(self) -> None:
        self.known, self.pieces = Numbers(), Numbers()
        self.ids, self.ptr = np.empty(0, np.int32), np.zeros(1, np.int64)
        self.piece_ids, self.piece_ptr = np.empty(0, np.int32), np.zeros(1, np.int64)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token.

        A bucket with one position is that number, a longer one a heap of positions. `high` marks the words of the
        bitmap `low` that are not 0; all of them are 0 again at the end.
        """
        rank, low, n = self.rank, self.low, len(piece)
        if (whole := rank.get(piece)) is not None:
            return [whole]
        find = rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair, buckets, high = [-1] * n, {}, 0
        fresh = range(n - 1)
        while True:
            for i in fresh:
                j = after[i]
                r = find(piece[i:after[j]]) if j < n else None
                if r is None:
                    pair[i] = -1
                    continue
                pair[i] = r
                held = buckets.get(r)
                if held is None:
                    buckets[r] = i
                    word = r // WIDTH
                    low[word] |= BIT[r % WIDTH]
                    high |= BIT[word] if word < WIDTH else 1 << word
                elif held.__class__ is int:
                    buckets[r] = [held, i] if held < i else [i, held]
                else:
                    heappush(held, i)
            while high:
                word = (high & -high).bit_length() - 1
                bits = low[word]
                r = word * WIDTH + (bits & -bits).bit_length() - 1
                i = buckets[r]
                if i.__class__ is int:
                    del buckets[r]
                    low[word] = bits = bits & bits - 1
                    if not bits:
                        high &= high - 1
                else:
                    held = i
                    i = heappop(held)
                    if len(held) == 1:
                        buckets[r] = held[0]
                if pair[i] == r:
                    break
            else:
                break
            j = after[i]
            after[i] = end = after[j]
            pair[j] = -1
            if end < n:
                before[end] = i
            fresh = (before[i], i) if i else (i,)
        out, i = [], 0
        while i < n:
            out.append(rank[piece[i:after[i]]])
            i = after[i]
        return out

    def pairs(self) -> MergeQueue:
        """The queue over the pairs of parts that are a token together."""
        if self.queue is None:
            get, found = self.rank.get, []
            for token, r in self.rank.items():
                for cut in range(1, len(token)):
                    a = get(token[:cut])
                    if a is not None and (b := get(token[cut:])) is not None:
                        found.append((a, b, r))
            size = len(self.low) * WIDTH
            self.queue = MergeQueue([get(bytes((a,)), -1) for a in range(256)], found, np.arange(size), size)
        return self.queue

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, row pointers) of many pre-tokens: the queue of `merge` over all of them; what is odd there is merged alone."""
        whole = np.fromiter((self.rank.get(p, -1) for p in pieces), np.int32, len(pieces))
        open_ = np.flatnonzero(whole < 0).tolist()
        alone: dict[int, list[int]] = {}
        sizes = np.ones(len(pieces), np.int64)
        flat, counts = np.empty(0, np.int32), np.empty(0, np.int64)
        if len(open_) < FEW:
            alone = {k: self.merge(pieces[k]) for k in open_}
        else:
            flat, counts, odd = self.pairs().run([pieces[k] for k in open_])
            alone = {open_[k]: self.merge(pieces[open_[k]]) for k in odd}
            if (flat < 0).any():
                raise KeyError("the table lacks a byte")
        if len(counts):
            sizes[open_] = counts
        for k, ids in alone.items():
            sizes[k] = len(ids)
        ptr = pointers(sizes)
        out = np.empty(int(ptr[-1]), np.int32)
        out[ptr[:-1][whole >= 0]] = whole[whole >= 0]
        if len(counts):
            many = np.array([k for k in open_ if k not in alone], np.int64)
            out[gather(ptr, many)] = flat
        for k, ids in alone.items():
            out[ptr[k]:ptr[k + 1]] = ids
        return out, ptr

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, row pointers). Each distinct part and each distinct pre-token is looked at once."""
        if len(self.known) > MEMO or len(self.ids) > MEMO_IDS:  # only a memo: a fresh one costs time, not results
            self.forget()
        had = len(self.known)
        rows, at = numbered(texts, self.known, self.split)
        new = list(islice(reversed(self.known), len(self.known) - had))[::-1]
        if new:
            had = len(self.pieces)
            found = list(map(self.split, new))
            held = np.fromiter(map(self.pieces.__getitem__, chain.from_iterable(found)), np.int64)
            fresh = list(islice(reversed(self.pieces), len(self.pieces) - had))[::-1]
            if fresh:
                ids, ptr = self.merge_all([p.encode("utf-8", "surrogatepass") for p in fresh])
                self.piece_ids = np.concatenate([self.piece_ids, ids])
                self.piece_ptr = np.concatenate([self.piece_ptr, self.piece_ptr[-1] + ptr[1:]])
            ends = pointers(np.diff(self.piece_ptr)[held])[pointers(list(map(len, found)))]
            self.ids = np.concatenate([self.ids, self.piece_ids[gather(self.piece_ptr, held)]])
            self.ptr = np.concatenate([self.ptr, self.ptr[-1] + ends[1:]])
        ends = pointers(np.diff(self.ptr)[rows])
        return self.ids[gather(self.ptr, rows)], ends[at]

    def encode(self, text: str | None) -> list[int]:
        return self.merge_all([p.encode("utf-8", "surrogatepass") for p in self.split(text or "")])[0].tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def digests(self, ids: np.ndarray, ptr: np.ndarray) -> tuple[list[str], list[str]]:
        """SHA-256 of the ids of each text and of the bytes they decode to."""
        raw, bounds = ids.astype("<u4").data, ptr.tolist()
        there = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(bounds, bounds[1:])]
        back = [hashlib.sha256(self.decode(ids[a:b].tolist())).hexdigest() for a, b in zip(bounds, bounds[1:])]
        return there, back


def by_slice(df: DataFrame, make, schema: str) -> DataFrame:
    """`make` over parts of the Arrow batches with a bounded amount of text."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, SLICE):
                yield make(part)
    return df.mapInArrow(run, schema)


def read_table(path: str) -> bytes:
    """The rank file, read once by the driver; it travels inside the task (about 1 MB, fixed by the vocabulary)."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of documents (doc_id, text).

    A NULL or empty text has no ids. Rows stay as they are, repeated ones and NULL doc_ids too; an empty table
    gives an empty one, and further columns are not read.
    """
    table = read_table(path)
    codec = []

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec or codec.append(Codec(table, pattern))
        ids, ptr = codec[0].encode_all(batch.column("text"))
        ids = pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(ids))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])
    return by_slice(_read(docs), make, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): the way back."""
    table = read_table(path)
    codec = []

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec or codec.append(Codec(table, pattern))
        texts = [codec[0].decode(i or ()).decode("utf-8", "replace") for i in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])
    return by_batch(encoded.select("doc_id", "ids"), make, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, only digests leave the task."""
    table = read_table(path)
    codec = []

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec or codec.append(Codec(table, pattern))
        ids, ptr = codec[0].encode_all(batch.column("text"))
        there, back = codec[0].digests(ids, ptr)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(ptr)), pa.array(there, pa.string()), pa.array(back, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return by_slice(_read(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _read(docs: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encoded_rows(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, source, ids, n_tokens, ids_sha256, decoded_sha256) of documents (doc_id, source, text)."""
    from pyspark.sql import functions as F
    table = read_table(path)
    codec = []

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec or codec.append(Codec(table, pattern))
        ids, ptr = codec[0].encode_all(batch.column("text"))
        there, back = codec[0].digests(ids, ptr)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("source"), pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(ids)),
             pa.array(np.diff(ptr)), pa.array(there, pa.string()), pa.array(back, pa.string())],
            names=["doc_id", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256"])
    rows = _read(docs).withColumn("source", F.lit(None).cast("string")) if "source" not in docs.columns else docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.col("source").cast("string").alias("source"))
    return by_slice(rows, make, "doc_id long, source string, ids array<int>, n_tokens long, ids_sha256 string, "
                                "decoded_sha256 string")
