"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The separators of words are the blank and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    """Words of a text as an array; no text gives an empty array."""
    parts = F.split(F.coalesce(text, F.lit("")), rf"{SPACE_CLASS}+")
    return F.filter(parts, lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def by_batch(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply a function to Arrow batches inside the tasks that read the rows; nothing is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield make(b)
    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return to the system what this process has freed but keeps: Python workers stay beside later steps after their task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in the GNU library
    if trim:
        trim(0)


def byte_words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8 with A-Z lower-cased; bytes methods know ASCII only, as asked."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle."""
    import xxhash
    words = byte_words(text)
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(width, len(words))
    acc = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        acc = mix(acc + w[i:i + len(acc)])
    return np.unique(acc)
