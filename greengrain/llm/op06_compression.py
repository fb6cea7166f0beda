"""Quality classifier by compression: two zstandard dictionaries, one of good and one of bad labelled text.

A text is compressed with either dictionary. The difference of the two sizes over the larger one says which text it
resembles, the larger size over the length how repetitive it is. A logistic curve through both, fitted on labelled
rows that built no dictionary, turns them into a probability. Dictionaries and curve come from a bounded sample of
labelled rows (parameters below); every text is scored whole, in the task that reads it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greengrain.llm.common import by_batch

FOLDS = 5
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES, LEVEL = 1500, 12_000, 112_640, 3


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def sizes(text: bytes, good, bad) -> tuple[float, float]:
    """The two features of a text from its compressors."""
    if not text:
        return 0.0, 1.0
    a, b = len(good.compress(text)), len(bad.compress(text))
    return (b - a) / max(a, b), max(a, b) / len(text)


def compressors(dictionaries: tuple[bytes, bytes]):
    import zstandard as z
    return [z.ZstdCompressor(level=LEVEL, dict_data=z.ZstdCompressionDict(d), write_checksum=False, write_content_size=False,
                             write_dict_id=False) for d in dictionaries]


def train_dictionary(texts: list[str]) -> bytes:
    import zstandard as z
    samples = [t.encode("utf-8", "surrogatepass") for t in texts if t]
    try:
        return z.train_dictionary(DICT_BYTES, samples).as_bytes()
    except z.ZstdError:  # too few samples to train on: their text is the dictionary
        return b"".join(samples)[-DICT_BYTES:]


def curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps; columns are the features and a constant."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def design(features: list[tuple[float, float]]) -> np.ndarray:
    x = np.array(features, float).reshape(-1, 2)
    return np.column_stack([x[:, 0], np.log(x[:, 1] + 1e-3), np.ones(len(x))])


def sampled(docs: DataFrame, labels: DataFrame, part: Column, quality: int, rows: int, chars: int) -> list[str]:
    """Whole texts of at most `rows` labelled documents of at most `chars` characters, by a hash of their id."""
    known = labels.where((F.col("quality") == quality) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    pool = docs.where((F.length("text") <= chars) & part)
    # ids alone are ordered and joined; the texts of at most `rows` ids are then read without a shuffle of all texts
    ids = (pool.select("doc_id").join(known, "doc_id", "left_semi").distinct()
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    texts = pool.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    return [r["text"] for r in texts.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]


def fitted(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> tuple[tuple[bytes, bytes], np.ndarray]:
    """Dictionaries and curve from the labelled rows outside fold 0."""
    docs = docs.withColumn("fold", fold(F.col("doc_id")))
    texts = {(q, dictionary): sampled(docs, labels, F.col("fold").isin([1, 2, 3] if dictionary else [4]), q, rows, chars)
             for q in (0, 1) for dictionary in (True, False)}
    dictionaries = tuple(train_dictionary(texts[q, True]) for q in (1, 0))
    good, bad = compressors(dictionaries)
    x, y = [], []
    for q in (0, 1):
        for t in texts[q, False]:
            x.append(sizes(t.encode("utf-8", "surrogatepass"), good, bad))
            y.append(float(q))
    # one class alone, or none: the constant decides
    return dictionaries, curve(design(x), np.array(y)) if x else np.zeros(3)


def scored(docs: DataFrame, labels: DataFrame, cut: float = 0.3, **bounds) -> DataFrame:
    """(doc_id, held_out, score, predicted) of documents (doc_id, text), learned from labels (doc_id, quality).

    held_out is true where crc32(doc_id) mod 5 is 0; those rows are never learned from. A NULL text is scored as an
    empty one, a row without doc_id is scored and not held out. Only doc_id, text and quality are read; labels of
    unknown documents and NULL labels do nothing, a document with both labels counts for both. Without labels every
    score is 0.5. Rows stay as they are, repeated ones too; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dictionaries, weights = fitted(rows, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality"), **bounds)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        good, bad = compressors(dictionaries)
        x = design([sizes(t.encode("utf-8", "surrogatepass") if t else b"", good, bad) for t in batch.column("text").to_pylist()])
        score = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])
    out = by_batch(rows, make, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= cut).cast("int").alias("predicted"))
