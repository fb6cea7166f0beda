"""What executors hold of the chunks of op11_alignment_links."""

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq

from greengrain.llm import op11_alignment as op
from greengrain.llm import queries as q
from greengrain.llm.tokens import read_bytes

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path(q.BYTE_LEVEL), public_tokenizers.path(q.PIECES)


def test_row_of_a_chunk_takes_less_than_its_text():
    docs = pa.RecordBatch.from_pandas(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' where text is not null").df())
    chunk, aligner = op.Chunk(), op.Aligner(read_bytes(A), read_bytes(B))
    chunk.add(docs, aligner)
    row, links = chunk.row(0), aligner.links(aligner.align(docs.column("text").to_pylist()))
    assert row.nbytes < chunk.bytes / 2
    counts = pa.table({"place": np.arange(len(row.column("held")[0])), "n": row.column("held")[0].values, "best": np.zeros(len(row.column("held")[0]), bool)})
    out = op.sums(pa.Table.from_batches([row]), counts)
    assert out.column("n_links").to_pylist() == [int(links.value[a:b].sum()) for a, b in zip(links.ptr[:-1], links.ptr[1:])]


def test_few_chunks_are_decoded_at_once(spark, monkeypatch):
    made, stage = [], op.stage
    monkeypatch.setattr(op, "stage", lambda *a, **k: made.append(stage(*a, **k)) or made[-1])
    monkeypatch.setattr(op, "SLICE_BYTES", 10)
    docs = spark.range(60).selectExpr("id doc_id", "concat('text number ', id) text").coalesce(1)
    assert op.aligned(docs, A, B, chunk_bytes=10).count() == 60
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in made[0].inputFiles()]
    groups = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
    assert max(groups) <= 8


def test_packed_numbers_of_any_size():
    for v in ([], [0], [255, 256], [2**40, 1, 0]):
        assert op.unpacked(op.packed(np.array(v, np.int64)), len(v)).tolist() == v
