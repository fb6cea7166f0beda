"""Findings of the check of round 3: work that grew faster than it should."""

import base64
import random

import pyarrow as pa
import public_tokenizers

from greengrain.llm import op04_byte_bpe, op05_templates, tokens

WORDS = ["".join(random.Random(k).choices("abehinorst", k=3 + k % 9)) for k in range(3000)]
ODD = ["a  b", " a\tb\n", "\n\n", "don't  'll", "日本語 text,\nnext", "x\0y z", "é, ü.\n b", "", None, "a" * 500, "enen" * 40]
TEXTS = [" ".join(WORDS[i:i + 300]) + ".\n" + "! ".join(WORDS[i:i + 40]) for i in range(0, 3000, 300)] + ODD


def test_new_pre_tokens_share_one_queue(monkeypatch):
    codec = op04_byte_bpe.Codec(op04_byte_bpe.read_table(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    want, alone, merge = [codec.encode(t) for t in TEXTS], [], op04_byte_bpe.Codec.merge
    monkeypatch.setattr(op04_byte_bpe.Codec, "merge", lambda self, p: alone.append(p) or merge(self, p))
    ids, ptr = codec.encode_all(pa.array(TEXTS))
    assert [ids[a:b].tolist() for a, b in zip(ptr, ptr[1:])] == want
    assert len(alone) < 10


def test_the_queue_keeps_the_order_of_merges_in_any_table():
    for seed in range(20):
        draw = random.Random(seed)
        table = [bytes([b]) for b in range(256)] + sorted({bytes(draw.choices(b"abc", k=draw.randint(2, 5))) for _ in range(60)})
        draw.shuffle(table)
        codec = op04_byte_bpe.Codec(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(table)), public_tokenizers.PATTERN)
        pieces = ["".join(draw.choices("abc", k=draw.randint(1, 40))).encode() for _ in range(600)]
        ids, ptr = codec.merge_all(pieces)
        assert [ids[a:b].tolist() for a, b in zip(ptr, ptr[1:])] == [codec.merge(p) for p in pieces]


def test_the_library_encodes_only_what_the_queue_leaves():
    coder = tokens.ByteLevelTokens(tokens.read_bytes(public_tokenizers.path("byte_bpe_50k.json")))
    want, by_library, seen = [coder.model.encode(t or "", add_special_tokens=False).ids for t in TEXTS], coder.by_library, []
    coder.by_library = lambda parts: seen.extend(parts) or by_library(parts)
    ids, ptr = coder.encode(TEXTS)
    assert [ids[a:b].tolist() for a, b in zip(ptr, ptr[1:])] == want
    assert len(seen) < 10


def test_texts_move_once_when_recurring_lines_go(spark):
    rows = [(k, "en", f"Posted on {k} by the team of gardeners at home\n{' '.join(f't{k}x{j}' for j in range(30))}\n") for k in range(30)] + [(99, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    plan = op05_templates.cleaned(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1
    assert {r["doc_id"]: r["text"] for r in op05_templates.cleaned(docs).collect()} == {
        k: t if t is None else t.split("\n", 1)[1] for k, _, t in rows}


def test_words_of_lines_come_by_the_scan_and_not_by_a_join_of_texts(spark):
    docs = op05_templates.with_mark(spark.createDataFrame([(k, f"a b c {k} d e\nf g h i j{k}") for k in range(50)], "doc_id long, text string"))
    numbers = op05_templates.line_numbers(op05_templates.text_facts(docs, 3))
    some = numbers.where("mark % 5 = 0").select("line_hash", "mark").localCheckpoint()
    found = op05_templates.line_tokens(docs, some, 3)
    assert found.count() == some.count() > 0
    assert all(len(r["tokens"]) == r["free"] for r in found.collect())
    sieve = op05_templates.Sieve(some, "line_hash")
    every = numbers.select("line_hash").distinct().toPandas()["line_hash"].to_numpy()
    assert sieve.lets(some.toPandas()["line_hash"].to_numpy()).all() and sieve.lets(every).sum() < len(every)
