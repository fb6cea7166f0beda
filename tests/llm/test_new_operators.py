"""Alignment, packing and hard negatives against plain versions of their rules."""

import collections
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from greengrain.llm import op11_alignment, op12_packing, op13_negatives
from greengrain.llm import queries as q
from greengrain.llm.tokens import ByteLevelTokens, read_bytes

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path(q.BYTE_LEVEL), public_tokenizers.path(q.PIECES)
ODD = ["", " ", "a", "  two  blanks ", "a\nb\n\nc", "<|endoftext|> x<|endoftext|>", "▁ stands for a blank", "ünï 中文 😀😀😀 \x00 x\x1cy",
       "don't, 'll (x).) y!", "́́" * 40, "aaaa" * 500, "1 22 333" * 50, "\r\n\t x", "x y 　z", "0x<0x41>"]


def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t


def pieces():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=B)


def plain_alignment(docs):
    """The rule word by word: token ends in bytes, groups between common ends, all pairs of a group."""
    t, s = library(), pieces()
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    found, held = [], collections.Counter()
    for i, text in docs:
        groups = []
        if text:
            a = [(e, bytes(byte[c] for c in t.id_to_token(e))) for e in t.encode(" " + text, add_special_tokens=False).ids]
            b = [(e, bytes([int(p[3:5], 16)]) if s.is_byte(e) else p.replace("▁", " ").encode())
                 for e in s.encode(text) for p in [s.id_to_piece(e)]]
            want = (" " + text).encode()
            if b"".join(x for _, x in a) == want == b"".join(x for _, x in b):
                ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
                common, start = sorted(set(ends[0]) & set(ends[1])), 0
                for end in common:
                    groups.append([[e for (e, _), z in zip(side, at) if start < z <= end] for side, at in zip((a, b), ends)])
                    start = end
        links = collections.Counter((x, y) for g in groups for x in g[0] for y in g[1])
        held.update(links.keys())
        found.append((i, groups, links))
    top = {}
    for (x, _), n in held.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for i, groups, links in found:
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(links.values()),
                    sum(n for p, n in links.items() if held[p] == top[p[0]]), sum(n * held[p] for p, n in links.items()),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_alignment_table(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    assert order(q.op11_alignment_links(spark, SF).collect()) == order(plain_alignment(docs))


def test_alignment_edges(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate(ODD * 2)] + [(None, "no id"), (None, None), (3, "repeated"), (3, "repeated")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("pair", "chunk", "n", "docs")})
    want = order(plain_alignment(rows))
    assert order(op11_alignment.aligned(df, A, B).collect()) == want
    # many chunks and blocks of a few entries give the same
    assert order(op11_alignment.aligned(df, A, B, chunk_bytes=30).collect()) == want
    monkeypatch.setattr(op11_alignment, "EXPAND", 3)
    x = op11_alignment.Aligner(read_bytes(A), read_bytes(B)).align(ODD)
    held = op11_alignment.row_of(x.overlap)
    assert x.overlap.value.sum() == sum(len((" " + t).encode()) for t, n in zip(ODD, np.diff(x.a_ptr)) if n)
    assert (x.a_group[held] == x.b_group[x.overlap.column]).all()
    assert op11_alignment.aligned(df.limit(0), A, B).count() == 0
    best = {(r["a_id"], r["n"]) for r in op11_alignment.translations(df, A, B).where("best").collect()}
    assert len({a for a, _ in best}) == len(best) > 0
    tokens = op11_alignment.spans(df.where("doc_id = 2"), A, B).collect()[0]
    assert tokens["a_group"] == tokens["b_group"] == tokens["overlap_a"] == [0] and tokens["shared"] == [2]


def test_long_group_counts_pairs_without_listing_them():
    text = "\U00010348" * 4000
    x = op11_alignment.Aligner(read_bytes(A), read_bytes(B))
    y = x.align([text, "a"])
    made = x.links(y)
    per_group = np.bincount(y.a_group) * np.bincount(y.b_group)
    assert made.value[:made.ptr[1]].sum() == per_group[:y.group_ptr[1]].sum()


def test_parts_encode_like_whole_texts():
    r = random.Random(5)
    alphabet = [" ", "  ", "\n", "\t", "a", "Bc", "é", "'s", "'", "don't", ",", ".", "!", "?)", "　", "\xa0", "\x1c", "\x85", "1", "中文",
                "😀", "<|endoftext|>", "\r\n", "\x00", "́", "'ll", "​", "﻿"]
    texts = ODD + ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 14))) for _ in range(3000)]
    coder, t = ByteLevelTokens(read_bytes(A)), library()
    ids, ptr = coder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(ptr[:-1], ptr[1:])] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    spelt = coder.token_bytes()
    assert b"".join(spelt[i] for i in ids) == "".join(texts).encode()


def check_packing(rows, docs, room):
    t, by = library(), collections.defaultdict(list)
    want = collections.Counter()
    for i, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % room or min(room, len(ids))
        starts = [0, *range(first, len(ids), room)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= room
    return len(by)


def test_packing_table(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    rows = q.op12_sum_of_squares(spark, SF).collect()
    used = check_packing(rows, docs, 2048)
    assert used <= -(-sum(r["length"] for r in rows) // 2048) + 3
    assert order(rows) == order(q.op12_sum_of_squares(spark, SF).collect())


def test_packing_tree(spark):
    """Groups of a few pieces in several levels: everything is packed once, and no worse than near the bound."""
    docs = [(k % 50 if k % 9 else None, "w " * (k * 37 % 90)) for k in range(600)] + [(7, None), (7, ""), (8, "x " * 500)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "length", "part", "order")})
    rows = op12_packing.packed(df, A, room=100, group_rows=60).collect()
    used = check_packing(rows, docs, 100)
    assert used <= 1.08 * sum(r["length"] for r in rows) / 100
    whole = op12_packing.sequences(df, A, room=100, group_rows=60).collect()
    assert len(whole) == used and sum(len(s["ids"]) for s in whole) == sum(r["length"] for r in rows)
    assert op12_packing.packed(df.limit(0), A).count() == 0


def test_sum_of_squares_takes_the_best_move():
    """Each move against all moves tried one by one."""
    r, room = np.random.default_rng(2), 20
    lengths = r.integers(1, room + 1, 300)
    where, offset = op12_packing.sum_of_squares(lengths, room)
    level = collections.Counter()
    total = lambda f: sum(n * n for n in collections.Counter(v for v in f.values() if v < room).values())
    for s, b, at in zip(lengths.tolist(), where.tolist(), offset.tolist()):
        assert level[b] == at and at + s <= room
        moves = [total(level | {k: f + s}) for k, f in level.items() if 0 < f <= room - s] + [total(level | {-1: s})]
        level[b] += s
        assert total(level) == min(moves)


def plain_negatives(rows, is_anchor, scale=256, label=lambda i, y: y):
    use = [(n, i, label(i, y), [math.floor(scale * float(x)) for x in v]) for n, (i, v, y) in enumerate(rows)
           if None not in (i, y, v) and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, y, v in use:
        if not is_anchor(i):
            continue
        inner = lambda w: min(max(sum(a * b for a, b in zip(v, w)), -2 ** 63), 2 ** 63 - 1)
        found = sorted((-inner(w), j, m, z) for m, j, z, w in use if m != n and len(w) == len(v))
        for s, j, *_ in [f for f in found if f[3] == y][:5]:
            fits = [f for f in found if f[3] != y and 80 * -s <= 100 * -f[0] <= 100 * -s][:5]
            out += [(i, j, k, f[1], -s, -f[0]) for k, f in enumerate(fits, 1)]
    return out


def test_negatives_table(spark):
    rows = duckdb.sql(f"select vec_id, embedding, label from '{SF}/embeddings.parquet'").fetchall()
    want = plain_negatives(rows, lambda i: i % 100 == 0, label=lambda i, y: (y + 1) % 10 if i % 7 == 0 else y)
    assert want and order(q.op13_hard_negatives(spark, SF).collect()) == order(want)


@pytest.mark.parametrize("size", [1.0, 1e7, 1e16])
def test_negatives_edges(spark, size):
    r = random.Random(9)
    rows = [(k // 2, [r.choice([-1.0, 0.5, 0.25, 1.0]) * size for _ in range(11)], k % 3) for k in range(160)]
    rows += [(500, [1.0] * 3, 1), (501, [1.0] * 3, 1), (502, [0.9] * 3, 2), (503, None, 1), (504, [1.0, None, 2.0], 1), (505, [], 1),
             (506, [float("nan")] * 3, 1), (507, [1.0] * 3, None), (None, [1.0] * 3, 2), (508, [float("inf")] * 3, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("row", "v", "slab", "n")})
    scale = 256 if size < 1e16 else 1
    got = op13_negatives.hard_negatives(df, F.col("label"), F.col("vec_id") % 10 == 0, scale=scale, block_rows=50, slab_rows=7).collect()
    want = plain_negatives(rows, lambda i: i % 10 == 0, scale)
    assert want and order(got) == order(want)
    assert op13_negatives.hard_negatives(df.limit(0), F.col("label"), F.lit(True)).count() == 0
