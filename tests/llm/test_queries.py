"""The registered queries against SQL or brute force on the given tables."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from compare import compare, database

from greengrain.llm import queries as q

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(name, columns="*"):
    return duckdb.sql(f"select {columns} from '{SF}/{name}.parquet'").fetchall()


@pytest.mark.parametrize("name", list(q.SQL))
def test_sql(spark, name):
    assert compare(spark, database(SF), q.QUERIES[name], q.SQL[name], SF) is None


def components(nodes, links):
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n
    for a, b in links:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return {n: root(n) for n in nodes}


def shingles(text, width):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def test_minhash(spark):
    docs = table("documents", "doc_id, text")
    sets = {i: shingles(t, 4) for i, t in docs}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(ids, links)
    got = {r["doc_id"]: r for r in q.op1_minhash(spark, SF).collect()}
    assert links and {i: (len(sets[i]), want[i], want[i] == i) for i in ids} == {
        i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()}


def test_tokens(spark):
    import base64
    import tiktoken
    with open(public_tokenizers.path(q.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for i, t in table("documents", "doc_id, text"):
        ids = own.encode_ordinary(t or "")
        want[i] = (len(ids), digest(np.array(ids, "<u4").tobytes()), digest((t or "").encode()))
    assert want == {r[0]: tuple(r)[1:] for r in q.op4_byte_bpe(spark, SF).collect()}


def test_classifier(spark):
    rows = q.op6_compression(spark, "/root/testdata/sf0.01").collect()
    labels = dict(duckdb.sql("select doc_id, quality from '/root/testdata/sf0.01/labels.parquet'").fetchall())
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
               and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    found = [[r["predicted"] for r in held if labels[r["doc_id"]] == q] for q in (0, 1)]
    assert sum(found[1]) >= 0.95 * len(found[1]) and sum(found[0]) <= 0.4 * len(found[0])


def test_top_k(spark):
    rows = [(i, np.array([math.floor(64 * float(x)) for x in v])) for i, v in table("embeddings", "vec_id, embedding")
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for i, v in rows:
        if i % 20 == 0:
            best = sorted((-int(v @ w), j) for j, w in rows if j != i)[:20]
            want |= {(i, k, j, -s) for k, (s, j) in enumerate(best, 1)}
    assert want and want == {tuple(r) for r in q.op7_mtree(spark, SF).collect()}


def test_mix(spark):
    docs = table("documents", "doc_id, source, text")
    size = {i: len(WORD.findall(t or "")) for i, _, t in docs}
    by = {}
    for i, s, _ in docs:
        by.setdefault(s, []).append(i)
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(size[i] for i in by[s]) for s in names}
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    capped = set()
    while True:
        rest = sum(total.values()) - sum(3 * total[s] for s in capped)
        level = rest / sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if s not in capped and weight[s] * level > 3 * total[s]}
        if not more:
            break
        capped |= more
    target = {s: 3 * total[s] if s in capped else weight[s] * level for s in names}
    got = q.op8_mixing(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(size)
    taken = dict.fromkeys(names, 0)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[r["source"]]
        assert math.isclose(r["target"], target[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= max(size[i] for i in by[s])
    again = {tuple(r) for r in q.op8_mixing(spark, SF).collect()}
    assert again == {tuple(r) for r in got}


def rules(text):
    words, lines, seen, covered = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)], {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i:i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {j for i in at for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_rules(spark):
    want = {i: rules(t) for i, t in table("documents", "doc_id, text")}
    for r in q.op2_quality_rules(spark, SF).collect():
        n, chars, symbols, lines, again = want[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want[r["doc_id"]]
        assert r["base_failed"] == (n < 20 or 100 * again > 30 * n) and not (r["base_failed"] and r["kept"])
