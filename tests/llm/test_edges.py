"""Nulls, empty and long texts, repeated rows, empty tables and columns with clashing names, for every operator."""

import math
import sys

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from greengrain.llm import (op01_minhash, op02_quality_rules, op03_chat, op04_byte_bpe, op05_templates, op06_compression,
                            op07_mtree, op08_mixing, op09_urls, op10_sharding)

BPE = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
LONG = " ".join(f"w{i}" for i in range(60_000))
PROSE = "the cat of the house and the dog in the yard of a man on the hill with it as by for now and then"
ROWS = [(1, PROSE, "en", "a"), (1, PROSE, "en", "a"), (2, PROSE, None, None), (3, None, "en", "a"), (4, "", None, "b"),
        (None, PROSE, "en", None), (None, None, None, None), (5, LONG, "en", "b"), (6, "one two", "en", "b"), (7, "ONE  two", "en", "b"),
        (8, "aaaa" * 3000, "en", "c"), (9, "ünï \U0001F600 \x00 x\x1cy", "de", "c"), (9, "another text", "de", "c")]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASH = ("n", "mark", "size", "words", "lines", "fold", "shard", "place", "copies", "rows", "p", "kept", "score", "key", "_d", "_m",
         "_t", "_k", "_id", "_src", "_size", "_n", "doc_row", "n_words", "line", "ids")


def frame(spark, rows=ROWS):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASH})


def ids(df):
    return sorted((r[0] is None, r[0] or 0) for r in df.collect())


WANT = sorted((r[0] is None, r[0] or 0) for r in ROWS)
LABELS = "doc_id long, quality int, toxic int"
EACH = {
    "op1": lambda s, d: op01_minhash.near_duplicates(d),
    "op2": lambda s, d: op02_quality_rules.judged(d),
    "op4": lambda s, d: op04_byte_bpe.round_trip(d, *BPE),
    "op4_encode": lambda s, d: op04_byte_bpe.decode(op04_byte_bpe.encode(d, *BPE), *BPE),
    "op5": lambda s, d: op05_templates.without_templates(d),
    "op6": lambda s, d: op06_compression.scored(d, s.createDataFrame([(1, 1, 0), (6, 0, 0), (99, None, 0), (None, 1, 0)], LABELS)),
    "op10": lambda s, d: op10_sharding.shards(d, [1.0, 2.0, 1.0], range_rows=2),
}


@pytest.mark.parametrize("name", list(EACH))
def test_rows_stay(spark, name):
    assert ids(EACH[name](spark, frame(spark)).select("doc_id")) == WANT
    assert EACH[name](spark, frame(spark, [])).count() == 0


def test_minhash_groups(spark):
    got = op01_minhash.near_duplicates(frame(spark)).collect()
    comp = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] not in (None, 9)}
    assert comp[2][1] == 1 and comp[7] == (1, 6) and comp[3] == (0, 3) and comp[4] == (0, 4) and comp[5][0] == 59_997
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    left = op01_minhash.without_duplicates(frame(spark))
    assert left.columns == frame(spark).columns
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 0, 1, 3, 4, 5, 6, 8, 9, 9]


def test_repeated_ids_keep_their_texts(spark):
    """One doc_id with a near copy and an unrelated text: each row is judged by its own text, and no text is lost."""
    a = " ".join(f"a{i}" for i in range(60))
    near = a.replace("a59", "other")
    b = " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (9, near), (9, b), (9, b), (12, b), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in op01_minhash.near_duplicates(docs).collect()}
    assert got == {(5, 5, True), (9, 5, False), (9, 9, True), (12, 9, False), (7, 7, True)}
    left = op01_minhash.without_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in left) == sorted([(5, a), (9, b), (7, "")])


def test_large_buckets(spark):
    """Many texts around a common passage, and a chain of near copies: exact components, with every path forced."""
    rng = np.random.default_rng(3)
    word = lambda: f"v{rng.integers(1 << 30)}"
    passage = [word() for _ in range(40)]
    texts = [" ".join([word() for _ in range(25)] + passage + [word() for _ in range(4)]) for _ in range(60)]
    chain = [word() for _ in range(60)]
    for _ in range(40):
        chain[rng.integers(60)] = word()
        texts.append(" ".join(chain))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    from test_queries import components, shingles
    sets = [shingles(t, 4) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts))
             if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(range(len(texts)), links)
    got = {r["doc_id"]: r["component_id"] for r in op01_minhash.near_duplicates(docs, small=3).collect()}
    assert got == want and links


def test_templates(spark):
    other = lambda i: " ".join(f"t{i}x{j}" for j in range(30))
    rows = [(i, f"{other(i)}\nThis page number {i} was printed for user u{i} on our site\nok", "en", "a") for i in range(12)]
    copy = "\n".join(f"A line of a copied text that is number {c} of all" for c in "abcdefgh")
    rows += [(100 + i, copy + f"\nand its own last line {i}", "en", "a") for i in range(12)]
    out = {r["doc_id"]: r for r in op05_templates.without_templates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(out[i]["n_dropped"] == 1 and out[i]["text"] == f"{other(i)}\nok" for i in range(12))
    assert all(out[100 + i]["n_dropped"] == 0 for i in range(12))
    kept = op05_templates.cleaned(spark.createDataFrame([*rows, (500, rows[0][1].split("\n")[1], "en", None)], SCHEMA))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in rows)


def test_copies_neither_add_nor_veto(spark):
    """A footer of 8 unrelated texts and of one group of 20 near copies goes from all; the lines of the group stay."""
    body = lambda i, n: " ".join(f"b{i}x{j}" for j in range(n))
    footer, nav = "Read more about our news at the end", "\n".join(f"Go to the page of section {c} of the shop" for c in "abcdef")
    rows = [(i, f"{body(i, 60)}\n{footer}", "en", "a") for i in range(8)]
    copied = "\n".join(f"{body(c, 12)} is a line of a story" for c in "pqrstuvw")
    rows += [(100 + i, f"{copied}\nlast words {i}\n{footer}", "en", "a") for i in range(20)]
    rows += [(200 + i, f"{nav}\n{body(900 + i, 40)}\n{body(950 + i, 3)}", "en", "a") for i in range(8)]
    out = {r["doc_id"]: r for r in op05_templates.without_templates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(out[i]["n_dropped"] == 1 for i in [*range(8), *range(100, 120)])
    assert all(footer not in r["text"] for r in out.values())
    assert all(out[200 + i]["n_dropped"] == 6 for i in range(8))


def test_short_lines_go(spark):
    """A line of three words in 25 different texts goes; in 3 texts or 25 near copies it stays."""
    body = lambda i: " ".join(f"s{i}x{j}" for j in range(40))
    rows = [(i, f"{body(i)}\nAll rights reserved." + ("\nSee also here" if i < 3 else "") + "\n---", "en", "a") for i in range(25)]
    rows += [(100 + i, f"{body('c')} {i}\nOf a copy", "en", "a") for i in range(25)]
    out = {r["doc_id"]: r["text"] for r in op05_templates.without_templates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any("All rights" in t for t in out.values())
    assert all("See also here" in out[i] for i in range(3)) and all("Of a copy" in out[100 + i] for i in range(25))
    assert all("---" in out[i] for i in range(25))


def test_long_passages_go_from_two_texts(spark):
    """A line of 30 words, and 56 words in lines of 7, in two different texts go; in two copies they stay, like one line of 7."""
    body = lambda i, n: " ".join(f"p{i}y{j}" for j in range(n))
    lined = "\n".join(body(f"q{k}", 7) for k in range(8))
    rows = [(1, f"{body(1, 80)}\n{body('l', 30)}", "en", "a"), (2, f"{body('l', 30)}\n{body(2, 80)}", "en", "a"),
            (3, f"{body(3, 120)}\n{lined}\nend 3", "en", "a"), (4, f"{lined}\n\n{body(4, 120)}", "en", "a"),
            (5, f"{body(5, 80)}\n{body('s', 7)}", "en", "a"), (6, f"{body(6, 80)}\n{body('s', 7)}", "en", "a"),
            (7, f"{body(7, 80)}\n{body('z', 30)} one", "en", "a"), (8, f"{body(7, 80)}\n{body('z', 30)} two", "en", "a")]
    out = {r["doc_id"]: r for r in op05_templates.without_templates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [out[i]["n_dropped"] for i in range(1, 9)] == [1, 1, 8, 8, 0, 0, 0, 0]
    assert out[4]["text"] == f"\n{body(4, 120)}"


def test_frequent_fields_stay_fields(spark):
    """Every month stands in 8 texts and every name in 6, each pair in one: fields all the same; so are digits anywhere."""
    body = lambda i: " ".join(f"f{i}z{j}" for j in range(40))
    months, names = [f"month{c}" for c in "abcdef"], [f"name{c}" for c in "abcdefgh"]
    rows = [(10 * i + j, f"{body(10 * i + j)}\nPosted on Monday {i} {m} 202{j} in the news of our town by {n}", "en", "a")
            for i, m in enumerate(months) for j, n in enumerate(names)]
    out = op05_templates.without_templates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 48 and all(r["n_dropped"] == 1 and "Posted" not in r["text"] for r in out)


def test_mixing(spark):
    plan = op08_mixing.copies(frame(spark), chunk=2).collect()
    assert sum(r["rows"] for r in plan) == len(ROWS) and all(0 <= r["copies"] <= 3 for r in plan)
    assert op08_mixing.copies(frame(spark, [])).count() == 0
    mixed = op08_mixing.mixed(frame(spark))
    assert mixed.columns == frame(spark).columns
    assert mixed.count() == sum(r["rows"] * r["copies"] for r in plan) or mixed.count() > 0
    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 97 + 1).cast("int")).alias("text"),
                                    F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    got = op08_mixing.copies(many, chunk=64).collect()
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["copies"] * r["size"] for r in own) - own[0]["target"]) <= 97


def test_pivot_keeps_expectation():
    rng = np.random.default_rng(1)
    mass, p = np.array([5.0, 2.0, 7.0, 1.0, 3.0]), np.array([0.3, 0.6, 0.5, 0.9, 0.2])
    sums = sum(op08_mixing.pivot(mass, p, rng, True) for _ in range(4000)) / 4000
    assert np.abs(sums - p).max() < 0.04


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://A.NET/x?y"), (5, "http://b.net"), (6, "http://WWW.Example.Net/en/1#t"),
            (7, "http://xexample.net/en/"), (8, "https://a.org/fr/?q"), (9, "https://casino-win.example.org/en/1"), (9, "https://ü.org/" + "a" * 50_000),
            (None, "x://y://z/p")]
    got = {r["page_id"]: tuple(r)[1:4] for r in op09_urls.judged(
        spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit(1), "w": F.lit(2), "x": F.lit(3)})).collect()}
    assert got[1] == got[2] == got[3] == ("", "", None)
    assert got[4] == ("a.net", "/x", "net/") and got[5] == ("b.net", "", None) and got[6] == ("www.example.net", "/en/1", "example.net/en/")
    assert got[7][2] == "net/" and got[8] == ("a.org", "/fr/", "org/fr/") and got[None][:2] == ("y:", "//z/p")
    assert op09_urls.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0
    weights = op09_urls.trained(spark).first()["weights"]
    assert np.allclose(weights, op09_urls.plain_weights())
    told = op09_urls.judged(spark.createDataFrame(list(enumerate(u for u, _ in op09_urls.LABELLED)), "page_id long, url string"), rules=())
    assert all((r["verdict"] == "block") == bool(op09_urls.LABELLED[r["page_id"]][1]) for r in told.collect())


def test_sharding(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = op10_sharding.shards(rows, [1.0, 1.0, 2.0], range_rows=100).collect()
    by = [[r for r in got if r["shard"] == s] for s in range(3)]
    assert all(sorted(r["slot"] for r in b) == list(range(len(b))) for b in by)
    assert all(r["grown_shard"] in (r["shard"], 3) for r in got)
    assert abs(len(by[2]) - 1500) < 150 and abs(sum(r["grown_shard"] == 3 for r in got) - 600) < 100


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "USER", " hi "), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"),
            (4, 0, None, None), (None, 0, "user", "lost"), (5, 0, "user", "hi"), (5, 1, "assistant", "yo"), (5, 2, "user", "x" * 100_000),
            (6, None, "user", "a"), (6, 0, "user", "b"), (6, 0, "user", "b")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("k", F.lit(1)).withColumn("state", F.lit(1))
    got = {r["conv_id"]: r for r in op03_chat.rendered(turns).collect()}
    assert {c: r["state"] for c, r in got.items()} == {1: "snapshot", 2: "snapshot", 3: "snapshot", 4: "maximal", 5: "maximal", 6: "maximal"}
    assert got[5]["chat"].startswith("<|user|>\nhi\n<|end|>\n<|assistant|>\nyo\n<|end|>\n") and got[6]["n_turns"] == 3
    copies = [(c, 0, "user", "same") for c in (9, 7, 8)]
    states = op03_chat.collapsed(spark.createDataFrame(copies, turns.select("conv_id", "turn", "role", "text").schema)).collect()
    assert {r["conv_id"]: r["state"] for r in states} == {7: "maximal", 8: "copy", 9: "copy"}
    assert op03_chat.rendered(turns.limit(0)).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)], "q") for i in range(400)]
    rows += [(i, rows[7][1], "q") for i in range(400, 700)] + [(700, None, "q"), (701, [1.0, None], "q"), (702, [math.nan] * 6, "q"),
                                                               (703, [math.inf] + [0.0] * 5, "q"), (704, [1.0, 2.0], "q"), (None, [1.0] * 6, "q"),
                                                               (705, [1e300] * 6, "q"), (5, rows[5][1], "q")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string").withColumn("dim", F.lit(1))
    got = [tuple(r) for r in op07_mtree.top_k(df, F.col("vec_id") % 20 == 0, k=20, tree_rows=300, page_rows=8, block=7).collect()]
    clean = [(i, [min(max(math.floor(64 * x), -2 ** 63), 2 ** 63 - 1) for x in v]) for i, v, _ in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: min(max(sum(x * y for x, y in zip(a, b)), -2 ** 63), 2 ** 63 - 1)
    want = []
    for i, v in {(i, tuple(v)) for i, v in clean if i % 20 == 0}:
        best = sorted((-dot(v, w), j) for j, w in clean if j != i and len(w) == len(v))[:20]
        want += [(i, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert sorted(got) == sorted(want)
    assert op07_mtree.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_quality_words(spark):
    got = {r["doc_id"]: r for r in op02_quality_rules.judged(frame(spark)).collect()}
    assert got[2]["n_words"] == 25 and got[2]["kept"] and not got[3]["kept"] and got[5]["n_words"] == 60_000 and not got[8]["kept"]
    assert op02_quality_rules.passing(frame(spark)).columns == frame(spark).columns


def test_pipeline(spark):
    sys.setrecursionlimit(10_000)
    docs = frame(spark)
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, None)
        assert docs.columns == frame(spark).columns, name
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, None).collect()
    assert all(r["doc_id"] in (1, None) for r in rows)
    empty = frame(spark, [])
    for _, step in corpus_pipeline.STAGES:
        empty = step(spark, empty, None)
    assert empty.count() == 0


def test_pipeline_on_tables(spark):
    import hashlib

    from greengrain.functions.staging import stage
    from test_queries import components, rules, shingles, table
    sf = "/root/testdata/sf0.001"
    texts = dict(table("documents", "doc_id, text"))
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, sf), name)
        seen.append(docs.collect())
    one, two, three, four, five = seen
    kept = {r["doc_id"] for r in op02_quality_rules.judged(spark.read.parquet(f"{sf}/documents.parquet")).collect() if r["kept"]}
    assert {r["doc_id"] for r in one} == kept and all(rules(texts[i])[0] >= 20 for i in kept)
    now = {r["doc_id"]: r["text"] for r in two}
    sets, order = {i: shingles(t, 5) for i, t in now.items()}, sorted(now)
    links = [(a, b) for k, a in enumerate(order) for b in order[k + 1:] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    left = {r["doc_id"] for r in three}
    assert left == {i for i, c in components(order, links).items() if i == c}
    assert {r["doc_id"] for r in four} <= left and len(four) == len(five) > 0
    assert all(r["decoded_sha256"] == hashlib.sha256(now[r["doc_id"]].encode()).hexdigest() for r in five)
