"""Near-duplicate groups by MinHash with tensored banding.

A plain table key joins `2 * rows` minhash values, and `tables` tables need `2 * rows * tables` of them. Here two
collections of `bands` half keys are made (each of `rows` values), and every pair of one left and one right half is
the key of one table: 100 tables from 40 values instead of 400. A key can only meet another one if both halves do,
so half keys that no other document has are dropped before any pair is formed.

Order of work, all of it on Spark:

1. one pass over the texts: set size, set fingerprint and half keys. Equal sets become one class.
2. half keys held by one class only go; the rest is tensored into table keys.
3. each bucket compares its members with its first member, on full sets (a star, never all pairs).
4. buckets in which a member did not match the first one: small ones compare the pairs not yet tied. Large ones that
   hold several components of all links so far follow the exact prefix rule: two sets of similarity t share one of
   the rarest n - ceil(t * n) + 1 elements of each, so their documents are regrouped by these elements and compared
   in the same way; what is still open then is compared pair by pair. Nothing is capped.

Two texts with a similarity of exactly t meet with probability (1 - (1 - t^rows)^bands)^2, 0.99993 at t = 0.8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greengrain.functions.staging import stage
from greengrain.llm.common import by_batch, mix, shingle_hashes
from greengrain.operators.network import components

BANDS, ROWS, SMALL = 10, 2, 24


def half_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """2 * bands half keys of one set: the minimum under 2 * bands * rows hash functions, joined by band."""
    count = 2 * bands * rows
    seeds = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    a, b = seeds[:count] | np.uint64(1), seeds[count:]
    low = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 4096):
        low = np.minimum(low, (hashes[i:i + 4096, None] * a + b).min(axis=0))
    out = np.arange(2 * bands, dtype=np.uint64)
    for values in low.reshape(2 * bands, rows).T:
        out = mix(out + values)
    return out.view(np.int64)


def sketches(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, mark, n, fp_a, fp_b, left, right) of documents (doc_id, mark, text)."""
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        import xxhash
        n, fps, halves = [], [], []
        for text in batch.column("text").to_pylist():
            h = shingle_hashes(text, width)
            n.append(len(h))
            print_ = xxhash.xxh3_128_intdigest(h.tobytes()).to_bytes(16, "little")
            fps.append(np.frombuffer(print_, np.int64))
            halves.append(half_keys(h, bands, rows) if len(h) else None)
        side = lambda at: [None if h is None else h[at] for h in halves]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("mark"), pa.array(n, pa.int64()), pa.array([f[0] for f in fps], pa.int64()),
             pa.array([f[1] for f in fps], pa.int64()), pa.array(side(slice(0, bands)), pa.list_(pa.int64())),
             pa.array(side(slice(bands, None)), pa.list_(pa.int64()))],
            names=["doc_id", "mark", "n", "fp_a", "fp_b", "left", "right"])
    return by_batch(docs, make, "doc_id long, mark long, n long, fp_a long, fp_b long, "
                                "left array<long>, right array<long>")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_hashes(t, width).view(np.int64) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))],
                                          names=["node", "members"])
    return by_batch(docs, make, "node long, members array<long>")


def similar(shared: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    return 100 * shared >= percent * (n_a + n_b - shared)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (source, target, n_source, n_target) whose full sets reach the similarity."""
    possible = pairs.where(similar(F.least("n_source", "n_target"), F.col("n_source"), F.col("n_target"), percent))
    a = sets.select(F.col("node").alias("source"), F.col("members").alias("_a"))
    b = sets.select(F.col("node").alias("target"), F.col("members").alias("_b"))
    both = possible.join(a, "source").join(b, "target")
    shared = F.size(F.array_intersect("_a", "_b"))
    return both.where(similar(shared, F.size("_a"), F.size("_b"), percent)).select("source", "target")


def table_keys(classes: DataFrame) -> DataFrame:
    """(key, node, n, m, head): all pairs of a left and a right half key that some other class holds too."""
    halves = classes.select("node", "n", F.explode(F.concat(
        F.transform("left", lambda h: F.struct(F.lit(True).alias("is_left"), h.alias("half"))),
        F.transform("right", lambda h: F.struct(F.lit(False).alias("is_left"), h.alias("half"))))).alias("h")
    ).select("node", "n", "h.*")
    met = halves.groupBy("half").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    # at most 2 * bands rows per class
    live = (halves.join(met, "half", "left_semi").groupBy("node", "n").agg(
        F.collect_set(F.when(F.col("is_left"), F.col("half"))).alias("left"),
        F.collect_set(F.when(~F.col("is_left"), F.col("half"))).alias("right")))
    return (live.select("node", "n", F.explode("left").alias("a"), "right")
            .select("node", "n", "a", F.explode("right").alias("b"))
            .select(F.xxhash64("a", "b").alias("key"), "node", "n", F.col("n").alias("m"), F.lit(True).alias("head")))


def shared_buckets(keyed: DataFrame) -> DataFrame:
    """Members (key, node, n, m, head) of buckets with two or more, with bucket size and first member."""
    heads = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("node", "n")).alias("lead"))
    return keyed.join(heads.where("c > 1"), "key")


def star(members: DataFrame) -> DataFrame:
    """Each member with the first member of its bucket, once."""
    return (members.where(F.col("node") != F.col("lead.node"))
            .select(F.col("node").alias("source"), F.col("lead.node").alias("target"),
                    F.col("n").alias("n_source"), F.col("lead.n").alias("n_target")).distinct())


def unmet(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members of buckets in which the star left something open; comp is the first member if it is linked to it."""
    known = links.select(F.col("source").alias("node"), F.col("target").alias("_t"))
    named = members.withColumn("_t", F.col("lead.node")).join(known.withColumn("_met", F.lit(True)), ["node", "_t"], "left")
    named = named.withColumn("comp", F.when(F.col("_met"), F.col("_t")).otherwise(F.col("node")))
    left = named.where(F.col("comp") != F.col("_t")).select("key").distinct()
    return named.join(left, "key", "left_semi").select("key", "node", "n", "m", "head", "c", "comp")


def open_buckets(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members of buckets that hold several components of the links, with their component."""
    ends = links.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    labels = components(links, ends, "node")
    named = members.drop("comp").join(labels, "node", "left").withColumn("comp", F.coalesce("community", "node"))
    several = named.groupBy("key").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b")).where("_a < _b")
    return named.join(several.select("key"), "key", "left_semi").select("key", "node", "n", "m", "head", "c", "comp")


def all_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components inside each bucket that can still be similar, each pair once.

    m counts the elements of a set that the other set may hold if this is the first key they share, so a pair goes where
    the smaller m is too few. head tells whether the key may bring the set together with a larger one.
    """
    a = members.select("key", F.col("node").alias("source"), F.col("n").alias("n_source"), F.col("m").alias("_m"), F.col("head").alias("_h"),
                       F.col("comp").alias("_x"))
    b = members.select("key", F.col("node").alias("target"), F.col("n").alias("n_target"), F.col("m").alias("_k"), F.col("head").alias("_g"),
                       F.col("comp").alias("_y"))
    can = similar(F.least("_m", "_k"), F.col("n_source"), F.col("n_target"), percent)
    return (a.join(b, "key").where((F.col("source") < F.col("target")) & (F.col("_x") != F.col("_y")) & can
                                & F.when(F.col("n_source") <= F.col("n_target"), F.col("_h")).otherwise(F.col("_g")))
            .select("source", "target", "n_source", "n_target").distinct())


def rare_elements(sets: DataFrame, percent: int) -> DataFrame:
    """(key, node, n, m, head): each set under its rarest n - ceil(t * n) + 1 elements, by the counts within `sets`.

    A set that shares too few elements with any other goes at once. With a set of its size or more, a set must share
    one of its rarest n - ceil(2t / (1 + t) * n) + 1 elements already; head marks these. m counts the elements from the
    key on: two sets share no more than the smaller m under the first key they share, and that key brings them together.
    """
    rows = sets.select("node", F.size("members").cast("long").alias("n"), F.explode("members").alias("key"))
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    take = F.col("n") - F.ceil(F.col("n") * percent / 100.0) + 1
    short = F.col("n") - F.ceil(F.col("n") * (2.0 * percent) / (100.0 + percent) - 1e-9) + 1
    return (rows.join(counts, "key").groupBy("node", "n")
            .agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("order"), F.count_if(F.col("df") > 1).alias("m"))
            .where(100 * F.col("m") >= percent * F.col("n"))
            .select("node", "n", "m", F.posexplode(F.slice("order", F.lit(1), take.cast("int"))).alias("pos", "e"))
            .where("e.df > 1").select("e.key", "node", "n", (F.col("n") - F.col("pos")).alias("m"), (F.col("pos") < short).alias("head")))


def representatives(members: DataFrame, classes: DataFrame, docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc_id, text) with the node as doc_id: one text of each class that meets another one.

    A class is named by the mark of one of its texts. Its text comes from the row with that mark and the smallest doc_id;
    where rows repeat as a whole, one of them is taken.
    """
    wanted = members.select("node").distinct().join(classes.select("node", F.col("rep_id").alias("doc_id")), "node")
    texts = docs.withColumn("node", F.xxhash64("text")).join(wanted, ["node", "doc_id"], "left_semi")
    if not repeated.join(wanted.select("node", "doc_id"), ["node", "doc_id"], "left_semi").isEmpty():
        texts = texts.dropDuplicates(["node"])
    return texts.select(F.col("node").alias("doc_id"), "text")


def links_between(classes: DataFrame, docs: DataFrame, repeated: DataFrame, width: int, percent: int, small: int) -> DataFrame:
    """Confirmed links that connect every pair of classes the tables bring together."""
    members = stage(shared_buckets(table_keys(classes)), "buckets")
    sets = stage(shingle_sets(representatives(members, classes, docs, repeated), width), "sets")
    links = stage(confirmed(star(members), sets, percent), "links")
    rest = stage(unmet(members, links), "open")
    near = confirmed(all_pairs(rest.where(F.col("c") <= small), percent), sets, percent)
    links = stage(links.unionByName(near), "links")
    large = rest.where(F.col("c") > small)
    if large.isEmpty():
        return links
    large = stage(open_buckets(large, links), "open")
    if large.isEmpty():
        return links
    few = stage(sets.join(large.select("node").distinct(), "node", "left_semi"), "sets")
    members = stage(shared_buckets(rare_elements(few, percent)), "buckets")
    met = stage(confirmed(star(members), few, percent), "links")
    links = stage(links.unionByName(met), "links")
    rest = stage(unmet(members, met), "open")
    if rest.where(F.col("c") > small).isEmpty():
        return stage(links.unionByName(confirmed(all_pairs(rest, percent), few, percent)), "links")
    rest = stage(open_buckets(rest, links), "open")
    return stage(links.unionByName(confirmed(all_pairs(rest, percent), few, percent)), "links")


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80, bands: int = BANDS, rows: int = ROWS,
                    small: int = SMALL) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, mark) for each row of documents (doc_id, text).

    Texts are linked when 100 * shared >= percent * union of their distinct word shingles; component_id is the
    smallest doc_id in reach, mark a hash of the text. A text without words has no shingles and no links. A row without doc_id takes no
    part: its component_id is NULL and it is kept. Repeated rows share their class, and repeated doc_ids with
    different texts are judged row by row. Empty tables give no rows; further columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = stage(sketches(docs.withColumn("mark", F.xxhash64("text")), width, bands, rows), "sketches")
    own = seen.where("doc_id is not null and n > 0")
    # a class is a set of shingles; doc_ids may repeat, so they name nothing before the last step
    classes = stage(own.groupBy("fp_a", "fp_b", "n").agg(
        F.min(F.struct("mark", "doc_id")).alias("rep"), F.min("doc_id").alias("first_id"), F.any_value("left").alias("left"),
        F.any_value("right").alias("right")).select("*", F.col("rep.mark").alias("node"), F.col("rep.doc_id").alias("rep_id")).drop("rep"), "classes")
    repeated = own.groupBy(F.col("mark").alias("node"), "doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    links = links_between(classes, docs, repeated, width, percent, small)
    ends = links.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    labels = stage(components(links, ends, "node").join(classes.select("node", "first_id"), "node"), "labels")
    first = labels.groupBy("community").agg(F.min("first_id").alias("smallest"))
    named = (classes.select("fp_a", "fp_b", "node", "first_id").join(labels.join(first, "community").select("node", "smallest"), "node", "left")
             .select("fp_a", "fp_b", F.coalesce("smallest", "first_id").alias("component_id")))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return (seen.select("doc_id", "mark", F.col("n").alias("n_shingles"), "fp_a", "fp_b")
            .join(named, ["fp_a", "fp_b"], "left")
            .select("doc_id", "n_shingles", own.alias("component_id"),
                    F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"), "mark"))


def without_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The kept rows of documents with the columns of the input; of equal rows (doc_id, text) one stays.

    Rows without doc_id all stay. Decisions come back by doc_id and a hash of the text.
    """
    named = stage(near_duplicates(docs, **options), "judged")
    key = ["doc_id", "mark"]
    again = named.where("kept and doc_id is not null").groupBy(*key).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select(*key)
    out = named.where(~F.col("kept")).select(*key).unionByName(again).distinct().withColumnsRenamed({"doc_id": "_d", "mark": "_m"})
    def here(keys: DataFrame) -> Column:
        return (docs["doc_id"].cast("long") == keys["_d"]) & (F.xxhash64(docs["text"].cast("string")) == keys["_m"])
    plain = docs.join(out, here(out), "left_anti")
    if again.isEmpty():
        return plain
    again = again.withColumnsRenamed({"doc_id": "_d", "mark": "_m"})
    once = docs.join(again, here(again), "left_semi").dropDuplicates(["doc_id", "text"])
    return plain.unionByName(once)
