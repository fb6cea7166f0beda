"""Line dedup by a log-template tree: lines that recur across documents, up to their variable fields, are dropped.

A line falls through a tree of fixed depth: its word count, then its first `lead` words. A word with a digit is a
variable at any position. Under its leaf a line has up to three templates: the line as it stands, without variables; a
narrow one, whose further words stand at their position in `min_docs` texts of the leaf; and a broad one, whose words
have a share of `WIDE_PERCENT` of the leaf, so that months or frequent names stay fields however many texts there are.
Templates with variables need `min_words` words and enough fixed ones; a shorter line without a letter stays.

A template is dropped everywhere if enough classes of texts hold it: `EVIDENCE` fixed words over all of them, so 20 for
one word and 3 for seven; two classes at least, `min_docs` for a template with variables. A passage of consecutive lines
with `PASSAGE` words is a template of its own and needs two classes.

A class is a group of near copies and counts once, whatever its size, so the lines of copies stay for the near-duplicate
step while a licence line goes from all. Each text has a sketch, the smallest hash of its five-word shingles in each of
SKETCH ranges. Texts that share the values of BAND neighbouring ranges are compared with the one of them that has the
smallest mark, and linked where SAME_PERCENT of their sketches agree; classes are the connected groups. They depend on the
texts alone, so every order and partitioning of the rows gives the same result.

Counts are taken over distinct (line, class): a line in a third of all documents is one row per class, later one row.

A text is split once, into hashes, leaves and word counts of its lines. It is read again for the words of lines that may have
variables: a Bloom filter of fixed size (`Sieve`) tells in the scan which lines to send, and an exact join follows. Only the
last step moves texts, once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greengrain.functions.staging import stage
from greengrain.llm.common import SPACE_CLASS, by_batch
from greengrain.llm.tokens import gather, pointers, slices
from greengrain.operators.network import components

LEAD, MIN_WORDS, MIN_DOCS, FIXED_PERCENT = 3, 5, 4, 50
EVIDENCE, PASSAGE, WIDE_PERCENT = 20, 50, 25
SKETCH, BAND, SAME_PERCENT, SHINGLE = 48, 3, 40, 5
# The field of the shingle hashes and the factor of their polynomial.
PRIME, FACTOR = 2 ** 31 - 1, 1_000_003
DIGIT, LATIN = re.compile(b"[0-9]").search, re.compile(b"[A-Za-z]").search


def needed(words: Column, least: int) -> Column:
    """Classes that must hold a template with so many fixed words."""
    return F.greatest(F.ceil(F.lit(EVIDENCE) / words), F.lit(least)).cast("long")


def _mark() -> Column:
    """Texts are told apart by 60 bits of a hash; equal texts share every decision."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def with_mark(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _mark().alias("mark"))


def signed(h: int) -> int:
    return h - (h >> 63 << 64)


def leaf_of(line: bytes, n: int, lead: int) -> int:
    """The leaf of a line of n words: n and its first words, those with a digit as one sign."""
    import xxhash
    first = [b"*" if DIGIT(w) else w for w in line.split(None, lead)[:lead]]
    return xxhash.xxh64_intdigest(b" ".join(first), n)


class Sieve:
    """A Bloom filter of 64-bit hashes with 2 ** 23 bits, whatever their number: one megabyte goes to the driver and the tasks.

    It only spares rows; what it lets through by chance is left out by the join that follows.
    """

    BITS, PART = 23, 15

    def __init__(self, hashes: DataFrame, column: str):
        spots = hashes.select(F.explode(F.array(*(self._spot(F.col(column), k) for k in range(2)))).alias("spot"))
        parts = spots.groupBy(F.shiftright("spot", self.PART).alias("part")).agg(
            F.bitmap_construct_agg(F.col("spot").bitwiseAND((1 << self.PART) - 1)).alias("bits")).collect()
        held = np.zeros((1 << self.BITS - self.PART, 1 << self.PART - 3), np.uint8)
        for r in parts:
            held[r["part"]] = np.frombuffer(r["bits"], np.uint8)
        self.held = held.ravel()

    def _spot(self, h: Column, k: int) -> Column:
        return F.shiftright(h, 20 * k + 7).bitwiseAND((1 << self.BITS) - 1)

    def lets(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for k in range(2):
            spot = (hashes >> (20 * k + 7)) & ((1 << self.BITS) - 1)
            out &= (self.held[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)
        return out


class Words(dict):
    """Hash of a word, kept for the next time."""

    def __missing__(self, w: bytes) -> int:
        self[w] = h = int(hashlib.md5(w).hexdigest()[:8], 16) % PRIME
        return h


def smallest(h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """[text, range] smallest shingle hashes, -1 for none, from word hashes and row pointers of the texts.

    A text with fewer words than a shingle is one shingle.
    """
    out = np.full((len(ptr) - 1) * SKETCH, PRIME, np.int64)
    n = np.diff(ptr)
    for size in range(1, SHINGLE + 1):
        own = np.flatnonzero(n == size) if size < SHINGLE else np.flatnonzero(n >= SHINGLE)
        if not len(own):
            continue
        at, text = gather(ptr, own), np.repeat(own, n[own])
        at, text = (v[at <= ptr[text + 1] - size] for v in (at, text))
        acc = np.zeros(len(at), np.int64)
        for i in range(size):
            acc = (acc * FACTOR + h[at + i]) % PRIME
        np.minimum.at(out, text * SKETCH + acc % SKETCH, acc)
    out[out == PRIME] = -1
    return out.reshape(-1, SKETCH)


def _keys(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, row pointers): one key per band of ranges that holds a shingle."""
    bands = least.reshape(len(least), -1, BAND)
    acc = np.broadcast_to(np.arange(bands.shape[1]), bands.shape[:2]).astype(np.uint64)
    for i in range(BAND):
        acc = (acc ^ bands[:, :, i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    held = (bands >= 0).any(axis=2)
    return acc[held].view(np.int64), pointers(held.sum(axis=1))


def _runs(hashes: list[int], counts: list[int]) -> tuple[list[int | None], list[int]]:
    """From each line on, the hash and the number of the first lines that have PASSAGE words, two lines at least."""
    import xxhash
    raw, runs, sizes, words, end = np.array(hashes, np.int64).tobytes(), [], [], 0, 0
    for i, n in enumerate(counts):
        while words < PASSAGE and end < len(counts):
            words, end = words + counts[end], end + 1
        if words >= PASSAGE and end - i > 1:
            run = xxhash.xxh64_intdigest(raw[8 * i:8 * end], 7)
            runs.append(run - (run >> 63 << 64))
        else:
            runs.append(None)
        sizes.append(end - i)
        words -= n
    return runs, sizes


def text_facts(texts: DataFrame, lead: int) -> DataFrame:
    """(mark, sketch, keys, hashes, runs, sizes, leaves, counts, letters) of each text; a text is split into lines and words once."""
    known = []

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        import regex
        import xxhash
        letter = regex.compile(r"\p{L}").search
        known or known.append(Words())
        if len(known[0]) > 500_000:  # only a memo
            known[0].clear()
        parts = pc.split_pattern(b.column("text").fill_null(""), "\n")
        flat, text_of = parts.flatten(), np.asarray(pc.list_parent_indices(parts))
        split = pc.ascii_split_whitespace(flat)
        words, line_of = split.flatten(), np.asarray(pc.list_parent_indices(split))
        full = np.asarray(pc.binary_length(words)) > 0
        each, line_of = pc.ascii_lower(words.filter(pa.array(full))).dictionary_encode(), line_of[full]
        distinct = each.dictionary.cast(pa.binary()).to_pylist()
        h = np.fromiter(map(known[0].__getitem__, distinct), np.int64, len(distinct))[np.asarray(each.indices)]
        n = np.bincount(line_of, minlength=len(flat))
        held = np.flatnonzero(n)
        hashes, leaves, letters, counts = [], [], [], n[held].tolist()
        for line, size in zip(flat.take(pa.array(held)).cast(pa.binary()).to_pylist(), counts):
            hashes.append(signed(xxhash.xxh64_intdigest(line, 42)))
            leaves.append(signed(leaf_of(line, size, lead)))
            letters.append(LATIN(line) is not None or letter(line.decode("utf-8", "replace")) is not None)
        at = pointers(np.bincount(text_of[held], minlength=b.num_rows))
        runs, lengths = [], []
        for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
            some, many = _runs(hashes[x:y], counts[x:y])
            runs += some
            lengths += many
        least = smallest(h, pointers(np.bincount(text_of[line_of], minlength=b.num_rows)))
        tags = np.where(least < 0, 0, least % 127 + 1).astype(np.int8)
        keys, ptr = _keys(least)
        return pa.RecordBatch.from_arrays(
            [b.column("mark"), pa.FixedSizeListArray.from_arrays(pa.array(tags.ravel()), SKETCH).cast(pa.list_(pa.int8())),
             pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(keys)),
             *(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v, t)) for v, t in (
                 (hashes, pa.int64()), (runs, pa.int64()), (lengths, pa.int32()), (leaves, pa.int64()), (counts, pa.int32()), (letters, pa.bool_())))],
            ["mark", "sketch", "keys", "hashes", "runs", "sizes", "leaves", "counts", "letters"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1 << 23):
                yield make(part)
    return texts.select("mark", "text").mapInArrow(
        run, "mark long, sketch array<tinyint>, keys array<long>, hashes array<long>, runs array<long>, sizes array<int>, "
             "leaves array<long>, counts array<int>, letters array<boolean>")


def line_numbers(facts: DataFrame) -> DataFrame:
    """(mark, line_hash, leaf, n, letters): lines of each text that have a word."""
    each = facts.select("mark", F.explode(F.arrays_zip("hashes", "leaves", "counts", "letters")).alias("r"))
    return each.select("mark", F.col("r.hashes").alias("line_hash"), F.col("r.leaves").alias("leaf"), F.col("r.counts").alias("n"),
                       F.col("r.letters").alias("letters"))


def line_tokens(docs: DataFrame, where: DataFrame, lead: int) -> DataFrame:
    """(line_hash, first, free, tokens) of the lines of `where` (line_hash, mark), read from the texts with these marks.

    first counts the leading words without a digit, free the others; a token is the hash of leaf, place and word of one of these.
    """
    marks, lines = Sieve(where, "mark"), Sieve(where, "line_hash")

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        import xxhash
        own = np.asarray(b.column("mark"))
        out = [[] for _ in range(5)]
        for k in np.flatnonzero(marks.lets(own)).tolist():
            text = b.column("text")[k].as_py()
            held = list(dict.fromkeys(text.encode("utf-8", "surrogatepass").split(b"\n"))) if text else []
            hashes = np.fromiter((signed(xxhash.xxh64_intdigest(x, 42)) for x in held), np.int64, len(held))
            for i in np.flatnonzero(lines.lets(hashes)).tolist():
                words = held[i].split()
                leaf = leaf_of(held[i], len(words), lead)
                plain = [p for p, w in enumerate(words) if not DIGIT(w)]
                tokens = [signed(xxhash.xxh64_intdigest(b"%d %b" % (p, words[p]), leaf)) for p in plain if p >= lead]
                for column, value in zip(out, (own[k], hashes[i], len(plain) - len(tokens), len(tokens), tokens)):
                    column.append(value)
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], ["mark", "line_hash", "first", "free", "tokens"])
    found = by_batch(docs.select("mark", "text"), make, "mark long, line_hash long, first int, free int, tokens array<long>")
    return found.join(where, ["mark", "line_hash"], "left_semi").drop("mark").dropDuplicates(["line_hash"])


def classes(facts: DataFrame) -> DataFrame:
    """(mark, class) of the texts that have a near copy; any other text is a class of its own."""
    each = facts.select("mark", F.explode("keys").alias("key"))
    shared = each.groupBy("key").agg(F.min("mark").alias("first"), F.max("mark").alias("last")).where("first <> last")
    pairs = each.join(shared.select("key", "first"), "key").where("mark <> first").select("mark", "first").distinct()
    sketch = facts.select("mark", "sketch").dropDuplicates(["mark"])
    both = pairs.join(sketch, "mark").join(sketch.select(F.col("mark").alias("first"), F.col("sketch").alias("other")), "first")
    held = F.zip_with("sketch", "other", lambda a, b: F.when((a > 0) & (a == b), 2).when((a > 0) | (b > 0), 1).otherwise(0))
    count = lambda least: F.size(F.filter(held, lambda x: x >= least))
    links = stage(both.where(100 * count(2) >= SAME_PERCENT * count(1)).select(F.col("first").alias("source"), F.col("mark").alias("target")), "copies")
    nodes = links.select(F.explode(F.array("source", "target")).alias("mark")).distinct()
    return components(links, nodes, "mark").withColumnRenamed("community", "class")


def templates(held: DataFrame, numbers: DataFrame, docs: DataFrame, lead: int, min_words: int, min_docs: int, fixed_percent: int) -> DataFrame:
    """(line_hash, template, need, fields) from distinct (line, class) rows: templates with variables, and lines that recur as they stand."""
    lines = stage(held.groupBy("leaf", "line_hash", "n", "letters").agg(F.count(F.lit(1)).alias("docs")), "lines")
    told = lines.where((F.col("n") >= min_words) | F.col("letters"))
    # a line as it stands is held by its own classes alone
    exact = told.where(F.col("docs") >= needed(F.col("n"), 2)).select("line_hash", F.xxhash64(F.lit("line"), "line_hash").alias("template"), needed(F.col("n"), 2).alias("need"),
                        F.lit(False).alias("fields"))
    # a leaf with one line has no other template; a leaf is as large as its distinct lines
    long_ = lines.where(F.col("n") >= min_words)
    busy = long_.groupBy("leaf").agg(F.sum("docs").alias("total"), F.count(F.lit(1)).alias("kinds")).where((F.col("total") >= min_docs) & (F.col("kinds") > 1))
    asked = stage(long_.join(busy.select("leaf", "total"), "leaf").select("leaf", "total", "docs", "line_hash"), "leaf_lines")
    # the words of a line come from the text with the smallest mark that has it
    where = stage(numbers.join(asked.select("line_hash"), "line_hash", "left_semi").groupBy("line_hash").agg(F.min("mark").alias("mark")), "line_places")
    at = (asked.join(line_tokens(docs, where, lead), "line_hash")
          .select("leaf", "total", "docs", "line_hash", "first", "free", F.explode("tokens").alias("token")))
    at = stage(at, "leaf_words")
    sums = at.groupBy("token").agg(F.sum("docs").alias("c"), F.max("total").alias("total")).where(F.col("c") >= min_docs)
    fixed = sums.select("token", (100 * F.col("c") >= WIDE_PERCENT * F.col("total")).alias("wide"))
    both = at.join(fixed, "token").groupBy("leaf", "line_hash", "first", "free").agg(
        F.struct(F.count(F.lit(1)).alias("kept"), F.bit_xor("token").alias("shape")).alias("narrow"),
        F.struct(F.count_if("wide").alias("kept"), F.bit_xor(F.when(F.col("wide"), F.col("token"))).alias("shape")).alias("broad"))
    shaped = both.select("*", F.explode(F.array_distinct(F.array("narrow", "broad"))).alias("s"))
    # the leading words are fixed by the tree itself, so the share is taken over the others
    enough = (F.col("s.kept") > 0) & (100 * F.col("s.kept") >= fixed_percent * F.col("free"))
    shaped = shaped.where(enough).select("line_hash", F.xxhash64("leaf", "s.shape").alias("template"),
                                         needed(F.col("s.kept") + F.col("first"), min_docs).alias("need"), F.lit(True).alias("fields"))
    return exact.unionByName(shaped)


def passages(facts: DataFrame, known: DataFrame) -> DataFrame:
    """(mark, line_hash) of the lines in passages that texts of two classes have."""
    each = facts.select("mark", F.posexplode("runs").alias("i", "template")).where("template is not null")
    again = each.groupBy("template").agg(F.min("mark").alias("a"), F.max("mark").alias("b")).where("a <> b").select("template")
    own = stage(each.join(again, "template", "left_semi"), "runs")
    classed = own.join(known, "mark", "left").select("template", F.coalesce("class", "mark").alias("class"))
    bad = classed.groupBy("template").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b").select("template")
    found = own.join(bad, "template", "left_semi").select("mark", "i").distinct()
    lines = F.slice("hashes", F.col("i") + 1, F.col("sizes")[F.col("i")])
    held = found.join(facts.select("mark", "hashes", "sizes").dropDuplicates(["mark"]), "mark")
    return held.select("mark", F.explode(lines).alias("line_hash")).distinct()


def judged_lines(docs: DataFrame, lead: int = LEAD, min_words: int = MIN_WORDS, min_docs: int = MIN_DOCS, fixed_percent: int = FIXED_PERCENT
                 ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(recurring lines with their templates, (mark, line_hash) of all lines, (mark, line_hash) of passages) for with_mark rows."""
    facts = stage(text_facts(docs, lead), "facts")
    numbers = line_numbers(facts)
    lines = facts.select("mark", F.explode("hashes").alias("line_hash"))
    known = stage(classes(facts), "classes")
    held = numbers.join(known, "mark", "left").select("leaf", "line_hash", "n", "letters", F.coalesce("class", "mark").alias("class")).distinct()
    held = stage(held, "line_classes")
    shapes = stage(templates(held, lines, docs, lead, min_words, min_docs, fixed_percent), "templates")
    counted = shapes.join(held.select("line_hash", "class"), "line_hash").select("template", "need", "class").distinct()
    bad = counted.groupBy("template").agg(F.count(F.lit(1)).alias("c"), F.max("need").alias("need")).where("c >= need").select("template")
    return stage(shapes.join(bad, "template", "left_semi"), "recurring"), lines, passages(facts, known)


def dropped_lines(docs: DataFrame, **options) -> DataFrame:
    """(mark, line_hash) of the lines to drop, for documents from with_mark."""
    recurring, lines, runs = judged_lines(docs, **options)
    return lines.join(recurring.select("line_hash").distinct(), "line_hash", "left_semi").select("mark", "line_hash").unionByName(runs).distinct()


def without_templates(docs: DataFrame, **options) -> DataFrame:
    """Documents (doc_id, text) as (doc_id, text, n_lines, n_dropped, mark) with every line of a dropped template removed.

    Line numbers count \\n-split lines; a NULL text stays NULL with 0 lines. Rows without doc_id and repeated rows take
    part like others, equal texts once. A line is looked up in its text's own set, so a text of many lines costs their
    number. An empty table gives no rows; further columns are not read.
    """
    marked = with_mark(docs)
    return stripped(marked, dropped_lines(marked, **options), "doc_id")


def stripped(marked: DataFrame, dropped: DataFrame, own: str) -> DataFrame:
    """(own, text, n_lines, n_dropped, mark) of texts (own, text, mark) without the lines (mark, line_hash); texts move once."""
    drop = dropped.groupBy("mark").agg(F.collect_list("line_hash").alias("gone"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for b in batches:
            gone = b.column("gone")
            hit = np.flatnonzero(np.asarray(pc.is_valid(gone)))
            text, n_dropped = b.column("text"), np.zeros(b.num_rows, np.int64)
            count = pc.add(pc.count_substring(text, "\n"), 1).fill_null(0).cast(pa.int64())
            if len(hit):
                texts = []
                for k in hit.tolist():
                    bad = {h % 2 ** 64 for h in gone[k].as_py()}
                    lines = text[k].as_py().split("\n")
                    stay = [x for x in lines if xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 42) not in bad]
                    n_dropped[k] = len(lines) - len(stay)
                    texts.append("\n".join(stay))
                mask = np.zeros(b.num_rows, bool)
                mask[hit] = True
                text = pc.replace_with_mask(text, pa.array(mask), pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(own), text, count, pa.array(n_dropped), b.column("mark")],
                                             [own, "text", "n_lines", "n_dropped", "mark"])
    kind = marked.schema[own].dataType.simpleString()
    return marked.join(drop, "mark", "left").select(own, "text", "gone", "mark").mapInArrow(
        strip, f"{own} {kind}, text string, n_lines long, n_dropped long, mark long")


def cleaned(docs: DataFrame, **options) -> DataFrame:
    """Documents with the columns of the input, without the dropped lines; a document left without a word goes."""
    dropped = dropped_lines(with_mark(docs), **options)
    rows = docs.select(F.struct(F.lit(0).alias("_row"), *[c for c in docs.columns if c != "text"]).alias("doc_row"),
                       F.col("text").cast("string").alias("text"), _mark().alias("mark"))
    out = stripped(rows, dropped, "doc_row").where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[(F.col("text") if c == "text" else F.col("doc_row").getField(c)).alias(c) for c in docs.columns])


# The same rule; hash values of lines and tokens are the lines and tokens themselves.
SQL = rf"""
with recursive d as (select distinct coalesce(text, '') as text, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::bigint as mark from documents),
sw as (select mark, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACE_CLASS}+'), lambda x: x <> '') as w from d),
sh as (select mark, len(w) as n, list_transform(w, lambda x: ('0x' || substr(md5(x), 1, 8))::bigint % {PRIME}) as h from sw where len(w) > 0),
st as (select mark, h, least(n, {SHINGLE}) as size, unnest(range(1, n - least(n, {SHINGLE}) + 2)) as i from sh),
po as (select mark, list_reduce(h[i:i + size - 1], lambda a, x: (a * {FACTOR} + x) % {PRIME}, 0::bigint) as p from st),
mn as (select mark, p % {SKETCH} as bucket, min(p) as least_p from po group by 1, 2),
bd as (select mark, bucket // {BAND} as band, list(struct_pack(b := bucket, p := least_p) order by bucket) as v from mn group by 1, 2),
fs as (select band, v, min(mark) as first from bd group by 1, 2 having count(*) > 1),
pr as (select distinct b.mark, f.first from bd b join fs f using (band, v) where b.mark <> f.first),
eq as (select p.mark, p.first, count_if(a.least_p % 127 = b.least_p % 127) as same, count(*) as both_
  from pr p join mn a on a.mark = p.mark join mn b on b.mark = p.first and b.bucket = a.bucket group by 1, 2),
sz as (select mark, count(*) as k from mn group by 1),
ln as (select e.mark, e.first from eq e join sz a on a.mark = e.mark join sz b on b.mark = e.first where 100 * e.same >= {SAME_PERCENT} * (a.k + b.k - e.both_)),
walk(a, b) as (select mark, mark from (select mark from ln union select first from ln)
  union select w.a, case when e.mark = w.b then e.first else e.mark end from walk w join ln e on e.mark = w.b or e.first = w.b),
cl as (select a as mark, min(b) as class from walk group by 1),
dc as (select d.text, d.mark, coalesce(cl.class, d.mark) as class from d left join cl on cl.mark = d.mark),
al as (select mark, class, string_split(text, chr(10)) as lines from dc),
ap as (select mark, class, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as i from al),
aw as (select *, list_filter(regexp_split_to_array(line, '{SPACE_CLASS}+'), lambda x: x <> '') as words from ap),
ww as (select *, len(words) as n from aw where len(words) > 0),
h as (select distinct class, line, words, n, struct_pack(n := n, lead := list_transform(words[1:{LEAD}],
    lambda x: case when regexp_matches(x, '[0-9]') then '*' else x end)) as leaf from ww),
lines as (select leaf, line, words, n, count(*) as docs from h group by all),
busy as (select leaf, sum(docs) as total from lines where n >= {MIN_WORDS} group by 1 having sum(docs) >= {MIN_DOCS} and count(*) > 1),
u as (select l.leaf, b.total, l.line, l.docs, unnest(range(1, l.n + 1)) as pos, unnest(l.words) as word from lines l join busy b using (leaf) where l.n >= {MIN_WORDS}),
pl as (select * from u where not regexp_matches(word, '[0-9]')),
fr as (select leaf, line, count_if(pos <= {LEAD}) as first, count_if(pos > {LEAD}) as free from pl group by 1, 2),
fx as (select leaf, pos, word, 100 * sum(docs) >= {WIDE_PERCENT} * any_value(total) as wide from pl where pos > {LEAD} group by 1, 2, 3 having sum(docs) >= {MIN_DOCS}),
bo as (select p.leaf, p.line, count(*) as kept, list(struct_pack(pos := p.pos, word := p.word) order by p.pos) as shape,
    count_if(wide) as wide_kept, coalesce(list(struct_pack(pos := p.pos, word := p.word) order by p.pos) filter (wide), []) as wide_shape
  from pl p join fx using (leaf, pos, word) group by 1, 2),
te as (select line, cast(null as varchar) as own, leaf, shape, kept, first from bo join fr using (leaf, line) where 100 * kept >= {FIXED_PERCENT} * free
  union select line, null, leaf, wide_shape, wide_kept, first from bo join fr using (leaf, line) where wide_kept > 0 and 100 * wide_kept >= {FIXED_PERCENT} * free),
bt as (select leaf, shape from te join h using (leaf, line) group by 1, 2
  having count(distinct class) >= greatest(ceil({EVIDENCE} / max(kept + first)), {MIN_DOCS})),
gone_lines as (select line from te join bt using (leaf, shape)
  union select line from h where n >= {MIN_WORDS} or regexp_matches(line, '\p{{L}}') group by line, n having count(distinct class) >= greatest(ceil({EVIDENCE} / n), 2)),
nu as (select mark, class, line, n, row_number() over (partition by mark order by i) as k, sum(n) over (partition by mark order by i) as upto from ww),
ru as (select a.mark, a.class, a.k, min(b.k) as z from nu a join nu b on b.mark = a.mark and b.k >= a.k and b.upto - a.upto + a.n >= {PASSAGE} group by 1, 2, 3),
rl as (select r.mark, r.class, r.k, list(n.line order by n.k) as run from ru r join nu n on n.mark = r.mark and n.k between r.k and r.z where r.z > r.k group by 1, 2, 3),
br as (select run from rl group by 1 having count(distinct class) > 1),
gone as (select mark, list(distinct line) as gone from (
    select mark, line from ww where line in (select line from gone_lines) union select mark, unnest(run) from rl where run in (select run from br)) group by 1),
o as (select x.doc_id, x.text as original, string_split(coalesce(x.text, ''), chr(10)) as lines, g.gone
  from documents x left join gone g on g.mark = ('0x' || substr(md5(coalesce(x.text, '')), 1, 15))::bigint)
select doc_id, case when original is null then 0 else len(lines) end::BIGINT as n_lines,
  case when gone is null then 0 else len(list_filter(lines, lambda x: list_contains(gone, x))) end::BIGINT as n_dropped,
  md5(case when gone is null then original else array_to_string(list_filter(lines, lambda x: not list_contains(gone, x)), chr(10)) end) as text_md5
from o"""
