"""Quality rules: a threshold table compiled into one projection of built-in functions.

The counts of a text are taken once; each rule is a ratio of two of them with its bounds, and the table of rules
becomes one expression. Nothing is shuffled and no user function runs. Repeated 8-word windows are found by sorting
the window hashes of one text, and only for texts in which some window repeats.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greengrain.llm.common import SPACES, words_of

# The symbols that count, and the window of repeated words.
SYMBOLS = "#*$%&|<>"
WINDOW = 8

# Frequent function words of four languages.
STOP_WORDS = """a an and are as at be by for from in is it of on or that the this to was with
aber auf aus das dem den der des die ein eine für im in ist mit nicht sich sie und von zu zum
al como con de del el en es la las lo los no para por que se su un una y
au avec ce dans des du elle en est et il la le les ne pas pour qui sur un une""".split()
EDGES = ".,;:!?\"'()"


class Rule(NamedTuple):
    """Passes while low <= top / bottom <= high; a missing bound is open, and a bottom of 0 passes."""
    name: str
    top: str
    bottom: str
    low: float | None
    high: float | None


RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.2),
    Rule("stop_words", "n_stop_words", "n_words", 0.05, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.4),
    Rule("line_words", "n_words", "n_lines", 2.0, None),
)


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def counts(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The counts of each row of documents (doc_id, text), with the columns to carry along."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *carry)
    base = base.withColumn("words", words_of(F.col("text"))).withColumn(
        "lines", F.filter(F.split("text", "\n"), lambda x: F.length(_without(x, SPACES)) > 0))
    windows = F.when(F.size("words") > WINDOW, F.transform(
        F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW))))
    base = base.withColumn("windows", windows)
    base = base.withColumn("again", F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))))
    stops = sorted(set(STOP_WORDS))
    # a filter on the result must not be pushed below the counts, where it would repeat their expressions many times
    # over; a projection with a column that counts as not deterministic (the partition number, times 0) holds it back
    plain = F.transform("words", lambda w: F.lower(F.btrim(w, F.lit(EDGES))))
    return base.select(
        *carry, "doc_id", (F.size("words") + 0 * F.spark_partition_id()).cast("long").alias("n_words"),
        F.length(_without(F.col("text"), SPACES)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(plain, lambda w: w.isin(stops))).cast("long").alias("n_stop_words"),
        F.coalesce(covered("again"), F.lit(0)).cast("long").alias("n_repeat_words"))


def covered(name: str) -> Column:
    """Words inside windows that occur twice or more, from the sorted (hash, position) pairs."""
    size = F.size(name)
    hash_at = lambda i: F.get(name, i)["w"]
    repeated = F.filter(name, lambda x, i: (hash_at(i + 1) == x["w"]) | (hash_at(i - 1) == x["w"]))
    starts = F.sort_array(F.transform(repeated, lambda x: x["i"]))
    # each start covers a window, up to the next start
    steps = F.aggregate(starts, F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last")),
                        lambda a, i: F.struct((a["sum"] + F.least(F.lit(WINDOW), i - a["last"])).alias("sum"), i.alias("last")),
                        lambda a: a["sum"])
    return F.when(size > 0, steps)


def verdict(rules=RULES) -> Column:
    """One boolean expression for the whole table of rules."""
    ok = F.lit(True)
    for r in rules:
        ratio = F.col(r.top) / F.nullif(F.col(r.bottom), F.lit(0))
        if r.low is not None:
            ok = ok & F.coalesce(ratio >= r.low, F.lit(True))
        if r.high is not None:
            ok = ok & F.coalesce(ratio <= r.high, F.lit(True))
    return ok


def judged(docs: DataFrame, rules=RULES, min_words: int = 20, repeat_percent: int = 30,
           carry: tuple[str, ...] = ()) -> DataFrame:
    """Counts of each document with base_failed and kept.

    A NULL text counts as an empty one, fails the base rule and is not kept. Rows stay as they are, repeated ones and
    NULL doc_ids too; an empty table gives no rows, and further columns are not read.
    """
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return counts(docs, carry).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def passing(docs: DataFrame, **options) -> DataFrame:
    """The rows of documents that are kept, with the columns of the input; each row travels beside its counts."""
    packed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("doc_row"))
    rows = judged(packed, carry=("doc_row",), **options)
    return rows.where("kept").select("doc_row.*")


def sql(rules=RULES, min_words: int = 20, repeat_percent: int = 30) -> str:
    """The same verdicts in SQL."""
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    checks = [f"coalesce({r.top} / nullif({r.bottom}, 0) {op} {bound}, true)" for r in rules
              for op, bound in ((">=", r.low), ("<=", r.high)) if bound is not None]
    return rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
v as (select r, i, list_slice(words, i, i + 7) as k from (select r, words, unnest(range(1, len(words) - 6)) as i from w)),
g as (select r, i from (select r, i, count(*) over (partition by r, k) as c from v) where c > 1),
s as (select r, sum(least(8, i - coalesce(before, i - 8))) as n_repeat_words
  from (select r, i, lag(i) over (partition by r order by i) as before from g) group by r),
c as (select doc_id, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
  length(text) - length(translate(text, '{SYMBOLS}', '')) as n_symbols, len(lines) as n_lines,
  len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
  len(list_filter(words, lambda x: lower(trim(x, '{EDGES.replace("'", "''")}')) in ({stops}))) as n_stop_words
  from w left join s using (r)),
f as (select *, n_words < {min_words} or 100 * n_repeat_words > {repeat_percent} * n_words as base_failed from c)
select doc_id, n_words::BIGINT as n_words, word_chars::BIGINT as word_chars, n_symbols::BIGINT as n_symbols,
  n_dup_lines::BIGINT as n_dup_lines, n_repeat_words::BIGINT as n_repeat_words, base_failed,
  not base_failed and {' and '.join(checks)} as kept
from f"""
