"""URL filters: host and path rules, and a logistic regression on hashed character n-grams for the rest.

Everything is a column expression. The labelled table is small and fixed, so its training runs inside one expression
over one row (stochastic gradient steps in a fixed order) and reaches the urls as one scalar array. The urls are never
shuffled, so a host with a third of all pages is no special case.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, GRAM, EPOCHS, RATE, BIAS = 1024, 3, 40, 0.5, -1.0

# The rules as verdict, host and path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

# The labelled urls; 1 is a url to block.
LABELLED = (
    ("https://casino-win.example.org/en/11.html", 1), ("http://www.casino-royal.example.com/play", 1),
    ("https://free-bets.example.com/en/20", 1), ("http://m.sports-bets.example.org/odds", 1),
    ("https://cheap-pills.example.com/fr/31", 1), ("http://www.pills-online.example.org/shop", 1),
    ("https://ads-track.example.com/en/42", 1), ("http://m.track-click.example.org/pixel", 1),
    ("https://win-cash.example.com/en/53", 1), ("http://poker-free.example.com/es/64.html", 1),
    ("https://ads-serve.example.org/banner", 1), ("http://blog.cheap-loans.example.com/en/75", 1),
    ("https://library.example.org/en/12.html", 0), ("http://www.thering.example.com/en/21", 0),
    ("https://garden.example.com/fr/33/", 0), ("http://m.weather.example.org/es/44", 0),
    ("https://nation.example.com/en/55?page=2", 0), ("http://blog.kitchen.example.com/es/66.html", 0),
    ("https://www.history.example.org/en/77/", 0), ("http://museum.example.com/fr/88", 0),
    ("https://m.reading.example.com/en/99.html", 0), ("http://therapist.example.org/en/10", 0),
    ("https://www.station.example.com/es/23/", 0), ("http://blog.another.example.org/en/34", 0),
    ("https://ontario.example.com/en/45", 0), ("http://www.thirteen.example.com/en/56.html", 0),
    ("https://m.others.example.org/es/67", 0), ("http://estate.example.com/en/78/", 0),
    ("https://blog.union.example.com/fr/89", 0), ("http://www.heritage.example.org/en/90.html", 0),
    ("https://m.shelter.example.com/en/13", 0), ("http://northern.example.com/es/24", 0),
)


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z in lower case; empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host to the next ? or #; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(rules=RULES) -> Column:
    """A struct (rule, verdict) of the longest rule that fits host and path, or NULL, as one expression."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        name = host + path
        at_host = (F.col("host") == host) | F.endswith("host", F.lit("." + host))
        fits = F.when(at_host & F.startswith("path", F.lit(path)),
                      F.struct(F.lit(name).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def buckets(host: Column, path: Column) -> Column:
    """Distinct buckets of the character n-grams of host and path, digits taken as one; sorted."""
    text = F.translate(F.concat(F.lit("^"), host, path, F.lit("$")), "123456789", "000000000")
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    count = F.greatest(F.size(codes) - (GRAM - 1), F.lit(0))
    # shifted copies side by side, so a long url costs no more than its length
    first, second, third = (F.slice(codes, F.lit(i), count) for i in (1, 2, 3))
    pairs = F.zip_with(first, second, lambda x, y: x * 961 + y * 31)
    grams = F.zip_with(pairs, third, lambda x, y: F.pmod(x + y, F.lit(BUCKETS)))
    return F.array_sort(F.array_distinct(grams))


def _logit(weights: Column, features: Column) -> Column:
    """The bias is the last weight."""
    return F.aggregate(features, F.element_at(weights, -1), lambda a, b: a + F.element_at(weights, (b + 1).cast("int")))


def trained(spark: SparkSession, labelled=LABELLED, epochs: int = EPOCHS, rate: float = RATE) -> DataFrame:
    """One row with the weights; the labelled table is a parameter and stays small (it is one row of the plan)."""
    rows = F.array(*[F.struct(F.lit(u).alias("url"), F.lit(float(y)).alias("y")) for u, y in labelled])
    table = spark.range(1).select(F.transform(rows, lambda r: F.struct(
        buckets(host_of(r["url"]), path_of(r["url"])).alias("x"), r["y"].alias("y"))).alias("t"))
    start = F.concat(F.array_repeat(F.lit(0.0), BUCKETS), F.array(F.lit(BIAS)))
    steps = F.sequence(F.lit(0), F.lit(epochs * len(labelled) - 1))

    def step(w: Column, i: Column) -> Column:
        row = F.element_at("t", i % len(labelled) + 1)
        push = rate / F.size(row["x"]) * (row["y"] - 1.0 / (1.0 + F.exp(-_logit(w, row["x"]))))
        return F.transform(w, lambda v, j: F.when(F.array_contains(row["x"], j.cast("long")), v + push).otherwise(v))
    return table.select(F.aggregate(steps, start, step).alias("weights"))


def judged(pages: DataFrame, rules=RULES, labelled=LABELLED) -> DataFrame:
    """(page_id, host, path, rule, score, verdict) of pages (page_id, url).

    The longest fitting rule decides; without one a score of 0.5 or more blocks. A NULL url or one without :// has an
    empty host and path, fits no rule and is scored like any other. Rows stay as they are, repeated ones too; an
    empty table gives no rows, and further columns are not read.
    """
    weights = trained(pages.sparkSession, labelled).scalar()
    url = F.col("url").cast("string")
    out = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    out = out.withColumn("fit", rule_table(rules)).withColumn("x", buckets(F.col("host"), F.col("path"))).withColumn("w", weights)
    out = out.withColumn("score", 1.0 / (1.0 + F.exp(-_logit(F.col("w"), F.col("x")))))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), "score",
                      F.coalesce(F.col("fit.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"))


def _plain_buckets(url: str) -> list[int]:
    import re
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
    host, path = (m[1], m[2]) if m else ("", "")
    text = "".join("0" if "1" <= c <= "9" else c for c in "^" + "".join(c.lower() if "A" <= c <= "Z" else c for c in host) + path + "$")
    code = [ord(c) for c in text]
    return sorted({(a * 961 + b * 31 + c) % BUCKETS for a, b, c in zip(code, code[1:], code[2:])})


def plain_weights(labelled=LABELLED, epochs: int = EPOCHS, rate: float = RATE) -> list[float]:
    """The same training in plain Python, for the SQL text and the tests."""
    table = [(_plain_buckets(u), float(y)) for u, y in labelled]
    w = [0.0] * BUCKETS + [BIAS]
    for i in range(epochs * len(table)):
        x, y = table[i % len(table)]
        z = w[-1]
        for b in x:
            z += w[b]
        push = rate / len(x) * (y - 1.0 / (1.0 + math.exp(-z)))
        for b in x:
            w[b] += push
    return w


def sql() -> str:
    weights = ", ".join(repr(w) for w in plain_weights())
    return f"""
with u as (select page_id, coalesce(url, '') as url from pages),
p as (select page_id, translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') as path from u),
r as (select *, case
    when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule,
  translate('^' || host || path || '$', '123456789', '000000000') as t from p),
x as (select *, list_distinct(list_transform(range(1, length(t) - 1), lambda i:
    (unicode(substr(t, i, 1)) * 961 + unicode(substr(t, i + 1, 1)) * 31 + unicode(substr(t, i + 2, 1))) % {BUCKETS})) as g from r),
s as (select *, {weights.rsplit(', ', 1)[1]} + coalesce(list_sum(list_transform(g, lambda b: ([{weights}])[b + 1])), 0) as z from x)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
  when z >= 0 then 'block' else 'allow' end as verdict
from s"""
