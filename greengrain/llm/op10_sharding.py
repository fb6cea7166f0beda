"""Weighted rendezvous hashing of stable record keys into shards.

Every shard draws a number for a key; the draw divided by the weight decides, so a new shard takes rows only into
itself and a changed weight moves no more than its share. Places inside a shard follow a hash of the row: rows are cut
into equal hash ranges, ranges are counted, and only a range is ever sorted. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from greengrain.functions.staging import stage

RANGE_ROWS = 20_000
DIGITS = 13


def hash_number(text: Column) -> Column:
    """The first 52 bits of the md5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (0-based) with the smallest -ln(u) / weight; ties, which need equal draws, to the smaller shard."""
    draws = [F.struct((-F.log((hash_number(F.concat_ws(":", key, F.lit(str(s)))) + 0.5) / float(16 ** DIGITS)) / F.lit(float(w)))
                      .alias("cost"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]
    return F.array_min(F.array(*draws))["shard"]


def shards(docs: DataFrame, weights: list[float], grown_weight: float = 1.0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard) of documents (doc_id, text).

    size is the text's UTF-8 length plus 8; a NULL text counts as empty. A NULL doc_id has the empty key. slot numbers
    the rows of a shard from 0 without gaps, by a hash of (doc_id, checksum, size), so equal rows take adjoining
    slots. grown_shard is the shard with one more of `grown_weight`. No rows give no rows; further columns are not read.
    """
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), rendezvous(key, weights).alias("shard"),
        rendezvous(key, [*weights, grown_weight]).alias("grown_shard"), key.alias("key"))
    rows = stage(rows.withColumn("place", hash_number(F.concat_ws(":", "key", "text_crc32", "size"))).drop("key"), "sharded")
    ranges = F.greatest(F.lit(1), F.ceil(rows.agg(F.count(F.lit(1))).scalar() / float(range_rows * len(weights))))
    cut = rows.withColumn("range", F.floor(F.col("place") / float(16 ** DIGITS) * ranges))
    counts = cut.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("c"))
    # one row per range of a shard
    before = counts.select("shard", "range", (F.sum("c").over(Window.partitionBy("shard").orderBy("range")) - F.col("c")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "range").orderBy("place", "doc_id", "text_crc32", "size")) - 1
    return (cut.withColumn("in", inside).join(before, ["shard", "range"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("in")).cast("long").alias("slot"), "grown_shard"))


_SQL_COST = ("-ln((('0x' || substr(md5(concat_ws(':', coalesce(cast(doc_id as varchar), ''), s)), 1, 13))::BIGINT + 0.5)"
             " / 4503599627370496.0)")

SQL = f"""
with crc_table as (
  select list(c order by i) as t from (select i, list_reduce(list_prepend(i, range(8)),
    lambda a, k: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as c
    from (select unnest(range(256)) as i))),
d as (select doc_id, coalesce(text, '') as text from documents),
b as (select doc_id, text, strlen(text) + 8 as size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295::BIGINT) as text_crc32
  from d, crc_table),
p as (select doc_id, size, text_crc32,
    list_sort(list_transform(range(24), lambda s: [{_SQL_COST}, s]))[1][2]::INT as shard,
    list_sort(list_transform(range(25), lambda s: [{_SQL_COST}, s]))[1][2]::INT as grown_shard,
    ('0x' || substr(md5(concat_ws(':', coalesce(cast(doc_id as varchar), ''), text_crc32, size)), 1, 13))::BIGINT as place
  from b)
select doc_id, size::BIGINT as size, text_crc32::BIGINT as text_crc32, 'key' as law, shard,
  row_number() over (partition by shard order by place, doc_id, text_crc32, size) - 1 as slot, grown_shard
from p"""
