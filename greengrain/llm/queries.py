"""Registered queries of the numbered operators, each over its whole table, with SQL texts where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from greengrain.llm import (op01_minhash, op02_quality_rules, op03_chat, op04_byte_bpe, op05_templates, op06_compression,
                            op07_mtree, op08_mixing, op09_urls, op11_alignment, op12_packing, op13_negatives)
from greengrain.llm import op10_sharding as op10_sharding_
from greengrain.sources.tables import read

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op01_minhash.near_duplicates(read(spark, sf_dir, "documents"), width=4, percent=80)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_quality_rules.judged(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_byte_bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY),
                                    public_tokenizers.PATTERN)


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op05_templates.without_templates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = op08_mixing.copies(read(spark, sf_dir, "documents"), weights=[1, 2, 3], limit=3)
    one = plan.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return one.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_chat.rendered(read(spark, sf_dir, "conversations")).select(
        "conv_id", "n_turns", "state", F.md5("chat").alias("chat_md5"))


def op6_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_compression.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_mtree.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_urls.judged(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op10_sharding_.shards(read(spark, sf_dir, "documents"), weights=[1.0] * 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op11_alignment_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_alignment.aligned(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(PIECES))


def op12_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_packing.packed(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_LEVEL), room=2048)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return op13_negatives.hard_negatives(read(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0, scale=256,
                                         positives=5, negatives=5, window=(80, 100))


QUERIES = {f.__name__: f for f in (op1_minhash, op2_quality_rules, op3_chat, op4_byte_bpe, op5_line_templates, op6_compression,
                                   op7_mtree, op8_mixing, op9_urls, op10_sharding, op11_alignment_links,
                                   op12_sum_of_squares, op13_hard_negatives)}
SQL: dict[str, str] = {"op2_quality_rules": op02_quality_rules.sql(), "op5_line_templates": op05_templates.SQL, "op3_chat": op03_chat.SQL,
                       "op9_urls": op09_urls.sql(), "op10_sharding": op10_sharding_.SQL,
                       "op13_hard_negatives": op13_negatives.SQL}
