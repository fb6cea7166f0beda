"""Documents to an encoded training mix: each stage reads what the one before kept."""

from __future__ import annotations

import os
import sys

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from greengrain.functions.staging import stage  # noqa: E402
from greengrain.llm import op01_minhash, op02_quality_rules, op04_byte_bpe, op05_templates, op08_mixing  # noqa: E402
from greengrain.llm.queries import VOCABULARY  # noqa: E402


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and the ratio rules."""
    return op02_quality_rules.passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates; a document left without a word goes."""
    return op05_templates.cleaned(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group (five-word shingles, similarity 0.8)."""
    return op01_minhash.without_duplicates(docs, width=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their copies in the mix."""
    return op08_mixing.mixed(docs, weights=[1, 2, 3], limit=3)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with digests of the ids and of the text they decode to, one row per document of the mix."""
    return op04_byte_bpe.encoded_rows(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("source_mix", source_mix), ("byte_bpe", byte_bpe)]

# Near-duplicate groups, drawn roundings and merge ranks have no SQL text; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
