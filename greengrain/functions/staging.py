"""Lineage cuts: a written table in the shared checkpoint folder of the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN_FOLDER: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a new one on a single machine where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return _OWN_FOLDER[0]


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df once, with options of the Parquet writer, and read it back.

    Later steps that use it several times do not run its plan again, a lost executor
    costs no recomputation, and the file sizes let Spark check what it may broadcast.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
