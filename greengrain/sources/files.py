"""CSV, JSON and parquet files with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header and declared types, so that long codes keep all their digits."""
    return (spark.read.schema(schema).option("header", True).option("encoding", "UTF-8")
            .option("dateFormat", "yyyy-MM-dd").option("mode", "FAILFAST").csv(path))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("dateFormat", "yyyy-MM-dd").mode("overwrite").csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    df.write.partitionBy(*partition_by).mode("overwrite").parquet(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str, multi_line: bool = True) -> DataFrame:
    """JSON summaries; a missing path fails at once, an ill-formed file when it is read."""
    return spark.read.schema(schema).option("multiLine", multi_line).option("mode", "FAILFAST").json(path)
