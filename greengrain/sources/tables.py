"""The given parquet tables in the shape of the retail daily tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from greengrain.functions.staging import stage
from greengrain.sources import mart


TASK_LINES = 250_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("date"),
        F.col("l_partkey").alias("sku"),
        (F.col("l_returnflag") == "R").alias("is_return"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("loss"))


def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("sku"),
        F.col("p_type").alias("category_name"),
        F.col("p_brand").alias("item_name"),
        F.col("p_name").alias("sku_name"),
        F.col("p_retailprice").alias("unit_cost"))


def sku_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart.attach_dimension(mart.daily_sku_sums(ledger(spark, sf_dir)), dimension(spark, sf_dir))


def sku_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (date, sku_code), for operators that pass over it once."""
    sums = sku_sums(spark, sf_dir).withColumn("sku_code", F.col("sku").cast("string"))
    return mart.measures(sums, ["date", "sku_code"], ["sku_name", "category_name", "item_name"])


def line_tasks(spark: SparkSession, sf_dir: str, rows: int = TASK_LINES) -> int:
    """Tasks that hold about `rows` ledger lines each; the file footers know the number of lines."""
    return max(1, -(-read(spark, sf_dir, "lineitem").count() // rows))


def sku_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sku_code, category_name, qty, revenue): gross totals of all days, once for each row of the SKU in the dimension."""
    names = dimension(spark, sf_dir).select("sku", "category_name")
    named = mart.sku_totals(ledger(spark, sf_dir)).join(names, "sku", "left").na.fill({"category_name": "unknown"})
    return mart.totals_per_sku(named).withColumn("sku_code", F.col("sku").cast("string")).select("sku_code", "category_name", "qty", "revenue")


def sku_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table written once, for operators that read it more than once."""
    return stage(sku_day(spark, sf_dir), "sku_day")


# The rolled-up tables below feed calendars, bounds and joins, each of which would scan the
# ledger again; they are small (days x entities), so they are written once per query.

def category_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (date, category_name)."""
    return stage(mart.roll_up(sku_sums(spark, sf_dir), ["category_name"]), "category_day")


def item_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (date, item_name)."""
    return stage(mart.roll_up(sku_sums(spark, sf_dir), ["item_name"]), "item_day")


def product_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact sums per (date, category_name, sku_code) where a product is an item inside a category."""
    keyed = sku_sums(spark, sf_dir).withColumn("sku_code", F.concat_ws("/", "category_name", "item_name"))
    return mart.rolled_sums(keyed, ["category_name", "sku_code"])


def _products(sums: DataFrame) -> DataFrame:
    return mart.daily_measures(sums, ["category_name", "sku_code"]).withColumn("sku_name", F.col("sku_code"))


def product_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (date, sku_code) where a product is an item inside a category.

    Dense enough for the assortment operators, which need weeks of history per SKU.
    """
    return stage(_products(product_sums(spark, sf_dir)), "product_day")


def category_and_product_day(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """`category_day` and `product_day` from one pass over the ledger, for chains that need both."""
    sums = stage(product_sums(spark, sf_dir), "product_sums")
    return (stage(mart.daily_measures(mart.add_up(sums, ["category_name"]), ["category_name"]), "category_day"),
            stage(_products(sums), "product_day"))
