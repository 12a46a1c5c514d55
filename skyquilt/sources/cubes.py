"""Cubes from Parquet, and the fixture cubes made of the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt.operators.core import CubeSpec, canonical, dense


def read_cube(spark: SparkSession, path: str, spec: CubeSpec = CubeSpec()) -> DataFrame:
    """A cube of a Parquet table; filters on coordinates reach the scan."""
    return canonical(spark.read.parquet(path), spec)


def write_cube(cube: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = cube.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    lat, lon = F.lit(-20.0) + 10 * F.col("n_regionkey"), F.lit(150.0) + 15 * F.floor(F.col("n_nationkey") / 5)
    return nation.select("n_nationkey", lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))


def _mean(value: str):
    """Decimals add up the same in any order."""
    return (F.sum(F.col(value).cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("value")


def _located_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    grid = F.broadcast(_grid(spark, sf_dir))  # 25 nations
    return orders.join(customer, orders.o_custkey == customer.c_custkey).join(grid, customer.c_nationkey == grid.n_nationkey)


def model_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X: mean order price by cell, quarter and priority (5 members), dense."""
    located = _located_orders(spark, sf_dir)
    sample = F.to_date(F.date_trunc("quarter", "o_orderdate"))
    return dense(located.groupBy("lat", "lon", sample.alias("sample"), F.col("o_orderpriority").alias("feature")).agg(_mean("o_totalprice")))


def observed_cube(spark: SparkSession, sf_dir: str, period: str = "quarter") -> DataFrame:
    """Yq or Ym: mean line price by cell and quarter or month, feature 'obs', dense."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_extendedprice")
    located = _located_orders(spark, sf_dir).select("o_orderkey", "o_orderdate", "lat", "lon")
    joined = lines.join(located, lines.l_orderkey == located.o_orderkey)
    sample = F.to_date(F.date_trunc(period, "o_orderdate"))
    return dense(joined.groupBy("lat", "lon", sample.alias("sample"), F.lit("obs").alias("feature")).agg(_mean("l_extendedprice")))
