"""Cube tables as views of the supplied tables, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.composites import solar_day_mosaic

BANDS = ["blue", "green", "red", "nir", "swir16", "swir22", "rededge1"]
SIZE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations (several granules of a day may hold one pixel), class layer, bit word, and a total order."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_shipdate").alias("time"), (c("l_suppkey") % SIZE).cast("int").alias("row"), (c("l_partkey") % SIZE).cast("int").alias("col"),
        c("l_tax").alias("blue"), c("l_discount").alias("green"), (c("l_quantity") / 100).alias("red"), (c("l_extendedprice") / 100000).alias("nir"),
        (c("l_extendedprice") / 200000 + c("l_tax")).alias("swir16"), (c("l_quantity") / 80).alias("swir22"), (c("l_discount") + c("l_tax")).alias("rededge1"),
        ((c("l_partkey") + c("l_suppkey")) % 12).cast("int").alias("scl"), (c("l_orderkey") % 16).cast("int").alias("qa"),
        (c("l_orderkey") * 1_000_000 + c("l_linenumber") * 100_000 + c("l_partkey") % 100_000).alias("ord"),
    )


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pixel per day, row and column: the first value of each band that is not missing."""
    return solar_day_mosaic(pixels(spark, sf_dir), [*BANDS, "scl"], F.col("ord"), ("time", "row", "col"))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "orders").select(
        c("o_orderkey").alias("item_id"), c("o_orderdate").alias("datetime"), c("o_orderpriority").alias("tile"), (F.lit(2.0) + c("o_custkey") % 4).alias("baseline"),
        (c("o_custkey") % 101).cast("int").alias("cloud_cover"), c("o_orderstatus").alias("source"), (c("o_custkey") % 361 - 180).cast("double").alias("lon"), (c("o_custkey") % 360).cast("double").alias("sun_azimuth"),
    )


PX = """px AS (SELECT l_shipdate AS time, CAST(l_suppkey % 8 AS INT) AS "row", CAST(l_partkey % 8 AS INT) AS col,
    l_tax AS blue, l_discount AS green, l_quantity / 100 AS red, l_extendedprice / 100000 AS nir,
    l_extendedprice / 200000 + l_tax AS swir16, l_quantity / 80 AS swir22, l_discount + l_tax AS rededge1,
    CAST((l_partkey + l_suppkey) % 12 AS INT) AS scl, CAST(l_orderkey % 16 AS INT) AS qa,
    l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey % 100000 AS ord FROM lineitem)"""
CUBE = PX + """, cube AS (SELECT time, "row", col, """ + ", ".join(f"arg_min({b}, ord) AS {b}" for b in [*BANDS, "scl"]) + ' FROM px GROUP BY time, "row", col)'
SCENES = """sc AS (SELECT o_orderkey AS item_id, o_orderdate AS datetime, o_orderpriority AS tile, 2.0 + o_custkey % 4 AS baseline,
    CAST(o_custkey % 101 AS INT) AS cloud_cover, o_orderstatus AS source, CAST(o_custkey % 361 - 180 AS DOUBLE) AS lon,
    CAST(o_custkey % 360 AS DOUBLE) AS sun_azimuth FROM orders)"""
