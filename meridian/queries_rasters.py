"""Registered queries over images and chunk stores that are written from the tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views as V
from .functions.expr import rounded
from .operators.grid import Grid
from .plans.cube import Cube
from .queries import query, r6
from .sources import chunks, geotiff
from .sources.scratch import scratch

FRAME = Grid("EPSG:32632", 10, -10, 500_000, 5_000_000, 80, 48)
BANDS = ["green", "red", "nir"]
YEARLY = """yr AS (SELECT date_trunc('year', l_shipdate)::TIMESTAMP AS time, CAST(l_suppkey % 48 AS INT) AS "row", CAST(l_partkey % 80 AS INT) AS col,
    max(l_discount) AS green, min(l_quantity) / 100 AS red, max(l_extendedprice) / 100000 AS nir FROM lineitem GROUP BY 1, 2, 3)"""
_PACKED = "round(floor({} / 1e-4 + 0.5) * 1e-4 + 1e-9, 4)"


def yearly(spark: SparkSession, sf: str) -> DataFrame:
    """An image of 80 by 48 pixels for each year."""
    c = F.col
    keys = (F.date_trunc("year", "l_shipdate").cast("timestamp_ntz").alias("time"), (c("l_suppkey") % 48).cast("int").alias("row"), (c("l_partkey") % 80).cast("int").alias("col"))
    best = (F.max("l_discount").alias("green"), (F.min("l_quantity") / 100).alias("red"), (F.max("l_extendedprice") / 100000).alias("nir"))
    return V.table(spark, sf, "lineitem").groupBy(*keys).agg(*best)


def _images(spark: SparkSession, sf: str, **how) -> str:
    path = scratch(spark, "images")
    geotiff.export_geotiffs(yearly(spark, sf), path, FRAME, BANDS, tile=16, **how)
    return path


@query(f'WITH {YEARLY} SELECT time, "row", col, green, red, nir FROM yr')
def geotiff_round_trip(spark, sf):
    cube = Cube.of_images(spark, _images(spark, sf, dtype="float64"))
    assert cube.grid == FRAME and cube.bands == ("green", "red", "nir")
    return cube.pixels


@query(f"""WITH {YEARLY} SELECT time, CAST("row" // 4 AS INT) AS "row", CAST(col // 4 AS INT) AS col, {r6("avg(nir)")} AS nir, {r6("avg(green)")} AS green FROM yr WHERE time >= TIMESTAMP '1997-01-01' GROUP BY 1, 2, 3""")
def geotiff_overview(spark, sf):
    """The second overview of the images of some years: means of four by four pixels."""
    df = geotiff.read_geotiff(spark, _images(spark, sf, dtype="float64"), level=2, bands="nir,green").filter("time >= timestamp_ntz'1997-01-01'")
    return df.select("time", "row", "col", rounded(F.col("nir")).alias("nir"), rounded(F.col("green")).alias("green"))


@query(f"""WITH {YEARLY} SELECT time, "row", col, {_PACKED.format("nir")} AS nir FROM yr WHERE "row" >= 2 AND "row" < 30 AND col >= 20 AND col <= 60""")
def geotiff_packed_window(spark, sf):
    """A window of one band of packed images."""
    df = geotiff.read_geotiff(spark, _images(spark, sf, dtype="int16", scale=1e-4, nodata=-32768.0), bands="nir").filter("row >= 2 and row < 30 and col >= 20 and col <= 60")
    return df.select("time", "row", "col", rounded(F.col("nir"), 4).alias("nir"))


@query(f'WITH {YEARLY} SELECT time, "row", col, green, red, nir FROM yr')
def zarr_round_trip(spark, sf):
    path = scratch(spark, "chunks")
    chunks.write_zarr(yearly(spark, sf), path, FRAME, BANDS, "float64", chunk=32)
    assert chunks.zarr_grid(spark, path) == FRAME
    return chunks.read_zarr(spark, path)


@query(f"""WITH {YEARLY} SELECT time, "row", col, {_PACKED.format("red")} AS red FROM yr WHERE time >= TIMESTAMP '1996-01-01' AND time < TIMESTAMP '1999-01-01' AND "row" >= 4 AND "row" < 40 AND col < 33""")
def zarr_packed_window(spark, sf):
    """A window of one band and some years of a packed store."""
    path = scratch(spark, "chunks")
    chunks.write_zarr(yearly(spark, sf), path, FRAME, BANDS, "int16", scale=1e-4, chunk=16)
    df = chunks.read_zarr(spark, path, ["red"], "1996-01-01", "1999-01-01", (4, 40, 0, 33))
    return df.select("time", "row", "col", rounded(F.col("red"), 4).alias("red"))
