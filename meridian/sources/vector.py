"""Areas of interest and points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(feature_id, properties, rings) per polygon of a FeatureCollection; parts of a multipolygon are rings together."""
    raw = spark.read.option("multiLine", True).schema("features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>").json(path)
    f = raw.select(F.posexplode("features").alias("feature_id", "f"))
    polygon = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    multi = F.flatten(F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>"))
    rings = F.when(F.col("f.geometry.type") == "Polygon", polygon).when(F.col("f.geometry.type") == "MultiPolygon", multi)
    return f.select("feature_id", F.col("f.properties").alias("properties"), F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))).alias("rings")).filter("rings is not null")


def bbox(aoi: DataFrame) -> tuple[float, float, float, float]:
    p = aoi.select(F.explode(F.flatten("rings")).alias("p"))
    return tuple(p.agg(F.min("p.x"), F.min("p.y"), F.max("p.x"), F.max("p.y")).first())


def bbox_rings(spark: SparkSession, box: Sequence[float]) -> DataFrame:
    """A box in degrees as one feature."""
    left, bottom, right, top = map(float, box)
    if not (left < right and bottom < top):
        raise ValueError("a box is left, bottom, right, top")
    ring = [(left, bottom), (right, bottom), (right, top), (left, top), (left, bottom)]
    return spark.createDataFrame([(0, [ring])], "feature_id int, rings array<array<struct<x:double,y:double>>>")


def points(spark: SparkSession, lat: Sequence[float], lon: Sequence[float], names: Sequence[str] | None = None) -> DataFrame:
    if len(lat) != len(lon) or (names and len(names) != len(lat)):
        raise ValueError("one latitude, longitude and name for each point")
    if any(not (-90 <= a <= 90 and -180 <= b <= 180) for a, b in zip(lat, lon, strict=True)):
        raise ValueError("latitudes and longitudes are in degrees")
    rows = [(names[k] if names else f"point{k + 1:02d}", float(a), float(b)) for k, (a, b) in enumerate(zip(lat, lon, strict=True))]
    return spark.createDataFrame(rows, "point string, lat double, lon double")


def feature_names(base: str, n: int) -> list[str]:
    """One output per feature, numbered with two digits or as many as needed."""
    stem, dot, end = base.rpartition(".")
    width = max(2, len(str(n)))
    return [f"{stem or base}_{k:0{width}d}{dot + end if stem else ''}" for k in range(1, n + 1)]
