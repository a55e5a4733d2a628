"""Scene catalogues: STAC items from JSON files, as a data source with filter pushdown and as a plain reader."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

ITEMS = "item_id string, source string, collection string, datetime timestamp_ntz, geometry array<array<struct<x:double,y:double>>>, properties map<string,string>, assets map<string,struct<href:string,proj_code:string>>, cloud_cover double"
_RAW = "id string, collection string, geometry struct<type:string,coordinates:array<array<array<double>>>>, properties map<string,string>, assets map<string,struct<href:string,`proj:code`:string>>"


def read_items(spark: SparkSession, path: str, source: str = "local") -> DataFrame:
    """Items of newline-separated JSON files: schema ITEMS. Without a datetime the start of the interval counts."""
    raw = spark.read.schema(_RAW).json(path)
    ring = F.transform("geometry.coordinates", lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    when = F.coalesce(F.col("properties")["datetime"], F.col("properties")["start_datetime"])
    assets = F.transform_values("assets", lambda k, v: F.struct(v["href"].alias("href"), v["proj:code"].alias("proj_code")))
    return raw.select(
        F.col("id").alias("item_id"), F.lit(source).alias("source"), "collection", F.to_timestamp_ntz(F.regexp_replace(when, "Z$", "")).alias("datetime"),
        ring.alias("geometry"), "properties", assets.alias("assets"), F.try_element_at("properties", F.lit("eo:cloud_cover")).try_cast("double").alias("cloud_cover"),
    )


def footprints(items: DataFrame) -> DataFrame:
    """Typed rows of the items that have an outline."""
    from ..operators.scenes import typed

    return typed(items).filter(F.col("geometry").isNotNull())


class StacSource(DataSource):
    """``spark.read.format("stac")``: items of ``path`` (JSON lines), with predicates on item_id, collection and
    cloud_cover answered while reading."""

    @classmethod
    def name(cls) -> str:
        return "stac"

    def schema(self) -> str:
        return "item_id string, collection string, datetime string, cloud_cover double, properties string"

    def reader(self, schema) -> DataSourceReader:
        return _StacReader(self.options["path"], int(self.options.get("partitions", "1")))


class _StacReader(DataSourceReader):
    _OPS = {EqualTo: lambda a, b: a == b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}

    def __init__(self, path: str, partitions: int):
        self.path, self.n, self.tests = path, partitions, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = getattr(f, "attribute", ())
            if type(f) in self._OPS and name in (("item_id",), ("collection",), ("cloud_cover",)):
                self.tests.append((name[0], type(f).__name__, f.value))
            else:
                yield f

    def partitions(self):
        return [InputPartition(k) for k in range(self.n)]

    def read(self, partition) -> Iterator[tuple]:
        ops = {k.__name__: v for k, v in self._OPS.items()}
        with open(self.path, encoding="utf-8") as f:
            for n, line in enumerate(f):
                if n % self.n != partition.value or not line.strip():
                    continue
                item = json.loads(line)
                p = item.get("properties", {})
                row = {"item_id": item.get("id"), "collection": item.get("collection"), "datetime": p.get("datetime"), "cloud_cover": p.get("eo:cloud_cover"), "properties": json.dumps(p)}
                if all(row[c] is not None and ops[op](row[c], v) for c, op, v in self.tests):
                    yield tuple(row.values())
