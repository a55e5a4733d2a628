"""Tables that are written once and read back, to cut lineage: a lost executor costs a read, not the steps before."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only by a local session that names no shared folder, as in tests; a cluster must name one.
LOCAL = "file:///tmp/checkpoints"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL
    return f"{base.rstrip('/')}/cubes/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
