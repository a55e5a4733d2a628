"""New scenes as a stream: late and repeated items, days, appends that hold each day once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.filters import new_dates


def unique_items(items: DataFrame, delay: str = "1 day", time: str = "datetime", key: str = "item_id") -> DataFrame:
    """Each item once, as far as repeats come within the delay; state older than the watermark is dropped."""
    return items.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def per_day(items: DataFrame, delay: str = "1 day", time: str = "datetime") -> DataFrame:
    """Items per tumbling day, each day given once when the watermark has passed it."""
    w = F.window(time, "1 day")
    return items.withWatermark(time, delay).groupBy(w).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), "n")


def sessions(items: DataFrame, gap: str = "30 minutes", delay: str = "1 day", time: str = "datetime", key: str = "orbit") -> DataFrame:
    """Passes: scenes of an orbit without a gap."""
    return items.withWatermark(time, delay).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def append_new_days(stream: DataFrame, path: str, checkpoint: str, time: str = "time") -> StreamingQuery:
    """Append to a Parquet table the rows of days that it does not hold; a repeated batch adds nothing twice."""

    def batch(df: DataFrame, n: int) -> None:
        spark: SparkSession = df.sparkSession
        try:
            old = spark.read.parquet(path)
            df = new_dates(df, old, time)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        df.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
