"""Alignment of cubes and layers by label, as joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_aoi(pixels: DataFrame, aoi: DataFrame) -> DataFrame:
    """Inner join with a layer (row, col, ...); whether it is broadcast is left to its size."""
    return pixels.join(aoi, ["row", "col"])


def snap_to_grid(layer: DataFrame, grid, x: str = "x", y: str = "y", what: str = "layer") -> DataFrame:
    """(row, col) of the nearest pixel centre; a point farther than half a pixel is an error."""
    col = F.rint((F.col(x) - grid.c) / grid.a - 0.5)
    row = F.rint((F.col(y) - grid.f) / grid.e - 0.5)
    far = (F.abs(grid.x(col) - F.col(x)) > abs(grid.a) / 2) | (F.abs(grid.y(row) - F.col(y)) > abs(grid.e) / 2)
    off = far | (col < 0) | (row < 0) | (col >= grid.width) | (row >= grid.height)
    ok = F.when(off, F.raise_error(F.lit(f"{what} does not lie on the cube's grid")).cast("int"))
    return layer.withColumns({"row": F.coalesce(ok, row.cast("int")), "col": F.coalesce(ok, col.cast("int"))})


def require_days(cube: DataFrame, layer: DataFrame, what: str, time: str = "time") -> DataFrame:
    """``layer`` cut to the cube's days; every day of the cube must be there."""
    days = cube.select(F.to_date(time).alias("__d")).distinct()
    lacking = days.join(layer.select(F.to_date(time).alias("__d")).distinct(), "__d", "left_anti").limit(5).collect()
    if lacking:
        raise ValueError(f"{what} lacks {[str(r['__d']) for r in lacking]}")
    return layer.join(days, F.to_date(layer[time]) == F.col("__d"), "left_semi")


def ranked_in_day(df: DataFrame, time: str = "time", by: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy("__day", *by).orderBy(time)
    return df.withColumn("__day", F.to_date(time)).withColumn("__k", F.row_number().over(w))


def rank_aligned(left: DataFrame, right: DataFrame, how: str = "full_outer", time: str = "time") -> DataFrame:
    """The k-th scene of a day with the k-th of the same day: day, k, left_time, right_time."""
    a = ranked_in_day(left.select(time), time).select(F.col("__day").alias("day"), F.col("__k").alias("k"), F.col(time).alias("left_time"))
    b = ranked_in_day(right.select(time), time).select(F.col("__day").alias("day"), F.col("__k").alias("k"), F.col(time).alias("right_time"))
    return a.join(b, ["day", "k"], how)


def asof_nearest(left: DataFrame, right: DataFrame, value: str, by: Sequence[str] = (), time: str = "time", tolerance: str | None = None, out: str | None = None) -> DataFrame:
    """``left`` with the value of the right row nearest in time, the earlier one on a tie; of right rows at one time the
    largest value. Keys match as groups do: a missing key matches a missing key.

    A key is cut into months, so a key with most of the rows, or no key at all, is still many tasks. Each month is given
    the last right row before it and the first after it from a table of one row per key and month. Within a month both
    sides are put in one order by time, once forward and once backward, and each row takes the last right row so far:
    running values, whose cost is that of the two sorts. ``tolerance`` is an interval such as ``5 DAYS``."""
    out = out or value
    cols, keys = left.columns, [*by, "__m"]
    month = lambda c: F.date_trunc("MONTH", c).cast("timestamp_ntz")
    a = left.withColumns({"__t": F.col(time), "__m": month(F.col(time))})
    r = right.select(*by, F.col(time).alias("__t"), F.col(value).alias("__v"), month(F.col(time)).alias("__m")).filter("__t is not null")

    asked = a.select(*keys, F.lit(None).cast(right.schema[time].dataType).alias("__t"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    row = F.struct(F.col("__t").alias("t"), F.col("__v").alias("v"))
    mark = F.when(F.col("__t").isNotNull(), row)
    early = F.when(F.col("__t").isNotNull(), F.struct(-F.unix_micros(F.col("__t").cast("timestamp")), "__v"))
    months = asked.unionByName(r.select(*asked.columns)).groupBy(*keys).agg(F.max_by(mark, early).alias("lo"), F.max(mark).alias("hi"))
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    before = F.last("hi", ignorenulls=True).over(w.orderBy("__m").rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("lo", ignorenulls=True).over(w.orderBy(F.desc("__m")).rowsBetween(Window.unboundedPreceding, -1))
    around = months.withColumns({"__before": before, "__after": after})
    edges = around.select(*keys, F.explode(F.array("__before", "__after")).alias("s")).filter("s is not null").select(*keys, F.col("s.t").alias("__t"), F.col("s.v").alias("__v"))

    marks = r.select(*edges.columns).unionByName(edges).withColumn("__s", F.lit(0))
    both = a.withColumns({"__v": F.lit(None).cast(right.schema[value].dataType), "__s": F.lit(1)}).unionByName(marks, allowMissingColumns=True)
    seen = F.last(F.when(F.col("__s") == 0, row), ignorenulls=True)
    w = Window.partitionBy(*keys)
    back = seen.over(w.orderBy("__t", "__s", "__v").rowsBetween(Window.unboundedPreceding, 0))
    ahead = seen.over(w.orderBy(F.desc("__t"), "__s", "__v").rowsBetween(Window.unboundedPreceding, 0))
    return _nearest(both.withColumns({"__b": back, "__a": ahead}).filter("__s = 1"), cols, tolerance, out)


def _nearest(rows: DataFrame, cols: Sequence[str], tolerance: str | None, out: str) -> DataFrame:
    gap = lambda side: F.abs(F.unix_micros(F.col("__t").cast("timestamp")) - F.unix_micros(F.col(f"{side}.t").cast("timestamp")))
    use_after = F.col("__b").isNull() | (F.col("__a").isNotNull() & (gap("__a") < gap("__b")))
    pick = F.when(use_after, F.col("__a")).otherwise(F.col("__b"))
    value = pick["v"]
    if tolerance:
        near = F.when(use_after, gap("__a")).otherwise(gap("__b"))
        limit = F.expr(f"unix_micros(timestamp'1970-01-01 00:00:00' + INTERVAL {tolerance}) - unix_micros(timestamp'1970-01-01 00:00:00')")
        value = F.when(near <= limit, value)
    return rows.withColumn("__o", value).select(*[c for c in cols if c != out], F.col("__o").alias(out))


def add_bands(old: DataFrame, new: DataFrame, bands: Sequence[str], keys: Sequence[str] = ("time", "row", "col")) -> DataFrame:
    """Left join of new bands; dates that the new side lacks stay missing. Spectral bands first, indices last."""
    from ..functions.indices import INDICES

    joined = old.drop(*bands).join(new.select(*keys, *bands), list(keys), "left")
    names = [c for c in joined.columns if c not in keys]
    return joined.select(*keys, *[c for c in names if c not in INDICES], *[c for c in names if c in INDICES])


def daily_metadata(scenes: DataFrame, fields: dict[str, tuple], day: Column) -> DataFrame:
    """Per day the mean, or the first by (datetime, item_id), of each field: fields maps a name to (Column, reduction)."""
    order = F.struct("datetime", "item_id")
    reduced = []
    for name, (value, how) in fields.items():
        v = value
        reduced.append((F.avg(v) if how == "avg" else F.min_by(v, F.when(v.isNotNull(), order))).alias(name))
    return scenes.withColumn("day", day).groupBy("day").agg(*reduced)


def attach_daily(stats: DataFrame, daily: DataFrame, time: str = "time", required: Sequence[str] = ()) -> DataFrame:
    """Left join by UTC day; a required field that is missing on any day is an error, never a guess."""
    out = stats.join(daily, F.to_date(stats[time]) == daily["day"], "left").drop("day")
    for name in required:
        if not out.filter(F.col(name).isNull()).isEmpty():
            raise ValueError(f"{name} is not known for every day")
    return out


def profile(before: DataFrame, after: DataFrame, row: int, col: int, band: str, time: str = "time") -> DataFrame:
    """One pixel's series in two cubes."""
    at = (F.col("row") == row) & (F.col("col") == col)
    a = before.filter(at).select(time, F.col(band).alias("before"))
    return a.join(after.filter(at).select(time, F.col(band).alias("after")), time, "full_outer")
