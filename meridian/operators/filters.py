"""Filters of scenes, dates and areas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class NothingLeft(ValueError):
    """A filter kept no scene."""


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise NothingLeft(what)
    return df


def cloud_cover(scenes: DataFrame, max_cc: float | None, column: str = "cloud_cover") -> DataFrame:
    """Pushed to the catalogue: between 0 and ``max_cc``; no bound is no filter."""
    return scenes if max_cc is None else scenes.filter(F.col(column).between(0, max_cc))


def keep_dates(pixels: DataFrame, dates: DataFrame, time: str = "time", exact: bool = False) -> DataFrame:
    """Rows of the days (or, ``exact``, times) in ``dates``."""
    key = (lambda c: c) if exact else F.to_date
    wanted = dates.select(key(F.col(time)).alias("__d")).distinct()
    return pixels.join(wanted, key(pixels[time]) == F.col("__d"), "left_semi")


def missing_dates(wanted: DataFrame, have: DataFrame, time: str = "time") -> DataFrame:
    """Days of ``wanted`` that ``have`` lacks."""
    a = wanted.select(F.to_date(time).alias("day")).distinct()
    return a.join(have.select(F.to_date(time).alias("day")).distinct(), "day", "left_anti")


def new_dates(pixels: DataFrame, existing: DataFrame, time: str = "time") -> DataFrame:
    """Rows of days that ``existing`` does not hold yet."""
    have = existing.select(F.to_date(time).alias("__d")).distinct()
    return pixels.join(have, F.to_date(pixels[time]) == F.col("__d"), "left_anti")


def by_cloud(stats: DataFrame, most: float | None) -> DataFrame:
    return stats if most is None or most >= 100 else stats.filter(F.col("cloud_percentage") <= most)


def by_coverage(stats: DataFrame, least: float | None = 0.9) -> DataFrame:
    return stats if least is None else stats.filter(F.col("scene_coverage") >= least)


def keep_scenes(pixels: DataFrame, stats: DataFrame, key: str | Sequence[str] = "time") -> DataFrame:
    """Pixels of the scenes that are left; the table of scenes is small and joined as such by its size."""
    keys = [key] if isinstance(key, str) else list(key)
    return pixels.join(stats.select(*keys), keys, "left_semi")


def crop(pixels: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Closed ranges, given in either direction."""
    return pixels.filter(F.col("row").between(*sorted(rows)) & F.col("col").between(*sorted(cols)))


def clip_bbox(pixels: DataFrame, grid, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Pixels whose centre lies in the box (left, bottom, right, top)."""
    left, bottom, right, top = bbox
    x, y = grid.x(F.col("col")), grid.y(F.col("row"))
    return pixels.filter(x.between(left, right) & y.between(bottom, top))


def clip_polygon(pixels: DataFrame, aoi: DataFrame, bands: Sequence[str]) -> DataFrame:
    """NULL outside an AOI mask (row, col, inside), rows and columns cut to its extent."""
    inside = aoi.filter("inside").select("row", "col", F.lit(True).alias("__in"))
    box = inside.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    cut = pixels.join(F.broadcast(box), F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1"))).drop("r0", "r1", "c0", "c1")
    joined = cut.join(inside, ["row", "col"], "left")
    return joined.withColumns({b: F.when(F.col("__in"), F.col(b)) for b in bands}).drop("__in")


def missing_frames(pixels: DataFrame, band: str, share: float = 0.05, least: int = 64, flat: float = 1e-12) -> DataFrame:
    """(time, n, missing): a frame is missing if it has less than a share of the largest frame so far, or no contrast."""
    per = pixels.groupBy("time").agg(F.count(band).alias("n"), F.var_pop(band).alias("v"))
    seen = F.max("n").over(Window.orderBy("time").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    missing = (F.col("n") < F.greatest(seen * share, F.lit(float(least)))) | F.coalesce(F.col("v") <= flat, F.lit(True))
    return per.select("time", "n", missing.alias("missing"))


def by_orbit_state(pixels: DataFrame, stats: DataFrame, state: str) -> DataFrame:
    return keep_scenes(pixels, stats.filter(F.col("orbit_state") == state))
