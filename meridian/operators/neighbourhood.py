"""Neighbourhoods of pixels: shadow zones, smoothing, dilation, slopes.

Sparse masks are moved and joined as rows; dense windows run in NumPy on tiles that carry a halo, so no tile needs its
neighbours."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import Grid

KEYS = ("time", "row", "col")


def shadow_steps(azimuth: float, resolution: float, distance_m: float, step_m: float) -> list[tuple[int, int]]:
    """Row and column offsets at which a cloud's shadow may lie, away from the sun; halves round to even."""
    az = math.radians(azimuth)
    return [(round(k * step_m * math.cos(az) / resolution), round(-k * step_m * math.sin(az) / resolution)) for k in range(1, round(distance_m / step_m) + 1)]


def shadow_zone(clouds: DataFrame, resolution: float, distance_m: float = 1000.0, step_m: float = 100.0, azimuth: str = "sun_azimuth", shape: tuple[int, int] | None = None) -> DataFrame:
    """Pixels (time, row, col) that some cloud pixel's shadow may reach, by the azimuth in each row."""
    n = round(distance_m / step_m)
    az = F.radians(F.col(azimuth))
    k = F.explode(F.sequence(F.lit(1), F.lit(max(1, n)))).alias("k")
    moved = clouds.select(*KEYS, azimuth, k)
    dr = F.rint(F.col("k") * step_m * F.cos(az) / resolution).cast("int")
    dc = F.rint(-F.col("k") * step_m * F.sin(az) / resolution).cast("int")
    out = moved.select("time", (F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col")).distinct()
    if shape:
        out = out.filter(F.col("row").between(0, shape[0] - 1) & F.col("col").between(0, shape[1] - 1))
    return out if n else out.limit(0)


def dark_pixels(pixels: DataFrame, nir: str = "nir", scl: str | None = "scl", threshold: float = 0.18) -> DataFrame:
    dark = (F.col(nir) > 0) & (F.col(nir) < threshold)
    if scl:
        dark = dark & ~F.coalesce(F.col(scl).isin(0, 6), F.lit(False))
    return pixels.filter(dark).select(*KEYS)


def disk(radius: int) -> np.ndarray:
    y, x = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    return x * x + y * y <= radius * radius


def disk_offsets(radius: int) -> list[tuple[int, int]]:
    return [(int(r) - radius, int(c) - radius) for r, c in zip(*np.nonzero(disk(radius)), strict=True)]


def dilate(mask: DataFrame, radius: int, shape: tuple[int, int] | None = None) -> DataFrame:
    """Set pixels (time, row, col) grown by a disk: each is copied to its offsets, copies are merged before the shuffle."""
    off = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in disk_offsets(radius)))).alias("o")
    out = mask.select(*KEYS, off).select("time", (F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col")).distinct()
    return out.filter(F.col("row").between(0, shape[0] - 1) & F.col("col").between(0, shape[1] - 1)) if shape else out


def disk_mean_above(values: DataFrame, radius: int, shape: tuple[int, int], value: Column, limit: float) -> DataFrame:
    """Pixels (time, row, col) over whose disk the mean of ``value`` exceeds ``limit``; pixels that are not there count 0.
    Beyond the border the image is mirrored with its edge pixel repeated (row -1 is row 0). Only pixels above 0 are
    copied to their disk, and copies are summed before they move."""
    height, width = shape
    offs = disk_offsets(radius)
    off = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in offs))).alias("o")
    # Each pixel stands in for its mirror images near a border.
    mirrors = lambda v, n: F.array_distinct(F.array(v, F.when(v < radius, -1 - v).otherwise(v), F.when(v >= n - radius, 2 * n - 1 - v).otherwise(v)))
    some = values.select(*KEYS, value.alias("v")).filter("v > 0")
    spread = some.select("time", F.explode(mirrors(F.col("row"), height)).alias("row"), "col", "v").select("time", "row", F.explode(mirrors(F.col("col"), width)).alias("col"), "v")
    votes = spread.select("time", "row", "col", "v", off).select("time", (F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col"), "v")
    votes = votes.filter(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    return votes.groupBy(*KEYS).agg(F.sum("v").alias("n")).filter(F.col("n") > limit * len(offs)).select(*KEYS)


def majority(mask: DataFrame, radius: int, shape: tuple[int, int]) -> DataFrame:
    """Pixels whose disk is set in more than half; borders as in ``disk_mean_above``."""
    return disk_mean_above(mask, radius, shape, F.lit(1), 0.5)


def smooth_and_dilate(mask: DataFrame, average_over: int, dilation: int, shape: tuple[int, int]) -> DataFrame:
    out = majority(mask, average_over, shape) if average_over else mask.select(*KEYS)
    return dilate(out, dilation, shape) if dilation else out


def probability_masks(prob: DataFrame, thresholds: Sequence[float], shape: tuple[int, int], average_over: int = 4, dilation: int = 2) -> DataFrame:
    """``prob`` (KEYS, cloud_prob in percent, mask_method) with cloud_mask_<N> for each threshold: the probability is
    averaged over a disk, compared, and what is above is grown. Scenes whose probability was filled from classes
    (mask_method ``scl``) are taken as they are, cloud at 100."""
    if bad := [t for t in thresholds if not 0 < t <= 100]:
        raise ValueError(f"thresholds are percent: {bad}")
    filled = F.col("mask_method") == "scl" if "mask_method" in prob.columns else F.lit(False)
    own = prob.filter(~F.coalesce(filled, F.lit(False)))
    out = prob
    for t in thresholds:
        above = disk_mean_above(own, average_over, shape, F.col("cloud_prob"), t) if average_over else own.filter(F.col("cloud_prob") > t).select(*KEYS)
        above = (dilate(above, dilation, shape) if dilation else above).withColumn("__on", F.lit(True))
        hit = F.when(F.coalesce(filled, F.lit(False)), F.col("cloud_prob") >= 100).otherwise(F.coalesce("__on", F.lit(False)))
        out = out.join(above, list(KEYS), "left").withColumn(f"cloud_mask_{t:g}", F.coalesce(hit, F.lit(False)).cast("tinyint")).drop("__on")
    return out


def cloud_pixels(mask: DataFrame, threshold: float, shape: tuple[int, int], average_over: int = 4, dilation: int = 2) -> DataFrame:
    """Cloud pixels (KEYS) of a mask table: the layer made for the threshold, else one made of ``cloud_prob``, else the
    first mask layer there is."""
    exact = f"cloud_mask_{threshold:g}"
    layers = [c for c in mask.columns if c.startswith("cloud_mask")]
    if exact not in mask.columns and "cloud_prob" in mask.columns:
        mask = probability_masks(mask.drop(*layers), [threshold], shape, average_over, dilation)
    elif exact not in mask.columns:
        if not layers:
            raise ValueError(f"there is no cloud_mask layer and no cloud_prob among {', '.join(mask.columns)}")
        exact = layers[0]
    return mask.filter(F.col(exact) > 0).select(*KEYS)


def detect_shadows(pixels: DataFrame, clouds: DataFrame, grid: Grid, distance_m: float = 1000.0, step_m: float = 100.0, threshold: float = 0.18, average_over: int = 4, dilation: int = 2, nir: str = "nir", scl: str | None = "scl") -> DataFrame:
    """Shadow pixels: dark, within reach of a cloud, smoothed, grown, and not cloud. ``clouds`` has sun_azimuth."""
    shape = (grid.height, grid.width)
    zone = shadow_zone(clouds, abs(grid.a), distance_m, step_m, shape=shape)
    dark = dark_pixels(pixels, nir, scl, threshold).join(zone, list(KEYS), "left_semi")
    return smooth_and_dilate(dark, average_over, dilation, shape).join(clouds.select(*KEYS), list(KEYS), "left_anti")


def with_azimuth(clouds: DataFrame, azimuths: DataFrame) -> DataFrame:
    """Cloud pixels with the sun_azimuth of their day; ``azimuths`` is (day, sun_azimuth). A day without one is an error,
    never a guess."""
    joined = clouds.withColumn("day", F.to_date("time")).join(azimuths.select("day", "sun_azimuth"), "day", "left").drop("day")
    return joined.withColumn("sun_azimuth", F.coalesce("sun_azimuth", F.raise_error(F.lit("a day has no sun azimuth")).cast("double")))


def shadow_layers(pixels: DataFrame, mask: DataFrame, azimuths: DataFrame, grid: Grid, threshold: float = 45, distance_m: float = 1000.0, step_m: float = 100.0, dark: float = 0.18, average_over: int = 4, dilation: int = 2, nir: str = "nir", scl: str | None = "scl") -> DataFrame:
    """Every pixel's cloud_mask, shadow_mask and cloudshadow_mask (KEYS, 0 or 1): clouds by ``cloud_pixels``, shadows by
    ``detect_shadows``."""
    clouds = cloud_pixels(mask, threshold, (grid.height, grid.width), average_over, dilation)
    shadows = detect_shadows(pixels, with_azimuth(clouds, azimuths), grid, distance_m, step_m, dark, average_over, dilation, nir, scl)
    both = clouds.withColumns({"c": F.lit(1), "s": F.lit(0)}).unionByName(shadows.withColumns({"c": F.lit(0), "s": F.lit(1)}))
    marks = both.groupBy(*KEYS).agg(F.max("c").alias("c"), F.max("s").alias("s"))
    c, s = (F.coalesce(x, F.lit(0)).cast("tinyint") for x in ("c", "s"))
    return pixels.select(*KEYS).join(marks, list(KEYS), "left").select(*KEYS, c.alias("cloud_mask"), s.alias("shadow_mask"), F.greatest(c, s).alias("cloudshadow_mask"))


# Dense kernels on tiles ---------------------------------------------------------------------------------------------


def map_tiles(pixels: DataFrame, bands: Sequence[str], kernel: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], halo: int, tile: int = 256, schema: str | None = None, keys: Sequence[str] = ("time",)) -> DataFrame:
    """Apply ``kernel`` to band arrays of each tile with ``halo`` pixels around it and keep its inner part.

    Each pixel is copied to the tiles whose halo it is in, so a task needs one tile at a time. Missing is NaN inside
    the kernel and NULL outside."""
    spans = lambda v: F.sequence(F.floor((v - halo) / tile).cast("int"), F.floor((v + halo) / tile).cast("int"))
    spread = pixels.select(*keys, "row", "col", *bands).withColumn("trow", F.explode(spans(F.col("row")))).withColumn("tcol", F.explode(spans(F.col("col"))))
    kinds = ", ".join(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["trow"].iloc[0]) * tile - halo, int(pdf["tcol"].iloc[0]) * tile - halo
        size = tile + 2 * halo
        r, c = pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0
        arrays = {}
        for b in bands:
            a = np.full((size, size), np.nan)
            a[r, c] = pdf[b].to_numpy(dtype=float)
            arrays[b] = a
        out = kernel(arrays)
        mine = (r >= halo) & (r < halo + tile) & (c >= halo) & (c < halo + tile)
        done = {**{k: pdf[k].to_numpy()[mine] for k in keys}, "row": pdf["row"].to_numpy()[mine], "col": pdf["col"].to_numpy()[mine]}
        for name, a in out.items():
            v = a[r[mine], c[mine]]
            done[name] = pd.array(np.where(np.isnan(v), None, v), dtype="Float64")
        return pd.DataFrame(done)

    names = schema or ", ".join(f"{b} double" for b in bands)
    return spread.groupBy(*keys, "trow", "tcol").applyInPandas(run, f"{kinds}, row int, col int, {names}")


def slope_aspect(dem: DataFrame, band: str, resolution: float) -> DataFrame:
    """Slope in degrees and aspect clockwise from north of an elevation table (row, col, band), by Horn's weights: nine
    neighbours joined as one aggregation of moved rows. Pixels without all neighbours are missing."""
    offs = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)]
    weight = lambda d, other: d * (2 if other == 0 else 1)
    moved = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(float(weight(-c, r))).alias("wx"), F.lit(float(weight(-r, c))).alias("wy")) for r, c in offs))).alias("o")
    sums = dem.filter(F.col(band).isNotNull()).select("row", "col", band, moved).groupBy((F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col"))
    g = sums.agg(F.sum(F.col(band) * F.col("o.wx")).alias("gx"), F.sum(F.col(band) * F.col("o.wy")).alias("gy"), F.count(F.lit(1)).alias("n"))
    dx, dy = F.col("gx") / (8 * resolution), F.col("gy") / (8 * resolution)
    whole = F.col("n") == 9
    slope = F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))
    aspect = F.pmod(F.degrees(F.atan2(-dx, dy)), F.lit(360.0))
    out = g.select("row", "col", F.when(whole, slope).alias("slope"), F.when(whole & ((dx != 0) | (dy != 0)), aspect).alias("aspect"))
    return dem.select("row", "col").join(out, ["row", "col"], "left")


def score_pixels(pixels: DataFrame, bands: Sequence[str], scorer: Callable[[np.ndarray], np.ndarray], name: str = "cloud_prob") -> DataFrame:
    """Probability in percent, cut to whole, by a scorer from an array (n, bands) to (n,) in 0..1; NULL where a band is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[list(bands)].to_numpy(dtype=float)
            ok = ~np.isnan(x).any(axis=1)
            p = np.full(len(x), np.nan)
            if ok.any():
                p[ok] = np.floor(np.clip(scorer(x[ok]), 0, 1) * 100)
            yield pdf[list(KEYS)].assign(**{name: pd.array(np.where(np.isnan(p), None, p), dtype="Int16")})

    kinds = ", ".join(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in KEYS)
    return pixels.select(*KEYS, *bands).mapInPandas(run, f"{kinds}, {name} smallint")


def brightness_scorer(x: np.ndarray) -> np.ndarray:
    """A stand-in where no trained model is given: bright and white is cloud."""
    mean, spread = x.mean(axis=1), x.std(axis=1)
    return 1 / (1 + np.exp(-(12 * (mean - 0.3) - 8 * spread)))
