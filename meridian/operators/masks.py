"""Cloud, class and no-data masks on wide pixel tables (time, row, col, one column per band)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import any_of, bit
from ..functions.registry import mission

KEYS = ("time", "row", "col")


def cloud_and_imaged(class_band: Column, mission_name: str) -> tuple[Column, Column]:
    """Whether a pixel is cloud, and whether it was imaged at all; never NULL."""
    m = mission(mission_name)
    if m.class_band is None:
        raise ValueError(f"{m.name} has no class layer")
    if m.class_band == "qa_pixel":
        cloud = any_of(bit(class_band, k) == 1 for k in m.cloud_classes)
        imaged = class_band.isNotNull() & (class_band != 0) & (bit(class_band, 0) == 0)
    else:
        cloud = class_band.isin(*m.cloud_classes)
        imaged = class_band.isNotNull() & (class_band != 0)
    return F.coalesce(cloud, F.lit(False)), F.coalesce(imaged, F.lit(False))


def masked(pixels: DataFrame, bands: Sequence[str], hide: Column) -> DataFrame:
    return pixels.withColumns({b: F.when(~hide, F.col(b)) for b in bands})


def class_mask(pixels: DataFrame, mission_name: str, bands: Sequence[str], keep_clouds: bool = False, keep_layer: bool = False) -> DataFrame:
    """Bands NULL under cloud and where nothing was imaged; the class band goes unless kept."""
    band = mission(mission_name).class_band
    cloud, imaged = cloud_and_imaged(F.col(band), mission_name)
    hide = ~imaged if keep_clouds else cloud | ~imaged
    out = masked(pixels, [b for b in bands if b != band], hide)
    return out if keep_layer else out.drop(band)


def scl_mask(pixels: DataFrame, mission_name: str = "sentinel_2_l2a") -> DataFrame:
    """Mask table of a class layer: keys, cloud_mask_scl, mask_method."""
    cloud, _ = cloud_and_imaged(F.col(mission(mission_name).class_band), mission_name)
    return pixels.select(*KEYS, cloud.cast("tinyint").alias("cloud_mask_scl"), F.lit("scl").alias("mask_method"))


def update_scl_mask(mask: DataFrame, pixels: DataFrame, mission_name: str = "sentinel_2_l2a") -> DataFrame:
    """Add the days that the mask table lacks."""
    day = lambda c: F.to_date(c)
    have = mask.select(day("time").alias("__d")).distinct()
    new = pixels.join(have, day("time") == F.col("__d"), "left_anti")
    return mask.unionByName(scl_mask(new, mission_name).select(*mask.columns))


def apply_mask(pixels: DataFrame, mask: DataFrame, layer: str, bands: Sequence[str]) -> DataFrame:
    """Inner join on (time, row, col); bands stay where the layer is 0."""
    m = mask.select(*KEYS, F.col(layer).alias("__m"))
    return masked(pixels.join(m, list(KEYS)), bands, F.coalesce(F.col("__m") != 0, F.lit(True))).drop("__m")


def zeros_to_null(pixels: DataFrame, bands: Sequence[str]) -> DataFrame:
    """A pixel is no-data where every band is exactly 0."""
    empty = F.lit(True)
    for b in bands:
        empty = empty & F.coalesce(F.col(b) == 0, F.lit(False))
    return masked(pixels, bands, empty)


def threshold_masks(prob: DataFrame, thresholds: Sequence[float], column: str = "cloud_prob") -> DataFrame:
    """cloud_mask_<N> of a probability in percent, one column per threshold."""
    if bad := [t for t in thresholds if not 0 < t <= 100]:
        raise ValueError(f"thresholds are percent: {bad}")
    return prob.withColumns({f"cloud_mask_{t:g}": (F.col(column) >= t).cast("tinyint") for t in thresholds})


def fill_missing_probability(scored: DataFrame, scl: DataFrame, policy: str = "scl") -> DataFrame:
    """(keys, cloud_prob, mask_method) for every pixel of ``scl``: the scored probability, else by ``policy`` the class
    mask in percent (scl), nothing (drop), or an error."""
    if policy not in ("scl", "drop", "error"):
        raise ValueError("policy is scl, drop or error")
    s = scored.select(*KEYS, F.col("cloud_prob").alias("__p"))
    joined = scl.join(s, list(KEYS), "left")
    if policy == "drop":
        joined = joined.filter("__p is not null")
    own = F.coalesce("__p", (F.col("cloud_mask_scl") * 100).cast("tinyint"))
    if policy == "error":
        own = F.when(F.col("__p").isNotNull(), own).otherwise(F.raise_error(F.lit("a scene has no probability")).cast("tinyint"))
    return joined.select(*KEYS, own.alias("cloud_prob"), F.when(F.col("__p").isNotNull(), "s2cloudless").otherwise("scl").alias("mask_method"))


def masking_status(layer: str) -> str | None:
    """What a mask layer says about how a cube was masked; None where its name does not tell."""
    if layer == "cloud_mask_scl":
        return "scl_masked"
    if m := re.fullmatch(r"cloud_mask(?:_([\d.]+))?", layer):
        return f"s2cloudless_masked_{m[1]}" if m[1] else "s2cloudless_masked"
    if m := re.fullmatch(r"(cloudshadow|shadow)_mask(?:_(scl|[\d.]+))?", layer):
        return f"{m[1]}_masked" + (f"_{m[2]}" if m[2] else "")
    return None


def add_mask_bands(mask: DataFrame, extra: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add layers, replacing those of the same name. Both must hold the same days."""
    a, b = mask.select(F.to_date("time").alias("d")).distinct(), extra.select(F.to_date("time").alias("d")).distinct()
    odd = a.exceptAll(b).unionByName(b.exceptAll(a)).limit(5).collect()
    if odd:
        raise ValueError(f"the days differ: {[str(r['d']) for r in odd]}")
    return mask.drop(*names).join(extra.select(*KEYS, *names), list(KEYS), "left")


def empty_scenes(pixels: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Scenes in which every value is 0 or missing."""
    return pixels.groupBy("time").agg(F.bool_or(any_of(F.coalesce(F.col(b) != 0, F.lit(False)) for b in bands)).alias("any")).filter("not any").select("time")
