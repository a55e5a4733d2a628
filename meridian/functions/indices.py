"""Spectral and radar indices as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expr import normalized_difference, resolve_band, safe_div
from .registry import mission

#: Per band role the column names that may fill it, best first.
ROLES = {
    "nir": ("nir", "nir08"),
    "swir1": ("swir16", "swir1"),
    "swir2": ("swir22", "swir2"),
}


def _nd(a: str, b: str):
    return (a, b), lambda x, y: normalized_difference(x, y)


def savi(red: Column, nir: Column, soil: float = 0.5) -> Column:
    return safe_div((nir - red) * (1 + soil), nir + red + soil)


def evi(blue: Column, red: Column, nir: Column) -> Column:
    return safe_div((nir - red) * 2.5, nir + red * 6 - blue * 7.5 + 1)


INDICES: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "ndvi": _nd("nir", "red"),
    "ndwi": _nd("green", "nir"),
    "ndmi": _nd("nir", "swir1"),
    "nbr": _nd("nir", "swir2"),
    "mndwi": _nd("green", "swir1"),
    "ndsi": _nd("green", "swir1"),
    "ndbi": _nd("swir1", "nir"),
    "ndre1": _nd("nir", "rededge1"),
    "savi": (("red", "nir"), savi),
    "evi": (("blue", "red", "nir"), evi),
    "vh/vv": (("vh", "vv"), safe_div),
    "vv/vh": (("vv", "vh"), safe_div),
    "rvi": (("vh", "vv"), lambda vh, vv: safe_div(vh * 4, vh + vv)),
}


def index(name: str, columns: Sequence[str]) -> Column:
    """The expression of one index over the columns there are; only its own bands are read."""
    key = name.lower()
    if key not in INDICES:
        raise ValueError(f"unknown index {name!r}; there are {', '.join(INDICES)}")
    roles, formula = INDICES[key]
    return formula(*(F.col(f"`{resolve_band(columns, *ROLES.get(r, (r,)))}`") for r in roles))


def with_indices(pixels: DataFrame, names: Sequence[str], mission_name: str | None = None) -> DataFrame:
    """``pixels`` with a column for each index, in the order asked for. A mission limits what may be asked."""
    if mission_name:
        allowed = mission(mission_name).indices
        if bad := [n for n in names if n.lower() not in allowed]:
            raise ValueError(f"{mission(mission_name).name} has no {', '.join(bad)}; it has {', '.join(allowed) or 'no indices'}")
    return pixels.select("*", *(index(n, pixels.columns).alias(n.lower()) for n in names))


def register(spark) -> None:
    """The plain indices as SQL functions."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION nd(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN CASE WHEN a IS NOT NULL AND b IS NOT NULL AND a + b <> 0 THEN greatest(-1D, least(1D, (a - b) / nullif(a + b, 0D))) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION savi(red DOUBLE, nir DOUBLE) RETURNS DOUBLE RETURN 1.5D * (nir - red) / nullif(nir + red + 0.5D, 0D)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION evi(blue DOUBLE, red DOUBLE, nir DOUBLE) RETURNS DOUBLE RETURN 2.5D * (nir - red) / nullif(nir + 6D * red - 7.5D * blue + 1D, 0D)")
