"""Incremental updates: append dates, add bands, reconcile columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from .filters import new_dates
from .joins import add_bands


def append_dates(old: DataFrame, new: DataFrame, time: str = "time") -> DataFrame:
    """Old pixels, and new ones of days that the old do not have. Columns that only one side has are dropped, never filled."""
    new = new_dates(new, old, time)
    a, b = reconcile(old, new)
    return a.unionByName(b)


def reconcile(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    common = [c for c in old.columns if c in new.columns]
    return old.select(*common), new.select(*common)


def one_sided(old: DataFrame, new: DataFrame) -> list[str]:
    return sorted(set(old.columns) ^ set(new.columns))


def update(old: DataFrame, new: DataFrame, new_bands: Sequence[str] = (), time: str = "time") -> DataFrame:
    return add_bands(old, new, new_bands) if new_bands else append_dates(old, new, time)


def tiles_kept_apart(parts: Sequence[DataFrame]) -> DataFrame:
    """Cubes of single tiles in one table; each has its tile column."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
