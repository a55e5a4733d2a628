"""Null-safe arithmetic: no-data is NULL, a division by zero is NULL, nothing is ever NaN or infinite."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(num: Column, den: Column) -> Column:
    return num / F.nullif(den, F.lit(0))


def clamp(v: Column, low: float, high: float) -> Column:
    """greatest() and least() skip NULL, so a missing value is guarded."""
    return F.when(v.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), v)))


def normalized_difference(a: Column, b: Column) -> Column:
    return clamp(safe_div(a - b, a + b), -1.0, 1.0)


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, half up; 0 where there is nothing to count."""
    return F.coalesce(F.floor(safe_div(F.lit(100.0) * part, whole) + 0.5), F.lit(0)).cast("smallint")


def probability_percent(p: Column) -> Column:
    """0..1 to 0..100 by truncation."""
    return F.floor(p * 100).cast("tinyint")


def rounded(v: Column, digits: int = 6) -> Column:
    """Rounding whose ties do not depend on the last bit of a sum."""
    return F.round(v + F.lit(1e-9), digits)


def missing_if(v: Column, nodata) -> Column:
    return F.nullif(v, F.lit(nodata))


def nan_to_null(v: Column) -> Column:
    return F.when(~F.isnan(v), v)


def any_of(conditions: Iterable[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def bit(word: Column, k: int) -> Column:
    return F.shiftright(word, k).bitwiseAND(1)


def is_categorical(name: str) -> bool:
    """Class codes and bit words: never scaled, never interpolated."""
    name = name.lower()
    return name == "scl" or name.startswith(("qa_", "cloud_mask", "shadow_mask", "cloudshadow_mask")) or name == "qa"


def resolve_band(columns: Iterable[str], *wanted: str) -> str:
    """The column of the first name found, in any case."""
    by_lower = {c.lower(): c for c in columns}
    for w in wanted:
        if w.lower() in by_lower:
            return by_lower[w.lower()]
    raise ValueError(f"band {' or '.join(wanted)} is needed; there are {', '.join(sorted(by_lower))}")
