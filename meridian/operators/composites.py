"""Composites over time, one pass for all operations of a period."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.registry import OPERATIONS
from ..functions.temporal import Window, date_kind, in_window, season_windows, season_year

REDUCERS = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "std": F.stddev_pop}
PERIOD_ALIASES = {"timeseries": "timeseries", "all": "timeseries", "full": "timeseries", "monthly": "monthly", "annual": "annual"}


@dataclass(frozen=True, order=True)
class Request:
    op: str
    period: str


def parse_requests(tokens: str | Sequence[str]) -> list[Request]:
    """``mean``, ``median_monthly``, ...: a sorted set."""
    out = set()
    for token in [tokens] if isinstance(tokens, str) else tokens:
        op, _, period = token.strip().lower().partition("_")
        if op not in OPERATIONS or (period or "timeseries") not in PERIOD_ALIASES:
            raise ValueError(f"{token!r}: give one of {', '.join(OPERATIONS)}, with _{', _'.join(PERIOD_ALIASES)} or without")
        out.add(Request(op, PERIOD_ALIASES[period or "timeseries"]))
    return sorted(out)


def reduce(df: DataFrame, keys: Sequence[str], bands: Sequence[str], ops: Sequence[str]) -> DataFrame:
    """<band>_<op> per group; NULL values do not count."""
    return df.groupBy(*keys).agg(*(REDUCERS[op](b).alias(f"{b}_{op}") for b in bands for op in ops))


def period_label(period: str, time: Column) -> Column:
    if period == "timeseries":
        return F.lit("timeseries")
    return F.date_format(time, "MM_yyyy" if period == "monthly" else "yyyy")


def composites(pixels: DataFrame, bands: Sequence[str], stats: str | Sequence[str], time: str = "time", by: Sequence[str] = ()) -> DataFrame:
    """(layer, row, col, bands): layer is ``mean_timeseries``, ``max_04_2021``, ``min_2021``. Each period is one
    aggregation with all its operations, unfolded to layers afterwards. ``by``: keys of areas, which come first."""
    by_period: dict[str, list[str]] = {}
    for r in parse_requests(stats):
        by_period.setdefault(r.period, []).append(r.op)
    out = None
    for period, ops in by_period.items():
        wide = reduce(pixels.withColumn("__p", period_label(period, F.col(time))), [*by, "__p", "row", "col"], bands, ops)
        layers = F.explode(F.array(*(F.struct(F.lit(op).alias("op"), *(F.col(f"{b}_{op}").alias(b) for b in bands)) for op in ops)))
        long = wide.select(*by, "__p", "row", "col", layers.alias("s")).select(*by, F.concat_ws("_", "s.op", "__p").alias("layer"), "row", "col", *(F.col(f"s.{b}").alias(b) for b in bands))
        out = long if out is None else out.unionByName(long)
    return out


@dataclass(frozen=True)
class Custom:
    """A composite of one window, or of a season in each of several years."""

    op: str
    start: str
    end: str
    years: tuple[int, ...] = ()
    name: str | None = None

    def __post_init__(self):
        if self.op not in OPERATIONS:
            raise ValueError(f"unknown operation {self.op!r}")
        if self.years and {date_kind(self.start), date_kind(self.end)} != {"season"}:
            raise ValueError("a composite per year has a season of MM-DD days")
        if not self.years and {date_kind(self.start), date_kind(self.end)} != {"day"}:
            raise ValueError("a composite of one window has two days")

    @property
    def windows(self) -> list[Window]:
        return season_windows(self.start, self.end, self.years) if self.years else [(self.start, self.end)]

    @property
    def base(self) -> str:
        return self.name or f"{self.op}_{re.sub('-', '', self.start)}_{re.sub('-', '', self.end)}"


def custom_composite(pixels: DataFrame, bands: Sequence[str], spec: Custom, taken: Sequence[str] = (), time: str = "time", by: Sequence[str] = ()) -> DataFrame:
    """(layer, row, col, bands, n_dates). Years without a scene give no layer; a season is found by a projection to its
    start year, without a join."""
    if spec.base in taken:
        raise ValueError(f"there is a layer {spec.base} already")
    t = F.col(time)
    if spec.years:
        y = season_year(t, spec.start, spec.end)
        rows = pixels.withColumn("__y", y).filter(F.col("__y").isin(*spec.years))
        layer = F.concat_ws("_", F.lit(spec.base), F.col("__y").cast("string"))
    else:
        rows, layer = pixels.filter(in_window(t, spec.windows[0])), F.lit(spec.base)
    rows = rows.withColumn("layer", layer)
    return rows.groupBy(*by, "layer", "row", "col").agg(*(REDUCERS[spec.op](b).alias(b) for b in bands), F.count_distinct(F.to_date(t)).alias("n_dates"))


def solar_day_mosaic(pixels: DataFrame, bands: Sequence[str], order: Column, keys: Sequence[str] = ("day", "row", "col")) -> DataFrame:
    """Scenes of a day fused: of each band the first value that is not missing, by ``order``, which must be total."""
    return pixels.withColumn("__o", order).groupBy(*keys).agg(*(F.min_by(F.col(b), F.when(F.col(b).isNotNull(), F.col("__o"))).alias(b) for b in bands))
