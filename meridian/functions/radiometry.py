"""Raw numbers to reflectance, packing, stretching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expr import is_categorical, missing_if, safe_div
from .registry import mission, source_name

#: From this day on the rolling archive holds pixels with the offset of -1000.
OFFSET_SINCE = "2022-01-25"
#: Processing baseline that introduced the offset.
OFFSET_BASELINE = 4.0


def scaled(dn: Column, mission_name: str, source: str | None = None, time: Column | None = None, baseline: Column | None = None, affine: bool = False) -> Column:
    """Reflectance of a raw number. Declared no-data is NULL before anything is added. ``affine`` reads gain and
    offset as ``dn * gain + offset``; the default adds the offset first."""
    m = mission(mission_name)
    v = (missing_if(dn, m.nodata) if m.nodata is not None else dn).cast("double")
    if m.name == "sentinel_2_l1c":
        if baseline is None:
            raise ValueError("sentinel_2_l1c is scaled by baseline")
        return F.when(baseline >= OFFSET_BASELINE, (v - 1000) / 10000).otherwise(v / 10000)
    if m.name == "sentinel_2_l2a":
        s = source_name(source or "element84")
        if s == "element84":
            return v * m.gain
        if s in ("cdse", "terrabyte"):
            return (v - 1000) * m.gain
        if time is None:
            raise ValueError("planetary_computer pixels are scaled by time")
        return F.when(time >= F.lit(OFFSET_SINCE).cast("timestamp_ntz"), (v - 1000) * m.gain).otherwise(v * m.gain)
    return v * m.gain + m.offset if affine else (v + m.offset) * m.gain


def scale_bands(pixels: DataFrame, bands: Sequence[str], mission_name: str, source: str | None = None, time: str = "time", baseline: str | None = None) -> DataFrame:
    """Scale all bands but class codes and bit words."""
    b = F.col(baseline) if baseline else None
    return pixels.withColumns({x: scaled(F.col(x), mission_name, source, F.col(time), b) for x in bands if not is_categorical(x)})


PACK_RANGE, PACK_FILL, PACK_MAX = 6.5, -32768, 32767


def pack_int16(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, float | None, float | None]:
    """Pack columns to 16 bits with one scale and offset if their range is at most PACK_RANGE; else ``df`` as it is."""
    lo = F.least(*(F.min(c) for c in columns)) if len(columns) > 1 else F.min(columns[0])
    hi = F.greatest(*(F.max(c) for c in columns)) if len(columns) > 1 else F.max(columns[0])
    low, high = df.agg(lo, hi).first()
    if low is None or high - low > PACK_RANGE:
        return df, None, None
    scale, offset = (high - low) / 65534 or 1.0, (high + low) / 2
    return df.withColumns({c: packed(F.col(c), scale, offset) for c in columns}), scale, offset


def packed(v: Column, scale: float | Column, offset: float | Column) -> Column:
    n = F.rint((v - offset) / scale)
    n = F.greatest(F.lit(-PACK_MAX), F.least(F.lit(PACK_MAX), n))
    return F.when(v.isNull(), F.lit(PACK_FILL)).otherwise(n).cast("smallint")


def unpacked(n: Column, scale: float | Column, offset: float | Column) -> Column:
    return F.when(n != PACK_FILL, n * scale + offset)


def stretch_uint8(df: DataFrame, by: Sequence[str], bands: Sequence[str], low: float = 0.02, high: float = 0.98, gamma: float = 1.0) -> DataFrame:
    """Bands of each group (a frame) stretched between two exact percentiles to 0..255; missing becomes 0."""
    cuts = df.groupBy(*by).agg(*(F.percentile(b, F.array(F.lit(low), F.lit(high))).alias(f"__{b}") for b in bands))
    joined = df.join(cuts, list(by))
    out = {}
    for b in bands:
        lo, hi = F.col(f"__{b}")[0], F.col(f"__{b}")[1]
        unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), safe_div(F.col(b) - lo, hi - lo)))
        unit = F.when(F.col(b).isNull() | (hi <= lo), F.lit(0.0)).otherwise(unit)
        out[b] = F.floor(F.pow(unit, F.lit(1 / gamma)) * 255 + 0.5).cast("smallint")
    return joined.withColumns(out).drop(*(f"__{b}" for b in bands))


def piecewise_lut(stops: Sequence[tuple[float, tuple[int, int, int]]], size: int = 256) -> list[tuple[int, int, int]]:
    """Colours interpolated between stops (position 0..1, colour)."""
    stops = sorted(stops)
    out = []
    for k in range(size):
        x = k / (size - 1)
        right = next((j for j, s in enumerate(stops) if s[0] >= x), len(stops) - 1)
        left = max(0, right - 1)
        (a, ca), (b, cb) = stops[left], stops[right]
        t = 0.0 if b == a else min(1.0, max(0.0, (x - a) / (b - a)))
        out.append(tuple(int(ca[i] + (cb[i] - ca[i]) * t + 0.5) for i in range(3)))
    return out


def apply_lut(value: Column, lut: Sequence[tuple[int, int, int]], low: float = -1.0, high: float = 1.0) -> Column:
    """array(r, g, b) of a value between ``low`` and ``high``; NULL stays NULL."""
    table = F.array(*(F.array(*map(F.lit, c)) for c in lut))
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))
    return F.when(value.isNotNull(), F.element_at(table, (F.floor(unit * (len(lut) - 1) + 0.5) + 1).cast("int")))
