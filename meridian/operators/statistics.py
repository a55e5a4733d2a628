"""Scene statistics and the statistics table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import percent, rounded, safe_div


def scene_statistics(pixels: DataFrame, cloud: Column, imaged: Column, aoi_pixels: int | Column, key: str | Sequence[str] = "time") -> DataFrame:
    """cloud_percentage of what was imaged and scene_coverage of the AOI, in one aggregation of the class band only. Keys
    besides the time tell areas apart."""
    n, c = F.count_if(imaged), F.count_if(imaged & cloud)
    whole = F.lit(aoi_pixels) if isinstance(aoi_pixels, int) else aoi_pixels
    keys = [key] if isinstance(key, str) else list(key)
    return pixels.groupBy(*keys).agg(percent(c, n).alias("cloud_percentage"), F.coalesce(safe_div(n.cast("double"), whole), F.lit(0.0)).alias("scene_coverage"), n.alias("n_imaged"))


def masked_percentage(mask: DataFrame, layer: str, key: str = "time") -> DataFrame:
    """Per scene the share in percent, not rounded, of pixels that a mask layer hides."""
    return mask.groupBy(key).agg((F.avg((F.col(layer) != 0).cast("double")) * 100).alias("masked_percentage"))


def cloud_percentage_from_missing(pixels: DataFrame, bands: Sequence[str], key: str = "time") -> DataFrame:
    """Where no class band is left: of the pixels that any scene imaged, the share that this scene lacks. A pixel lacks
    if any band is missing and counts as imaged if any band is there."""
    lacks, there = F.lit(False), F.lit(False)
    for b in bands:
        lacks, there = lacks | F.col(b).isNull(), there | F.col(b).isNotNull()
    slim = pixels.select(key, "row", "col", lacks.alias("lacks"), there.alias("there"))
    ever = F.max("there").over(Window.partitionBy("row", "col"))
    marked = slim.withColumn("ever", ever)
    return marked.groupBy(key).agg(percent(F.count_if(F.col("ever") & F.col("lacks")), F.count_if("ever")).alias("cloud_percentage"))


def coverage_from_band(pixels: DataFrame, band: str, aoi_pixels: int, cloud: Column | None = None, key: str = "time") -> DataFrame:
    """Coverage by the first band: there, or hidden by a cloud."""
    there = F.col(band).isNotNull()
    there = there if cloud is None else there | cloud
    return pixels.groupBy(key).agg((F.count_if(there) / aoi_pixels).alias("scene_coverage"))


def ever_imaged(pixels: DataFrame, band: str) -> DataFrame:
    return pixels.groupBy("row", "col").agg(F.bool_or(F.col(band).isNotNull()).alias("ever"))


PERIOD_KEYS = ("band", "level", "start")


def _periods(day: str = "day") -> Column:
    """The day, month and year that a day belongs to, as rows: level 0, 1, 2 and first day."""
    starts = (F.col(day), F.trunc(day, "month"), F.trunc(day, "year"))
    return F.inline(F.array(*(F.struct(F.lit(k).alias("level"), c.alias("start")) for k, c in enumerate(starts))))


def _period_names() -> list[Column]:
    is_day, is_month = F.col("level") == 0, F.col("level") == 1
    label = F.when(is_day, F.date_format("start", "yyyy-MM-dd")).when(is_month, F.date_format("start", "MMMM_yyyy")).otherwise(F.date_format("start", "yyyy"))
    return [F.when(is_day, "date").when(is_month, "month").otherwise("year").alias("period"), label.alias("label")]


def _value_bin(v: Column, per_octave: int = 64) -> Column:
    """A whole number that grows with the value, in steps of about 1 %, whatever the range of the data."""
    size = lambda x: F.floor(F.log2(x) * per_octave).cast("long") + 2_000_000
    return F.when(v > 0, size(v)).when(v < 0, -size(-v)).otherwise(F.lit(0).cast("long"))


def _medians(long: DataFrame) -> DataFrame:
    """PERIOD_KEYS and the exact median, by counts instead of buffers of values.

    Values are counted by day and bin, the counts are rolled up to months and years, and running counts tell the one or
    two bins that hold the middle ranks. Only values of those bins are counted singly and ranked."""
    there = long.filter("value is not null").withColumn("bin", _value_bin(F.col("value")))
    counts = there.groupBy("band", "day", "bin").agg(F.count(F.lit(1)).alias("n"))
    rolled = counts.select("band", "bin", "n", _periods()).groupBy(*PERIOD_KEYS, "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*PERIOD_KEYS)
    upto, whole = F.sum("n").over(w.orderBy("bin")), F.sum("n").over(w)
    ranked = rolled.select(*PERIOD_KEYS, "bin", (upto - F.col("n")).alias("below"), upto.alias("upto"), whole.alias("whole"))
    lo, hi = F.floor((F.col("whole") - 1) / 2), F.floor(F.col("whole") / 2)
    wanted = ranked.withColumns({"lo": lo, "hi": hi}).filter("upto > lo and below <= hi").select(*PERIOD_KEYS, "bin", "below", "lo", "hi")
    # At most two rows for each band and calendar day, month or year: bounded by the calendar, not by pixels.
    middle = there.select("band", "bin", "value", _periods()).join(F.broadcast(wanted), [*PERIOD_KEYS, "bin"])
    singly = middle.groupBy(*PERIOD_KEYS, "value", "below", "lo", "hi").agg(F.count(F.lit(1)).alias("c"))
    upto = F.min("below").over(w) + F.sum("c").over(w.orderBy("value"))
    ends = singly.withColumn("upto", upto)
    holds = lambda rank: F.max(F.when((F.col("upto") > F.col(rank)) & (F.col("upto") - F.col("c") <= F.col(rank)), F.col("value")))
    return ends.groupBy(*PERIOD_KEYS).agg(((holds("lo") + holds("hi")) / 2).alias("median"))


def cube_statistics(pixels: DataFrame, bands: Sequence[str], stats: DataFrame | None = None, digits: int = 6, time: str = "time") -> DataFrame:
    """period, label, band, n_dates, mean, median, min, max, std (population), and the means of per-scene columns.

    Months and years are over all their pixels, not means of means: days are reduced to count, mean, variance and
    extremes, and those are merged. Bands are unfolded before grouping, after only the asked ones were read."""
    base = pixels.select(F.to_date(time).alias("day"), *(F.col(b).cast("double").alias(b) for b in bands))
    long = base.unpivot("day", list(bands), "band", "value")
    v = F.col("value")
    days = long.groupBy("band", "day").agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("s"), F.min(v).alias("min"), F.max(v).alias("max"))
    parts = days.select("band", "n", "m", "s", "min", "max", _periods())
    w = Window.partitionBy(*PERIOD_KEYS)
    n = F.nullif(F.sum("n").over(w), F.lit(0))
    parts = parts.withColumn("n_all", n).withColumn("mean", F.sum(F.col("n") * F.col("m")).over(w) / F.col("n_all"))
    around = F.col("n") * (F.col("s") + F.pow(F.col("m") - F.col("mean"), F.lit(2)))
    merged = parts.groupBy(*PERIOD_KEYS, "n_all", "mean").agg(F.count(F.lit(1)).cast("int").alias("n_dates"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum(around).alias("q"))
    out = merged.join(_medians(long), list(PERIOD_KEYS), "left")
    numbers = {"mean": F.col("mean"), "median": F.col("median"), "min": F.col("min"), "max": F.col("max"), "std": F.sqrt(F.col("q") / F.col("n_all"))}
    out = out.select(*_period_names(), "band", "n_dates", *(rounded(c, digits).alias(name) for name, c in numbers.items()))
    if stats is None:
        return out
    extra = [c for c in ("cloud_percentage", "scene_coverage") if c in stats.columns]
    labels = stats.select(F.to_date(time).alias("day"), *extra).select(*extra, _periods())
    means = labels.select(*_period_names(), *extra).groupBy("period", "label").agg(*(rounded(F.avg(c), digits).alias(c) for c in extra))
    return out.join(means, ["period", "label"], "left")


def rolling_mean(series: DataFrame, value: str, window: int = 7, order: str = "time", partition: Sequence[str] = ()) -> DataFrame:
    """Centred mean of ``window`` scenes; NULL where the window is not full."""
    half = window // 2
    w = (Window.partitionBy(*partition) if partition else Window.partitionBy()).orderBy(order).rowsBetween(-half, half)
    return series.withColumn(f"{value}_rolling", F.when(F.count(value).over(w) == window, F.avg(value).over(w)))


def second_difference(pixels: DataFrame, value: str, order: str = "time", partition: Sequence[str] = ("row", "col")) -> DataFrame:
    """abs(v[t-2] - 2 v[t-1] + v[t]) per pixel."""
    w = Window.partitionBy(*partition).orderBy(order)
    return pixels.withColumn("d2", F.abs(F.lag(value, 2).over(w) - F.lag(value, 1).over(w) * 2 + F.col(value)))


def edge_roughness(pixels: DataFrame, band: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean second difference over time on the tenth of pixels, of each group, with the steepest mean gradient."""
    at = [*by, "row", "col"]
    mean = pixels.groupBy(*at).agg(F.avg(band).alias("v"))
    right = mean.select(*by, F.col("row"), (F.col("col") - 1).alias("col"), F.col("v").alias("vr"))
    below = mean.select(*by, (F.col("row") - 1).alias("row"), F.col("col"), F.col("v").alias("vb"))
    grad = mean.join(right, at).join(below, at).select(*at, F.sqrt(F.pow(F.col("vr") - F.col("v"), 2) + F.pow(F.col("vb") - F.col("v"), 2)).alias("g"))
    cut = grad.groupBy(*by).agg(F.percentile("g", F.lit(0.9)).alias("p"))
    over = F.col("g") >= F.col("p")
    edges = (grad.join(cut, list(by)).filter(over) if by else grad.join(F.broadcast(cut), over)).select(*at)
    return second_difference(pixels.join(edges, at, "left_semi"), band, partition=at).agg(F.avg("d2").alias("roughness"))
