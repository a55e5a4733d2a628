"""Scene catalogues: selection, duplicates, footprints, availability."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scene as S
from ..functions.registry import SOURCE_LABELS
from ..functions.temporal import filter_dates, shrinking_probe, solar_day
from .coverage import Ring, feature_shares, union_share

#: Two eras may differ by this share of the AOI before the older one wins.
ERA_MARGIN = 0.02
GRAZING = 0.10


def typed(items: DataFrame) -> DataFrame:
    """Columns of ``items`` (item_id, source, collection, datetime, geometry rings, properties map)."""
    p = F.col("properties")
    return items.select(
        "item_id", "source", "collection", "datetime", "geometry", S.tile(p).alias("tile"), S.crs(p).alias("crs"), S.orbit_label(p).alias("orbit"),
        S.baseline(p).alias("baseline"), S.granule(p).alias("granule"), S.number(p, "eo:cloud_cover").alias("cloud_cover"), S.prop(p, "platform").alias("platform"),
        S.prop(p, "sat:orbit_state").alias("orbit_state"), S.view_azimuth(p).alias("view_azimuth"), S.sun_azimuth(p).alias("sun_azimuth"),
        S.sun_elevation(p).alias("sun_elevation"), S.incidence_angle(p).alias("incidence_angle"), S.relative_orbit(p).alias("relative_orbit"),
        solar_day(F.col("datetime"), S.longitude(F.col("geometry")[0])).alias("solar_day"),
    )


def per_day(scenes: DataFrame, day: Column, source: Column) -> DataFrame:
    return scenes.groupBy(day.alias("day"), source.alias("source")).agg(F.count(F.lit(1)).alias("n"))


def availability(scenes: DataFrame, sources: Sequence[str], failed: Sequence[str] = (), day: str = "day", source: str = "source") -> DataFrame:
    """Scenes per day and catalogue: 0 where none was found, NULL where the catalogue failed."""
    counts = scenes.groupBy(day).pivot(source, list(sources)).agg(F.count(F.lit(1)))
    labels = {s: SOURCE_LABELS.get(s, s) for s in [*sources, *failed]}
    return counts.select(day, *(F.coalesce(F.col(f"`{s}`"), F.lit(0)).cast("int").alias(labels[s]) for s in sources), *(F.lit(None).cast("int").alias(labels[s]) for s in failed)).orderBy(day)


def availability_totals(counts: DataFrame, sources: Sequence[str]) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("source"), F.col(f"`{s}`").alias("n")) for s in sources)))
    return counts.select(each.alias("e")).groupBy("e.source").agg(F.sum("e.n").alias("scenes"), F.count_if(F.col("e.n") > 0).alias("days"))


def missing_against(counts: DataFrame, best: str, other: str, day: str = "day") -> DataFrame:
    """Days that the best catalogue has and another lacks."""
    return counts.filter((F.col(f"`{best}`") > 0) & (F.coalesce(F.col(f"`{other}`"), F.lit(0)) == 0)).select(day)


def first_items(scenes: DataFrame, most: int = 200) -> DataFrame:
    """At most so many scenes, in order of time and id: enough to describe a mission that does not change."""
    return scenes.orderBy("datetime", "item_id").limit(most)


def newest_baseline(scenes: DataFrame, key: Sequence[str], baseline: str = "baseline", tie: str = "item_id") -> DataFrame:
    """Of each granule the item of the highest baseline, ties to the smallest id."""
    w = Window.partitionBy(*key).orderBy(F.desc_nulls_last(baseline), tie)
    return scenes.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def one_era_per_day(scenes: DataFrame, coverage: DataFrame, day: str = "day", baseline: str = "baseline") -> DataFrame:
    """Of a day's scenes those of one radiometric era: the newer, unless the older covers clearly more of the AOI.
    ``coverage``: (day, new_era boolean, share)."""
    pivoted = coverage.groupBy(day).agg(F.max(F.when(F.col("new_era"), F.col("share"))).alias("n"), F.max(F.when(~F.col("new_era"), F.col("share"))).alias("o"))
    choice = pivoted.select(day, F.when(F.col("n").isNull(), False).when(F.col("o").isNull(), True).otherwise(~(F.col("o") > F.col("n") + ERA_MARGIN)).alias("__new"))
    era = F.coalesce(F.col(baseline) >= 4.0, F.lit(False))
    return scenes.join(choice, day).filter(era == F.col("__new")).drop("__new")


def boxes_union_share(footprints: DataFrame, aoi: Sequence[float], key: Sequence[str]) -> DataFrame:
    """Share of an AOI box that a group's footprint boxes (x0, y0, x1, y1) cover together, exact, in column
    expressions only; area is taken in an equal-area projection, which for boxes is longitude by sine of latitude."""
    left, bottom, right, top = aoi
    within = lambda c, low, high: F.least(F.greatest(F.col(c), F.lit(float(low))), F.lit(float(high)))
    sine = lambda c: F.sin(F.radians(c))
    boxes = footprints.select(
        *key, within("x0", left, right).alias("x0"), within("x1", left, right).alias("x1"), sine(within("y0", bottom, top)).alias("y0"), sine(within("y1", bottom, top)).alias("y1")
    ).distinct()
    # The boxes' sides cut the AOI into strips; in a strip the intervals of the boxes over it are joined by a running end.
    sides = boxes.select(*key, F.explode(F.array("x0", "x1")).alias("left")).distinct()
    strips = sides.withColumn("right", F.lead("left").over(Window.partitionBy(*key).orderBy("left"))).filter("right is not null").alias("s")
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    over = strips.join(boxes.alias("b"), reduce(and_, [*same, F.col("x0") <= F.col("left"), F.col("x1") >= F.col("right"), F.col("y0") < F.col("y1")]))
    over = over.select(*(f"s.{k}" for k in key), "left", "right", "y0", "y1")
    end = F.max("y1").over(Window.partitionBy(*key, "left").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("y1") - F.greatest("y0", end), F.lit(0.0))
    area = over.select(*key, ((F.col("right") - F.col("left")) * new).alias("area")).unionByName(boxes.select(*key, F.lit(0.0).alias("area")))
    whole = (right - left) * (np.sin(np.radians(top)) - np.sin(np.radians(bottom)))
    return area.groupBy(*key).agg(F.least(F.lit(1.0), F.sum("area") / F.lit(float(whole))).alias("share"))


def ring_box(ring: Column) -> list[Column]:
    x, y = F.transform(ring, lambda q: q["x"]), F.transform(ring, lambda q: q["y"])
    return [F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1")]


def by_footprint(scenes: DataFrame, aoi: Sequence[Ring], least: float, key: Sequence[str] = ("solar_day",)) -> DataFrame:
    """Scenes of the groups whose footprints together cover ``least`` of the AOI (rings in degrees); scenes without
    outline or time always stay. If no group is left, an error says how much the best one covers."""
    known = scenes.filter(F.col("geometry").isNotNull() & F.col(key[-1]).isNotNull())
    share = union_share(known, aoi, key)
    groups, best, kept = share.agg(F.count(F.lit(1)), F.max("share"), F.count_if(F.col("share") >= least)).first()
    if groups and not kept:
        raise ValueError(f"no scene is left: the best of {groups} groups covers {best:.2%} of the area, {least:.2%} were asked for")
    dropped = share.filter(F.col("share") < least).select(*key)
    unknown = scenes.filter(F.col("geometry").isNull() | F.col(key[-1]).isNull())
    return known.join(dropped, list(key), "left_anti").unionByName(unknown)


def coverage_by_orbit(scenes: DataFrame, aoi: Sequence[Ring]) -> DataFrame:
    """``orbit_summary`` of the shares that the footprints of each orbit's dates cover."""
    return orbit_summary(union_share(scenes, aoi, ["orbit", "solar_day"]), scenes)


def coverage_by_feature(scenes: DataFrame, features: dict[object, Sequence[Ring]]) -> DataFrame:
    return feature_summary(feature_shares(scenes, features, ["orbit", "solar_day"]))


def orbit_summary(shares: DataFrame, scenes: DataFrame) -> DataFrame:
    """Per orbit: dates, average, best and worst share of a date, tiles, systems; best average first, unknown last.
    ``shares``: (orbit, solar_day, share)."""
    tiles = scenes.groupBy("orbit").agg(F.sort_array(F.collect_set("tile")).alias("tiles"), F.sort_array(F.collect_set("crs")).alias("crs"))
    per = shares.groupBy("orbit").agg(F.count_distinct("solar_day").alias("dates"), F.avg("share").alias("average"), F.max("share").alias("best"), F.min("share").alias("worst"))
    return per.join(tiles, "orbit").orderBy(F.desc_nulls_last("average"), S.orbit_order(F.col("orbit")))


def feature_summary(shares: DataFrame) -> DataFrame:
    """Per AOI feature, of the dates that reach it: dates, orbits, shares, how many only graze it, and the orbits that
    never reach it. A feature that none reaches has no dates. ``shares``: (feature_id, orbit, solar_day, share)."""
    hit = F.col("share") > 0
    per = shares.groupBy("feature_id", "orbit").agg(F.max("share").alias("best"))
    orbits = per.groupBy("feature_id").agg(F.sort_array(F.collect_list(F.when(F.col("best") > 0, F.col("orbit")))).alias("orbits"), F.sort_array(F.collect_list(F.when(F.col("best") <= 0, F.col("orbit")))).alias("unreached"))
    found = shares.groupBy("feature_id").agg(
        F.count_distinct(F.when(hit, F.col("solar_day"))).alias("dates"), F.avg(F.when(hit, F.col("share"))).alias("average"), F.max(F.when(hit, F.col("share"))).alias("best"),
        F.min(F.when(hit, F.col("share"))).alias("worst"), F.count_if(hit & (F.col("share") < GRAZING)).alias("grazing"),
    )
    return found.join(orbits, "feature_id")


def findings(dates: int, average: float | None, best: float | None, orbits: int, partial: float = 0.9) -> list[str]:
    """What a summary means, in words."""
    if not dates or average is None:
        return ["No scene reaches the area."]
    out = []
    if best is not None and best < 0.995:
        out.append(f"No single date covers the whole area; the best covers {best:.0%}.")
    if average < partial:
        out.append(f"Dates cover {average:.0%} on average; consider a least coverage.")
    if orbits > 1:
        out.append(f"{orbits} orbits see the area at different times and angles.")
    return out or ["Every date covers the area."]


def native_crs(scenes: DataFrame, user_crs: str | None = None, preferred: str | None = None) -> DataFrame:
    """The system to build in: the user's, else that of the largest share of the AOI (crs, share), ties to the AOI's own
    zone, then by name."""
    if user_crs:
        return scenes.sparkSession.createDataFrame([(user_crs, None)], "crs string, share double")
    return scenes.orderBy(F.desc(F.round("share", 3)), F.col("crs") != F.lit(preferred or ""), "crs").limit(1)


def crs_counts(scenes: DataFrame) -> DataFrame:
    per = scenes.filter("crs is not null").groupBy("crs").agg(F.count(F.lit(1)).alias("scenes"))
    return per.withColumn("share", F.col("scenes") / F.sum("scenes").over(Window.partitionBy()))


def probe(scenes: DataFrame, first: str | None, last: str, days: int = 14, time: str = "datetime") -> DataFrame:
    """Scenes of a short window at the end of a range; where it has none, of a window four, then twelve times as long,
    never before ``first``. What is fixed by the tiles (systems, outlines) is found without scanning the whole range:
    each probe is a filter that reaches the scan and stops at the first scene."""
    for window in shrinking_probe(first, last, days):
        found = filter_dates(scenes, [window], time)
        if not found.isEmpty():
            return found
    return scenes.limit(0)


def native_crs_probe(scenes: DataFrame, first: str | None, last: str, aoi: Sequence[Ring] | None = None, days: int = 14) -> DataFrame:
    """(crs, scenes, share) of a probe, best first: the share is that of the AOI that a system's footprints cover, or
    without an AOI that of the scenes."""
    found = probe(scenes, first, last, days).filter("crs is not null")
    counts = crs_counts(found)
    if aoi is not None:
        counts = counts.drop("share").join(union_share(found, aoi, ["crs"]), "crs", "left")
    return counts.orderBy(F.desc(F.round(F.coalesce("share", F.lit(0.0)), 3)), "crs")


def representative_footprints(scenes: DataFrame, area: Column) -> DataFrame:
    """Per system and tile the footprint of largest area."""
    return scenes.withColumn("__a", area).groupBy("crs", "tile").agg(F.max_by("geometry", "__a").alias("geometry"), F.max("__a").alias("area"))
