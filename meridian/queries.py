"""Registered queries: one or more for each operator, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views as V
from .functions import radiometry as R
from .functions import temporal as T
from .functions.expr import rounded
from .functions.indices import index
from .operators import coverage as CO
from .operators import composites as C
from .operators import coregistration as G
from .operators import filters as FI
from .operators import grid as GR
from .operators import joins as J
from .operators import masks as M
from .operators import mosaic as MO
from .operators import neighbourhood as N
from .operators import resample as RS
from .operators import scenes as SC
from .operators import statistics as ST
from .operators import update as U

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
L2A = "sentinel_2_l2a"
TYPED = "CAST(time AS DATE)"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE[key] = sql
        return f

    return add


def r6(x: str) -> str:
    return f"round({x} + 1e-9, 6)"


def nd(a: str, b: str) -> str:
    d = f"({a} - {b}) / nullif({a} + {b}, 0)"
    return f"CASE WHEN {d} IS NOT NULL THEN greatest(-1.0, least(1.0, {d})) END"


# Projections --------------------------------------------------------------------------------------------------------

CLEAR = "scl NOT IN (0, 8, 9, 10)"


@query(f"""WITH {V.PX} SELECT strftime(time, '%Y-%m') AS month, {r6(f"avg({nd('nir', 'red')})")} AS ndvi_mean,
    {r6(f"median({nd('nir', 'red')})")} AS ndvi_median, count({nd('nir', 'red')}) AS n_valid FROM px WHERE {CLEAR} GROUP BY 1""")
def ndvi_monthly_composite(spark, sf):
    px = M.class_mask(V.pixels(spark, sf), L2A, V.BANDS)
    v = px.select(F.date_format("time", "yyyy-MM").alias("month"), index("ndvi", px.columns).alias("v")).filter("v is not null")
    return v.groupBy("month").agg(rounded(F.avg("v")).alias("ndvi_mean"), rounded(F.median("v")).alias("ndvi_median"), F.count("v").alias("n_valid"))


_SQL_INDEX = {
    "ndvi": nd("nir", "red"), "ndwi": nd("green", "nir"), "ndmi": nd("nir", "swir16"), "nbr": nd("nir", "swir22"), "mndwi": nd("green", "swir16"),
    "ndsi": nd("green", "swir16"), "ndbi": nd("swir16", "nir"), "ndre1": nd("nir", "rededge1"), "savi": "1.5 * (nir - red) / nullif(nir + red + 0.5, 0)",
    "evi": "2.5 * (nir - red) / nullif(nir + 6 * red - 7.5 * blue + 1, 0)",
}


def _index_query(which: str):
    def run(spark, sf):
        px = V.pixels(spark, sf)
        return px.groupBy("row", "col").agg(*(rounded(f(index(which, px.columns))).alias(n) for n, f in (("mean", F.avg), ("low", F.min), ("high", F.max))), F.count(index(which, px.columns)).alias("n"))

    e = _SQL_INDEX[which]
    query(f'WITH {V.PX}, v AS (SELECT "row", col, {e} AS v FROM px) SELECT "row", col, {r6("avg(v)")} AS mean, {r6("min(v)")} AS low, {r6("max(v)")} AS high, count(v) AS n FROM v GROUP BY 1, 2', f"idx_{which}")(run)


for _name in _SQL_INDEX:
    _index_query(_name)


@query(f"""WITH {V.PX} SELECT "row", col, {r6("avg(red / nullif(nir, 0))")} AS vh_vv, {r6("avg(nir / nullif(red, 0))")} AS vv_vh,
    {r6("avg(4 * red / nullif(red + nir, 0))")} AS rvi FROM px GROUP BY 1, 2""")
def idx_radar(spark, sf):
    px = V.pixels(spark, sf).withColumnsRenamed({"red": "vh", "nir": "vv"})
    return px.groupBy("row", "col").agg(*(rounded(F.avg(index(n, px.columns))).alias(a) for n, a in (("vh/vv", "vh_vv"), ("vv/vh", "vv_vh"), ("rvi", "rvi"))))


@query(f"""WITH {V.PX}, v AS (SELECT "row", CASE WHEN l = 0 THEN NULL WHEN time >= TIMESTAMP '1998-01-25' THEN (l - 1000) * 1e-4 ELSE l * 1e-4 END AS v
    FROM (SELECT *, floor(nir * 10000) AS l FROM px)) SELECT "row", {r6("avg(v)")} AS mean, {r6("min(v)")} AS low, count(v) AS n FROM v GROUP BY 1""")
def scale_l2a_cutoff(spark, sf):
    # The supplied dates end before the archive's day of change, so they are moved on by 24 years.
    px = V.pixels(spark, sf).select("row", F.floor(F.col("nir") * 10000).alias("dn"), (F.col("time") + F.make_ym_interval(F.lit(24))).alias("time"))
    v = px.select("row", R.scaled(F.col("dn"), L2A, "planetary_computer", F.col("time")).alias("v"))
    return v.groupBy("row").agg(rounded(F.avg("v")).alias("mean"), rounded(F.min("v")).alias("low"), F.count("v").alias("n"))


@query(f"""WITH {V.PX}, v AS (SELECT "row", CASE WHEN 2.0 + qa % 4 >= 4 THEN (l - 1000) / 10000 ELSE l / 10000 END AS v
    FROM (SELECT *, floor(nir * 10000) AS l FROM px)) SELECT "row", {r6("avg(v)")} AS mean, {r6("max(v)")} AS high FROM v GROUP BY 1""")
def scale_l1c_baseline(spark, sf):
    px = V.pixels(spark, sf).select("row", F.floor(F.col("nir") * 10000).alias("dn"), (F.lit(2.0) + F.col("qa") % 4).alias("b"))
    v = px.select("row", R.scaled(F.col("dn"), "sentinel_2_l1c", baseline=F.col("b")).alias("v"))
    return v.groupBy("row").agg(rounded(F.avg("v")).alias("mean"), rounded(F.max("v")).alias("high"))


@query(f"""WITH {V.PX} SELECT "row", {r6("avg((floor(nir * 10000) - 1000) * 1e-4)")} AS cdse, {r6("avg(floor(nir * 10000) * 1e-4)")} AS element84,
    {r6("avg((floor(nir * 10000) - 0.2) * 0.0000275)")} AS landsat FROM px WHERE floor(nir * 10000) <> 0 GROUP BY 1""")
def scale_by_source(spark, sf):
    dn = F.floor(F.col("nir") * 10000)
    v = V.pixels(spark, sf).filter(dn != 0).select("row", R.scaled(dn, L2A, "cdse").alias("c"), R.scaled(dn, L2A, "element84").alias("e"), R.scaled(dn, "landsat_c2_l2").alias("l"))
    return v.groupBy("row").agg(rounded(F.avg("c")).alias("cdse"), rounded(F.avg("e")).alias("element84"), rounded(F.avg("l")).alias("landsat"))


@query(f"""WITH {V.PX} SELECT qa, count(*) AS n, count(*) FILTER (WHERE ((qa >> 1) & 1) = 1 OR ((qa >> 2) & 1) = 1 OR ((qa >> 3) & 1) = 1) AS cloud,
    count(*) FILTER (WHERE qa <> 0 AND (qa & 1) = 0) AS imaged FROM px GROUP BY 1""")
def qa_bits(spark, sf):
    cloud, imaged = M.cloud_and_imaged(F.col("qa"), "landsat_c2_l2")
    return V.pixels(spark, sf).groupBy("qa").agg(F.count(F.lit(1)).alias("n"), F.count_if(cloud).alias("cloud"), F.count_if(imaged).alias("imaged"))


@query(f"""WITH {V.PX} SELECT "row", count(nullif(qa, 0)) AS n_valid, {r6("avg(nullif(qa, 0) * 1e-4)")} AS mean FROM px GROUP BY 1""")
def nodata_nullif(spark, sf):
    v = V.pixels(spark, sf).select("row", R.scaled(F.col("qa"), L2A).alias("v"))
    return v.groupBy("row").agg(F.count("v").alias("n_valid"), rounded(F.avg("v")).alias("mean"))


@query(f"""WITH {V.PX}, c AS (SELECT month(time) AS m, quantile_cont(nir, 0.02) AS lo, quantile_cont(nir, 0.98) AS hi FROM px GROUP BY 1)
    SELECT m, CAST(CASE WHEN hi <= lo THEN 0 ELSE floor(greatest(0.0, least(1.0, (nir - lo) / (hi - lo))) * 255 + 0.5) END AS SMALLINT) AS grey, count(*) AS n
    FROM px JOIN c ON month(time) = m GROUP BY 1, 2""")
def stretch_uint8(spark, sf):
    px = V.pixels(spark, sf).select(F.month("time").alias("m"), "nir")
    return R.stretch_uint8(px, ["m"], ["nir"]).groupBy("m", F.col("nir").alias("grey")).agg(F.count(F.lit(1)).alias("n"))


# Catalogue ----------------------------------------------------------------------------------------------------------


@query(f"WITH {V.SCENES} SELECT item_id, tile, cloud_cover FROM sc WHERE cloud_cover BETWEEN 0 AND 20 AND datetime >= TIMESTAMP '1997-01-01' AND datetime < TIMESTAMP '1998-01-01'")
def catalogue_scan(spark, sf):
    s = T.filter_dates(V.scenes(spark, sf), [("1997-01-01", "1997-12-31")], "datetime")
    return FI.cloud_cover(s, 20).select("item_id", "tile", "cloud_cover")


@query(f"WITH {V.SCENES} SELECT CAST(datetime AS DATE) AS day, source, count(*) AS n FROM sc GROUP BY 1, 2")
def scenes_per_day(spark, sf):
    return SC.per_day(V.scenes(spark, sf), F.to_date("datetime"), F.col("source"))


_AVAIL = f"""{V.SCENES}, av AS (SELECT CAST(datetime AS DATE) AS day, CAST(count(*) FILTER (WHERE source = 'F') AS INT) AS F,
    CAST(count(*) FILTER (WHERE source = 'O') AS INT) AS O, CAST(count(*) FILTER (WHERE source = 'P') AS INT) AS P FROM sc GROUP BY 1)"""


def _availability(spark, sf):
    return SC.availability(V.scenes(spark, sf).withColumn("day", F.to_date("datetime")), ["F", "O", "P"])


@query(f"WITH {_AVAIL} SELECT day, F, O, P FROM av")
def availability_pivot(spark, sf):
    return _availability(spark, sf)


@query(f"WITH {_AVAIL} SELECT 'F' AS source, CAST(sum(F) AS BIGINT) AS scenes, count(*) FILTER (WHERE F > 0) AS days FROM av UNION ALL SELECT 'O', CAST(sum(O) AS BIGINT), count(*) FILTER (WHERE O > 0) FROM av UNION ALL SELECT 'P', CAST(sum(P) AS BIGINT), count(*) FILTER (WHERE P > 0) FROM av")
def availability_totals(spark, sf):
    return SC.availability_totals(_availability(spark, sf), ["F", "O", "P"])


@query(f"WITH {_AVAIL} SELECT day FROM av WHERE F > 0 AND P = 0")
def best_catalogue_missing(spark, sf):
    return SC.missing_against(_availability(spark, sf), "F", "P")


@query(f"WITH {V.SCENES} SELECT day, tile, item_id, baseline FROM (SELECT CAST(datetime AS DATE) AS day, tile, item_id, baseline, row_number() OVER (PARTITION BY CAST(datetime AS DATE), tile ORDER BY baseline DESC, item_id) AS k FROM sc) WHERE k = 1")
def dedup_max_baseline(spark, sf):
    s = V.scenes(spark, sf).select(F.to_date("datetime").alias("day"), "tile", "item_id", "baseline")
    return SC.newest_baseline(s, ["day", "tile"])


@query(f"""WITH {V.SCENES}, d AS (SELECT CAST(datetime AS DATE) AS day, baseline >= 4 AS new_era, count(*) / 10.0 AS share FROM sc GROUP BY 1, 2),
    c AS (SELECT day, max(share) FILTER (WHERE new_era) AS n, max(share) FILTER (WHERE NOT new_era) AS o FROM d GROUP BY 1),
    k AS (SELECT day, CASE WHEN n IS NULL THEN FALSE WHEN o IS NULL THEN TRUE ELSE NOT (o > n + 0.02) END AS w FROM c)
    SELECT item_id, CAST(datetime AS DATE) AS day, baseline FROM sc JOIN k ON CAST(datetime AS DATE) = day AND (baseline >= 4) = w""")
def dedup_one_era_per_day(spark, sf):
    s = V.scenes(spark, sf).select("item_id", F.to_date("datetime").alias("day"), "baseline")
    share = s.groupBy("day", (F.col("baseline") >= 4).alias("new_era")).agg((F.count(F.lit(1)) / 10.0).alias("share"))
    return SC.one_era_per_day(s, share).select("item_id", "day", "baseline")


@query(f"""WITH {V.SCENES} SELECT CAST(datetime AS DATE) AS day, {r6("avg(sun_azimuth)")} AS sun_azimuth, min(lon) AS low, arg_min(baseline, item_id) AS baseline FROM sc GROUP BY 1""")
def scene_metadata_daily(spark, sf):
    s = V.scenes(spark, sf)
    out = J.daily_metadata(s, {"sun_azimuth": (F.col("sun_azimuth"), "avg"), "baseline": (F.col("baseline"), "first")}, F.to_date("datetime"))
    low = s.groupBy(F.to_date("datetime").alias("day")).agg(F.min("lon").alias("low"))
    return out.join(low, "day").select("day", rounded(F.col("sun_azimuth")).alias("sun_azimuth"), "low", "baseline")


@query(f"WITH {V.SCENES} SELECT item_id, CAST(datetime + to_hours(CAST(trunc(lon / 15) AS INT)) AS DATE) AS solar_day FROM sc")
def solar_day(spark, sf):
    return V.scenes(spark, sf).select("item_id", T.solar_day(F.col("datetime"), F.col("lon")).alias("solar_day"))


@query(f"WITH {V.SCENES}, c AS (SELECT tile AS crs, count(*) AS scenes FROM sc GROUP BY 1) SELECT crs, scenes, {r6('scenes / (SELECT sum(scenes) FROM c)')} AS share FROM c")
def native_crs_share(spark, sf):
    return SC.crs_counts(V.scenes(spark, sf).withColumnRenamed("tile", "crs")).withColumn("share", rounded(F.col("share")))


@query(f"""WITH {V.SCENES}, c AS (SELECT tile AS crs, count(*) AS scenes FROM sc WHERE datetime >= TIMESTAMP '2001-07-18' AND datetime < TIMESTAMP '2001-09-13' GROUP BY 1)
    SELECT crs, scenes, {r6('scenes / (SELECT sum(scenes) FROM c)')} AS share FROM c""")
def native_crs_probe(spark, sf):
    """The fortnight before 2001-09-12 has no scene; the window four times as long has."""
    s = V.scenes(spark, sf).withColumnRenamed("tile", "crs")
    return SC.native_crs_probe(s, "1995-01-01", "2001-09-12").select("crs", "scenes", rounded(F.col("share")).alias("share"))


@query(f"WITH {V.SCENES}, c AS (SELECT tile AS crs, count(*) / (SELECT count(*) FROM sc) AS share FROM sc GROUP BY 1) SELECT crs FROM c ORDER BY round(share, 3) DESC, crs <> '1-URGENT', crs LIMIT 1")
def crs_choice(spark, sf):
    c = SC.crs_counts(V.scenes(spark, sf).withColumnRenamed("tile", "crs"))
    return SC.native_crs(c, preferred="1-URGENT").select("crs")


@query(f"""WITH {V.SCENES}, s AS (SELECT tile AS orbit, CAST(datetime AS DATE) AS d, avg(cloud_cover) / 100 AS share FROM sc GROUP BY 1, 2)
    SELECT orbit, count(DISTINCT d) AS dates, {r6("avg(share)")} AS average, {r6("max(share)")} AS best, {r6("min(share)")} AS worst FROM s GROUP BY 1""")
def orbit_summary(spark, sf):
    s = V.scenes(spark, sf).withColumnRenamed("tile", "orbit").withColumns({"tile": F.col("source"), "crs": F.col("source")})
    shares = s.groupBy("orbit", F.to_date("datetime").alias("solar_day")).agg((F.avg("cloud_cover") / 100).alias("share"))
    return SC.orbit_summary(shares, s).select("orbit", "dates", *(rounded(F.col(c)).alias(c) for c in ("average", "best", "worst")))


@query(f"""WITH {V.SCENES}, s AS (SELECT item_id % 7 AS feature_id, tile AS orbit, CAST(datetime AS DATE) AS d, avg(cloud_cover) / 100 AS share FROM sc GROUP BY 1, 2, 3)
    SELECT feature_id, count(DISTINCT d) AS dates, {r6("avg(share)")} AS average, {r6("max(share)")} AS best, count(*) FILTER (WHERE share < 0.1) AS grazing FROM s WHERE share > 0 GROUP BY 1""")
def feature_summary(spark, sf):
    s = V.scenes(spark, sf)
    shares = s.groupBy((F.col("item_id") % 7).alias("feature_id"), F.col("tile").alias("orbit"), F.to_date("datetime").alias("solar_day")).agg((F.avg("cloud_cover") / 100).alias("share"))
    return SC.feature_summary(shares).select("feature_id", "dates", rounded(F.col("average")).alias("average"), rounded(F.col("best")).alias("best"), "grazing")


@query("""WITH b AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS solar_day, o_orderkey % 13 AS x, o_orderkey % 7 AS y FROM orders),
    hit AS (SELECT DISTINCT solar_day, i, j FROM b JOIN range(10) c(i) ON i >= x AND i < x + 5 JOIN range(10) r(j) ON j >= y AND j < y + 5),
    sh AS (SELECT solar_day, sum(0.1 * (sin(radians((j + 1) / 10.0)) - sin(radians(j / 10.0)))) / sin(radians(1.0)) AS share FROM hit GROUP BY 1)
    SELECT solar_day, round(coalesce(share, 0) + 1e-9, 6) AS share, round(coalesce(share, 0) + 1e-9, 6) >= 0.5 AS kept FROM (SELECT DISTINCT solar_day FROM b) LEFT JOIN sh USING (solar_day)""")
def footprint_prefilter(spark, sf):
    """Boxes by scene over an AOI of one degree: days whose footprints cover half of it, held against cells of a tenth."""
    s = V.scenes(spark, sf).select("item_id", F.to_date("datetime").alias("solar_day"), ((F.col("item_id") % 13) / 10.0).alias("x0"), ((F.col("item_id") % 7) / 10.0).alias("y0"))
    boxes = s.withColumns({"x1": F.col("x0") + 0.5, "y1": F.col("y0") + 0.5})
    share = SC.boxes_union_share(boxes, (0.0, 0.0, 1.0, 1.0), ["solar_day"]).withColumn("share", rounded(F.col("share")))
    return share.select("solar_day", "share", (F.col("share") >= 0.5).alias("kept"))


def _authalic(degrees: float) -> str:
    """An equal-area height on WGS84, in SQL, by the formula of the projection."""
    e, x = "sqrt((2 - 1 / 298.257223563) / 298.257223563)", f"sin(radians({degrees}))"
    return f"((1 - {e} * {e}) * ({x} / (1 - {e} * {e} * {x} * {x}) - ln((1 - {e} * {x}) / (1 + {e} * {x})) / (2 * {e})) / 2)"


#: Squares turned by 45 degrees, their corners 0.8 degrees from a centre on the equator, whose longitude a scene's number gives.
_TURNED = f"""s AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS solar_day, o_orderpriority AS orbit, (o_orderkey % 211) / 100.0 AS x FROM orders),
    g AS (SELECT *, x - lag(x) OVER (PARTITION BY solar_day, orbit ORDER BY x) AS gap FROM s),
    sh AS (SELECT solar_day, orbit, sum(1 - CASE WHEN gap IS NULL THEN 0 ELSE pow(greatest(0, 1 - gap / 1.6), 2) END) * 2 * 0.8 * {_authalic(0.8)} / (4.0 * 2 * {_authalic(1.0)}) AS share FROM g GROUP BY 1, 2)"""


def _turned(spark, sf):
    """Scenes with turned squares as outlines, and an AOI that holds them all."""
    x, square = (F.col("item_id") % 211) / 100.0, ((-0.8, 0.0), (0.0, -0.8), (0.8, 0.0), (0.0, 0.8), (-0.8, 0.0))
    ring = F.array(*(F.struct((x + dx).alias("x"), F.lit(dy).alias("y")) for dx, dy in square))
    s = V.scenes(spark, sf).select("item_id", F.to_date("datetime").alias("solar_day"), F.col("tile").alias("orbit"), F.col("source").alias("tile"), F.col("source").alias("crs"), F.array(ring).alias("geometry"))
    return s, [[(-0.9, -1.0), (3.1, -1.0), (3.1, 1.0), (-0.9, 1.0)]]


@query(f"WITH {_TURNED} SELECT solar_day, orbit, round(share + 1e-9, 6) AS share FROM sh")
def footprint_union(spark, sf):
    """Of each date of an orbit, how much of the AOI its turned outlines cover together."""
    s, aoi = _turned(spark, sf)
    share = CO.union_share(s, aoi, ["solar_day", "orbit"])
    return share.select("solar_day", "orbit", rounded(F.col("share")).alias("share"))


@query(f"""WITH {_TURNED} SELECT orbit, count(*) AS dates, {r6("avg(share)")} AS average, {r6("max(share)")} AS best, {r6("min(share)")} AS worst FROM sh GROUP BY 1""")
def orbit_coverage(spark, sf):
    s, aoi = _turned(spark, sf)
    return SC.coverage_by_orbit(s, aoi).select("orbit", "dates", *(rounded(F.col(c)).alias(c) for c in ("average", "best", "worst")))


@query(f"""WITH {_TURNED}, d AS (SELECT solar_day, orbit, x FROM s), f(feature_id, lo, hi) AS (VALUES ('west', -0.795, 0.405), ('east', 1.005, 2.005), ('far', 20.0, 21.0)),
    m AS (SELECT feature_id, solar_day, orbit, max(CASE WHEN x + 0.8 > lo AND x - 0.8 < hi THEN 1 ELSE 0 END) AS hit FROM d, f GROUP BY 1, 2, 3), o AS (SELECT feature_id, orbit, max(hit) AS hit FROM m GROUP BY 1, 2)
    SELECT feature_id, count(DISTINCT CASE WHEN hit = 1 THEN solar_day END) AS dates, (SELECT count(*) FILTER (WHERE o.hit = 1) FROM o WHERE o.feature_id = m.feature_id) AS orbits,
        (SELECT count(*) FILTER (WHERE o.hit = 0) FROM o WHERE o.feature_id = m.feature_id) AS unreached FROM m GROUP BY feature_id""")
def feature_coverage(spark, sf):
    """Which dates and orbits reach each of three areas on the equator, one of which none reaches."""
    s, _ = _turned(spark, sf)
    boxes = {"west": (-0.795, 0.405), "east": (1.005, 2.005), "far": (20.0, 21.0)}
    out = SC.coverage_by_feature(s, {k: [CO.box_ring((a, -0.01, b, 0.01))] for k, (a, b) in boxes.items()})
    return out.select("feature_id", "dates", F.size("orbits").cast("long").alias("orbits"), F.size("unreached").cast("long").alias("unreached"))


# Time ---------------------------------------------------------------------------------------------------------------


@query(f"""WITH {V.PX} SELECT {TYPED} AS day, count(*) AS n FROM px WHERE time >= TIMESTAMP '1996-03-01' AND time < TIMESTAMP '1996-06-01' GROUP BY 1""")
def daterange_window(spark, sf):
    return T.filter_dates(V.pixels(spark, sf), [("1996-03-01", "1996-05-31")]).groupBy(F.to_date("time").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {V.PX}, s AS (SELECT *, CASE WHEN strftime(time, '%m-%d') >= '11-15' THEN year(time) WHEN strftime(time, '%m-%d') <= '02-28' THEN year(time) - 1 END AS season FROM px)
    SELECT CAST(season AS INT) AS season, count(*) AS n, {r6("avg(nir)")} AS nir FROM s WHERE season IS NOT NULL GROUP BY 1""")
def season_cross_year(spark, sf):
    y = T.season_year(F.col("time"), "11-15", "02-28")
    return V.pixels(spark, sf).withColumn("season", y).filter("season is not null").groupBy("season").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("nir")).alias("nir"))


@query(f"""WITH {V.PX} SELECT count(*) AS n, count(DISTINCT {TYPED}) AS days FROM px WHERE {TYPED} IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_custkey % 101 <= 10)""")
def dates_keep_semi(spark, sf):
    """Pixels of the days for which the catalogue has a clear scene."""
    d = V.scenes(spark, sf).filter("cloud_cover <= 10").select(F.col("datetime").alias("time"))
    return FI.keep_dates(V.pixels(spark, sf), d).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.to_date("time")).alias("days"))


@query(f"""WITH {V.PX} SELECT DISTINCT {TYPED} AS day FROM px WHERE {TYPED} NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_custkey % 101 <= 25)""")
def missing_dates_anti(spark, sf):
    """Days of the cube for which the catalogue has no scene of at most 25 % cloud."""
    return FI.missing_dates(V.pixels(spark, sf), V.scenes(spark, sf).filter("cloud_cover <= 25").select(F.col("datetime").alias("time")))


_OPS = {"mean": "avg", "median": "median", "min": "min", "max": "max", "std": "stddev_pop"}


def _composite(period: str, label: str):
    parts = [f"""SELECT concat_ws('_', '{op}', {label}) AS layer, "row", col, {r6(f"{f}(red)")} AS red, {r6(f"{f}(nir)")} AS nir FROM px GROUP BY {label}, "row", col""" for op, f in _OPS.items()]

    def run(spark, sf):
        out = C.composites(V.pixels(spark, sf), ["red", "nir"], [f"{op}_{period}" for op in _OPS])
        return out.select("layer", "row", "col", rounded(F.col("red")).alias("red"), rounded(F.col("nir")).alias("nir"))

    query(f"WITH {V.PX} " + " UNION ALL ".join(parts), f"composite_{period}")(run)


_composite("timeseries", "'timeseries'")
_composite("annual", "strftime(time, '%Y')")
_composite("monthly", "strftime(time, '%m_%Y')")


@query(f"""WITH {V.PX} SELECT 'median_19960301_19960831' AS layer, "row", col, {r6("median(nir)")} AS nir, count(DISTINCT {TYPED}) AS n_dates FROM px
    WHERE time >= TIMESTAMP '1996-03-01' AND time < TIMESTAMP '1996-09-01' GROUP BY 2, 3""")
def composite_custom_window(spark, sf):
    out = C.custom_composite(V.pixels(spark, sf), ["nir"], C.Custom("median", "1996-03-01", "1996-08-31"))
    return out.withColumn("nir", rounded(F.col("nir")))


@query(f"""WITH {V.PX}, s AS (SELECT *, CASE WHEN strftime(time, '%m-%d') >= '12-01' THEN year(time) WHEN strftime(time, '%m-%d') <= '02-28' THEN year(time) - 1 END AS y FROM px)
    SELECT concat('winter_', y) AS layer, "row", col, {r6("avg(nir)")} AS nir, count(DISTINCT {TYPED}) AS n_dates FROM s WHERE y IN (1996, 1997, 1998, 2050) GROUP BY 1, 2, 3""")
def composite_season_by_year(spark, sf):
    out = C.custom_composite(V.pixels(spark, sf), ["nir"], C.Custom("mean", "12-01", "02-28", (1996, 1997, 1998, 2050), "winter"))
    return out.withColumn("nir", rounded(F.col("nir")))


# Scene statistics ---------------------------------------------------------------------------------------------------

_STATS = f"""{V.PX}, st AS (SELECT time, CAST(coalesce(floor(100.0 * count(*) FILTER (WHERE scl IN (8, 9, 10)) / nullif(count(*) FILTER (WHERE scl <> 0), 0) + 0.5), 0) AS SMALLINT) AS cloud_percentage,
    count(*) FILTER (WHERE scl <> 0) / 64 AS scene_coverage, count(*) FILTER (WHERE scl <> 0) AS n_imaged FROM px GROUP BY 1)"""


def _stats(spark, sf):
    cloud, imaged = M.cloud_and_imaged(F.col("scl"), L2A)
    return ST.scene_statistics(V.pixels(spark, sf), cloud, imaged, 64)


@query(f"WITH {_STATS} SELECT time, cloud_percentage, n_imaged FROM st")
def cloud_percentage(spark, sf):
    return _stats(spark, sf).select("time", "cloud_percentage", "n_imaged")


@query(f"WITH {_STATS} SELECT time, {r6('scene_coverage')} AS scene_coverage FROM st")
def scene_coverage(spark, sf):
    return _stats(spark, sf).select("time", rounded(F.col("scene_coverage")).alias("scene_coverage"))


@query(f"""WITH {V.CUBE}, m AS (SELECT time, "row", col, CASE WHEN {CLEAR} THEN red END AS red, CASE WHEN {CLEAR} THEN nir END AS nir FROM cube),
    e AS (SELECT *, max(red IS NOT NULL OR nir IS NOT NULL) OVER (PARTITION BY "row", col) AS ever FROM m)
    SELECT time, CAST(coalesce(floor(100.0 * count(*) FILTER (WHERE ever AND (red IS NULL OR nir IS NULL)) / nullif(count(*) FILTER (WHERE ever), 0) + 0.5), 0) AS SMALLINT) AS cloud_percentage FROM e GROUP BY 1""")
def cloud_percentage_from_missing(spark, sf):
    return ST.cloud_percentage_from_missing(M.class_mask(V.cube(spark, sf), L2A, ["red", "nir"]), ["red", "nir"])


@query(f"WITH {_STATS} SELECT time, count(*) AS n FROM px WHERE time IN (SELECT time FROM st WHERE cloud_percentage <= 20) GROUP BY 1")
def cloud_filter(spark, sf):
    return FI.keep_scenes(V.pixels(spark, sf), FI.by_cloud(_stats(spark, sf), 20)).groupBy("time").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_STATS} SELECT time, count(*) AS n FROM px WHERE time IN (SELECT time FROM st WHERE scene_coverage >= (SELECT avg(scene_coverage) FROM st)) GROUP BY 1")
def partial_scene_filter(spark, sf):
    """Scenes that cover as much as the mean scene: how much a scene covers grows with the table."""
    stats = _stats(spark, sf)
    least = stats.agg(F.avg("scene_coverage")).first()[0]
    return FI.keep_scenes(V.pixels(spark, sf), FI.by_coverage(stats, least)).groupBy("time").agg(F.count(F.lit(1)).alias("n"))


def _grouping(period: str, label: str, group: str) -> str:
    return f"SELECT '{period}' AS period, {label} AS label, band, CAST(count(DISTINCT day) AS INT) AS n_dates, {r6('avg(v)')} AS mean, {r6('median(v)')} AS median, {r6('min(v)')} AS min, {r6('max(v)')} AS max, {r6('stddev_pop(v)')} AS std FROM lo GROUP BY {group}, band"


@query(
    f"WITH {V.PX}, lo AS (SELECT CAST(time AS DATE) AS day, 'red' AS band, red AS v FROM px UNION ALL SELECT CAST(time AS DATE), 'nir', nir FROM px) "
    + " UNION ALL ".join((_grouping("date", "strftime(day, '%Y-%m-%d')", "day"), _grouping("year", "strftime(day, '%Y')", "strftime(day, '%Y')"), _grouping("month", "strftime(day, '%B_%Y')", "strftime(day, '%B_%Y')")))
)
def cube_statistics_grouping_sets(spark, sf):
    return ST.cube_statistics(V.pixels(spark, sf), ["red", "nir"])


# Masks --------------------------------------------------------------------------------------------------------------


@query(f"""WITH {V.PX} SELECT "row", col, count(*) FILTER (WHERE {CLEAR}) AS n, {r6(f"avg(nir) FILTER (WHERE {CLEAR})")} AS nir FROM px GROUP BY 1, 2""")
def class_mask(spark, sf):
    return M.class_mask(V.pixels(spark, sf), L2A, V.BANDS).groupBy("row", "col").agg(F.count("nir").alias("n"), rounded(F.avg("nir")).alias("nir"))


@query(f"""WITH {V.CUBE} SELECT time, "row", col, CAST(scl IN (8, 9, 10) AS TINYINT) AS cloud_mask_scl, 'scl' AS mask_method FROM cube""")
def scl_mask_build(spark, sf):
    return M.scl_mask(V.cube(spark, sf))


@query(f"""WITH {V.CUBE} SELECT a."row", a.col, count(CASE WHEN m.k = 0 THEN a.nir END) AS n, {r6("avg(CASE WHEN m.k = 0 THEN a.nir END)")} AS nir
    FROM cube a JOIN (SELECT time, "row", col, CAST(scl IN (8, 9, 10) AS INT) AS k FROM cube WHERE "row" < 6) m ON a.time = m.time AND a."row" = m."row" AND a.col = m.col GROUP BY 1, 2""")
def mask_inner_join(spark, sf):
    cube = V.cube(spark, sf)
    out = M.apply_mask(cube, M.scl_mask(cube).filter(F.col("row") < 6), "cloud_mask_scl", V.BANDS)
    return out.groupBy("row", "col").agg(F.count("nir").alias("n"), rounded(F.avg("nir")).alias("nir"))


@query(f"""WITH {V.CUBE}, p AS (SELECT CAST(floor(nir * 95) AS INT) AS p FROM cube)
    SELECT p AS cloud_prob, count(*) AS n, CAST(p >= 30 AS TINYINT) AS cloud_mask_30, CAST(p >= 60 AS TINYINT) AS cloud_mask_60 FROM p GROUP BY p""")
def threshold_masks(spark, sf):
    p = V.cube(spark, sf).select(F.floor(F.col("nir") * 95).cast("int").alias("cloud_prob"))
    return M.threshold_masks(p.groupBy("cloud_prob").agg(F.count(F.lit(1)).alias("n")), [30, 60])


@query(f"""WITH {V.CUBE}, s AS (SELECT time, "row", col, CAST(floor(nir * 95) AS TINYINT) AS cloud_prob FROM cube WHERE year(time) % 2 = 0)
    SELECT c.time, c."row", c.col, coalesce(s.cloud_prob, CAST(CASE WHEN c.scl IN (8, 9, 10) THEN 100 ELSE 0 END AS TINYINT)) AS cloud_prob,
    CASE WHEN s.cloud_prob IS NULL THEN 'scl' ELSE 's2cloudless' END AS mask_method FROM cube c LEFT JOIN s ON c.time = s.time AND c."row" = s."row" AND c.col = s.col""")
def probability_scl_fill(spark, sf):
    cube = V.cube(spark, sf)
    scored = cube.filter(F.year("time") % 2 == 0).select("time", "row", "col", F.floor(F.col("nir") * 95).cast("tinyint").alias("cloud_prob"))
    return M.fill_missing_probability(scored, M.scl_mask(cube).drop("mask_method"))


@query(f"""WITH {V.PX} SELECT "row", count(*) FILTER (WHERE green <> 0 OR blue <> 0) AS n FROM px GROUP BY 1""")
def zeros_as_nodata(spark, sf):
    return M.zeros_to_null(V.pixels(spark, sf), ["green", "blue"]).groupBy("row").agg(F.count("green").alias("n"))


@query(f"""WITH {V.PX}, f AS (SELECT time, count(nir) AS n, var_pop(nir) AS v FROM px GROUP BY 1)
    SELECT time, n, n < greatest(0.9 * max(n) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING), 8.0) OR coalesce(v <= 1e-12, TRUE) AS missing FROM f""")
def running_max_missing_frames(spark, sf):
    return FI.missing_frames(V.pixels(spark, sf), "nir", share=0.9, least=8)


# Joins and updates --------------------------------------------------------------------------------------------------

_RANK = """a AS (SELECT ts, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts) AS k FROM (SELECT DISTINCT ts FROM events WHERE event_type IN ('view', 'click'))),
    b AS (SELECT ts, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts) AS k FROM (SELECT DISTINCT ts FROM events WHERE event_type NOT IN ('view', 'click')))"""


@query(f"WITH {_RANK} SELECT coalesce(a.day, b.day) AS day, CAST(coalesce(a.k, b.k) AS INT) AS k, a.ts AS left_time, b.ts AS right_time FROM a FULL JOIN b ON a.day = b.day AND a.k = b.k")
def rank_aligned_join(spark, sf):
    """Views and clicks against all other events of their day, in the order of time."""
    seen = V.table(spark, sf, "events").select(F.col("ts").alias("time"), F.col("event_type").isin("view", "click").alias("left"))
    return J.rank_aligned(seen.filter("left").select("time").distinct(), seen.filter("not left").select("time").distinct())


@query("""WITH l AS (SELECT event_id, user_id % 5 AS k, ts FROM events WHERE event_id % 2 = 0), r AS (SELECT user_id % 5 AS k, ts, max(value) AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2),
    p AS (SELECT l.event_id, r.v, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(epoch_us(l.ts) - epoch_us(r.ts)), r.ts) AS n FROM l JOIN r ON l.k = r.k
        AND r.ts BETWEEN l.ts - INTERVAL 6 HOUR AND l.ts + INTERVAL 6 HOUR)
    SELECT l.event_id, p.v FROM l LEFT JOIN p ON l.event_id = p.event_id AND p.n = 1""")
def asof_nearest(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", (F.col("user_id") % 5).alias("k"), F.col("ts").alias("time"), "value")
    right = e.filter("event_id % 2 = 1").groupBy("k", "time").agg(F.max("value").alias("v"))
    return J.asof_nearest(e.filter("event_id % 2 = 0").select("event_id", "k", "time"), right, "v", by=["k"], tolerance="6 HOURS").select("event_id", "v")


@query(f"""WITH {V.CUBE} SELECT a.time, a."row", a.col, a.red, a.nir, n.ndvi FROM cube a LEFT JOIN (SELECT time, "row", col, {r6(nd('nir', 'red'))} AS ndvi FROM cube WHERE month(time) > 3) n
    ON a.time = n.time AND a."row" = n."row" AND a.col = n.col""")
def band_addition_left(spark, sf):
    cube = V.cube(spark, sf)
    new = cube.filter(F.month("time") > 3).select("time", "row", "col", rounded(index("ndvi", cube.columns)).alias("ndvi"))
    return J.add_bands(cube.select("time", "row", "col", "red", "nir"), new, ["ndvi"])


@query(f"""WITH {V.CUBE}, o AS (SELECT * FROM cube WHERE month(time) < 7), n AS (SELECT * FROM cube WHERE month(time) > 4)
    SELECT CAST(time AS DATE) AS day, count(*) AS n, {r6("sum(nir)")} AS nir FROM (SELECT time, nir FROM o UNION ALL SELECT time, nir FROM n WHERE CAST(time AS DATE) NOT IN (SELECT CAST(time AS DATE) FROM o)) GROUP BY 1""")
def update_union_antijoin(spark, sf):
    cube = V.cube(spark, sf)
    out = U.append_dates(cube.filter(F.month("time") < 7), cube.filter(F.month("time") > 4))
    return out.groupBy(F.to_date("time").alias("day")).agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("nir")).alias("nir"))


@query(f"""WITH {V.CUBE} SELECT year(time) AS y, count(*) AS n, {r6("avg(red)")} AS red FROM cube GROUP BY 1""")
def reconcile_columns(spark, sf):
    cube = V.cube(spark, sf)
    old = cube.filter(F.year("time") < 1998).select("time", "row", "col", "red", "nir")
    new = cube.filter(F.year("time") >= 1998).select("time", "row", "col", "red", "green")
    out = U.append_dates(old, new)
    assert U.one_sided(old, new) == ["green", "nir"]
    return out.groupBy(F.year("time").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("red")).alias("red"))


@query(f"""WITH {V.CUBE} SELECT CAST(coalesce(a.time, b.time) AS DATE) AS day, a.nir AS before, b.nir AS after FROM (SELECT * FROM cube WHERE "row" = 3 AND col = 4 AND month(time) < 9) a
    FULL JOIN (SELECT * FROM cube WHERE "row" = 3 AND col = 4 AND month(time) > 3) b ON a.time = b.time""")
def pixel_profile(spark, sf):
    cube = V.cube(spark, sf)
    out = J.profile(cube.filter(F.month("time") < 9), cube.filter(F.month("time") > 3), 3, 4, "nir")
    return out.select(F.to_date("time").alias("day"), "before", "after")


# Mosaics ------------------------------------------------------------------------------------------------------------


def _pieces(spark, sf):
    cube = V.cube(spark, sf)
    g = lambda k: GR.Grid("EPSG:32632", 10, -10, 500000 + 40 * k, 5000000 - 20 * k, 8, 8)
    return [MO.Piece(cube.filter(F.year("time") % 3 != k).select("time", "row", "col", "red", "nir"), g(k), f"c{k}", ("red", "nir"), {"mission": L2A}) for k in range(3)]


_PLACED = f"""{V.CUBE}, pl AS (SELECT time, "row" + 2 * k AS "row", col + 4 * k AS col, red, nir, k + 1 AS priority FROM cube, (VALUES (0), (1), (2)) t(k) WHERE year(time) % 3 <> k)"""


def _mosaic(overlap: str, red: str, nir: str):
    def run(spark, sf):
        out, _, _ = MO.mosaic(_pieces(spark, sf), overlap=overlap)
        return out.select("time", "row", "col", rounded(F.col("red")).alias("red"), rounded(F.col("nir")).alias("nir"))

    query(f'WITH {_PLACED} SELECT time, CAST("row" AS INT) AS "row", CAST(col AS INT) AS col, {r6(red)} AS red, {r6(nir)} AS nir FROM pl GROUP BY 1, 2, 3', f"mosaic_{overlap}")(run)


_mosaic("first", "arg_min(red, priority)", "arg_min(nir, priority)")
_mosaic("mean", "avg(red)", "avg(nir)")
_mosaic("median", "median(red)", "median(nir)")
_mosaic("max", "max(red)", "max(nir)")
_mosaic("min", "min(red)", "min(nir)")


@query(f'WITH {_PLACED} SELECT CAST("row" AS INT) AS "row", CAST(col AS INT) AS col, count(*) AS n, CAST(sum(s) AS BIGINT) AS s, CAST(sum(k) AS BIGINT) AS k FROM (SELECT time, "row", col, min(priority) AS s, count(DISTINCT priority) AS k FROM pl GROUP BY 1, 2, 3) GROUP BY 1, 2')
def mosaic_source_map(spark, sf):
    p = _pieces(spark, sf)
    m = MO.source_map(MO.place(p, MO.union_grid(p)), ["red", "nir"])
    return m.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), F.sum("source").alias("s"), F.sum("n_sources").alias("k"))


@query(f"""WITH {_PLACED}, b AS (SELECT a.priority AS p, b.priority AS q, a.time, count(*) AS shared, avg(abs(a.nir - b.nir)) AS mean_diff, max(abs(a.nir - b.nir)) AS max_diff
    FROM pl a JOIN pl b ON a.time = b.time AND a."row" = b."row" AND a.col = b.col AND a.priority < b.priority GROUP BY 1, 2, 3)
    SELECT p, q, shared, {r6("mean_diff")} AS mean_diff, {r6("max_diff")} AS max_diff FROM (SELECT *, row_number() OVER (PARTITION BY p, q ORDER BY time) AS n FROM b) WHERE n = 1""")
def overlap_report(spark, sf):
    p = _pieces(spark, sf)
    out = MO.overlap_report(MO.place(p, MO.union_grid(p)), "nir")
    return out.select("p", "q", "shared", rounded(F.col("mean_diff")).alias("mean_diff"), rounded(F.col("max_diff")).alias("max_diff"))


@query(f"""WITH {_PLACED} SELECT count(*) AS n FROM (SELECT DISTINCT time, "row", col FROM pl WHERE time IN (SELECT time FROM pl GROUP BY 1 HAVING count(DISTINCT priority) = 2))""")
def mosaic_inner_dates(spark, sf):
    out, _, _ = MO.mosaic(_pieces(spark, sf)[:1] + _pieces(spark, sf)[1:], time_join="outer")
    p = _pieces(spark, sf)
    placed = MO.place(p, MO.union_grid(p))
    days = placed.groupBy("time").agg(F.count_distinct("priority").alias("k")).filter("k = 2").select("time")
    return out.join(days, "time", "left_semi").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT DISTINCT l_suppkey % 5 AS cube, 'b' || CAST(l_partkey % 150 AS VARCHAR) AS layer FROM lineitem WHERE l_quantity < 20)
    SELECT layer, count(*) AS cubes, CASE WHEN count(*) = (SELECT count(DISTINCT cube) FROM l) THEN 'common' ELSE 'only_some' END AS kind FROM l GROUP BY 1""")
def layer_intersection(spark, sf):
    """Which layers all of five cubes have, and which only some."""
    rows = V.table(spark, sf, "lineitem").filter("l_quantity < 20").select((F.col("l_suppkey") % 5).alias("cube"), F.concat(F.lit("b"), (F.col("l_partkey") % 150).cast("string")).alias("layer"))
    return MO.layer_table(rows)


# Grid ---------------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey AS id, floor(o_totalprice / 60 + 1e-6) * 60 AS "left", floor(o_custkey / 60 + 1e-6) * 60 AS bottom, ceil((o_totalprice + 35) / 60 - 1e-6) * 60 AS "right", ceil((o_custkey + 35) / 60 - 1e-6) * 60 AS top FROM orders""")
def snap_bounds(spark, sf):
    o = V.table(spark, sf, "orders")
    x, y = F.col("o_totalprice"), F.col("o_custkey").cast("double")
    cols = GR.snap_columns(x, y, x + 35, y + 35, 60.0)
    return o.select(F.col("o_orderkey").alias("id"), *(c.cast("double").alias(n) for c, n in zip(cols, ("left", "bottom", "right", "top"), strict=True)))


@query("""WITH x AS (SELECT col, CASE col WHEN 0 THEN 100 WHEN 1 THEN 134 WHEN 2 THEN 167 END AS a, CASE col WHEN 0 THEN 134 WHEN 1 THEN 167 WHEN 2 THEN 200 END AS b FROM (VALUES (0), (1), (2)) t(col)),
    y AS (SELECT "row", CASE "row" WHEN 0 THEN 235 ELSE 200 END AS a, CASE "row" WHEN 0 THEN 270 ELSE 235 END AS b FROM (VALUES (0), (1)) t("row"))
    SELECT "row", col, x.a * 10.0 AS x0, x.b * 10.0 AS x1, y.a * 10.0 AS y0, y.b * 10.0 AS y1, x.b - x.a AS width_px, y.b - y.a AS height_px FROM x, y""")
def tile_grid(spark, sf):
    p = GR.tile_grid(spark, (1000, 2000, 2000, 2700), 10.0, n_pieces=(2, 3))
    return p.select("row", "col", *(F.col(c).cast("double").alias(c) for c in ("x0", "x1", "y0", "y1")), "width_px", "height_px")


@query("""SELECT "row", col, CASE col WHEN 3 THEN 1 ELSE 2 END AS n_chips_x, CASE "row" WHEN 2 THEN 1 ELSE 2 END AS n_chips_y, 6 + 2 * col AS chip_i0,
    CASE "row" WHEN 2 THEN 12 WHEN 1 THEN 13 ELSE 15 END AS chip_j0 FROM (VALUES (0), (1), (2), (3)) c(col), (VALUES (0), (1), (2)) r("row")""")
def tile_chip_counts(spark, sf):
    p = GR.tile_grid(spark, (1000, 2000, 2000, 2700), 10.0, chip_size=16, chips_per_piece=2)
    return p.select("row", "col", "n_chips_x", "n_chips_y", "chip_i0", "chip_j0")


@query("""WITH p AS (SELECT o_orderkey AS id, o_totalprice AS x, CAST(o_custkey AS DOUBLE) AS y FROM orders), q AS (SELECT *, round_even((x - 640) / 10, 0) * 10 AS x0, round_even((y - 640) / 10, 0) * 10 AS y0 FROM p)
    SELECT id, x0, y0, """ + r6("sqrt((x0 + 640 - x) * (x0 + 640 - x) + (y0 + 640 - y) * (y0 + 640 - y))") + " AS offset_m FROM q")
def point_rect(spark, sf):
    p = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("y"))
    return GR.point_rectangles(p, 128, 10.0).select("id", "x0", "y0", rounded(F.col("offset_m")).alias("offset_m"))


_G = "100 + 10 * (col + 0.5)", '200 - 10 * ("row" + 0.5)'


@query(f"""WITH {V.PX} SELECT "row", col, count(*) AS n FROM px WHERE {_G[0]} BETWEEN 115 AND 160 AND {_G[1]} BETWEEN 125 AND 171 GROUP BY 1, 2""")
def clip_bbox(spark, sf):
    g = GR.Grid("EPSG:32632", 10, -10, 100, 200, 8, 8)
    return FI.clip_bbox(V.pixels(spark, sf), g, (115, 125, 160, 171)).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {V.PX} SELECT "row", col, count(CASE WHEN "row" + col >= 4 AND "row" + col <= 9 THEN nir END) AS n FROM px WHERE "row" BETWEEN 0 AND 7 AND col BETWEEN 0 AND 7 GROUP BY 1, 2""")
def clip_polygon(spark, sf):
    g = GR.Grid("EPSG:32632", 1, 1, 0, 0, 8, 8)
    ring = [(4.5, 0.0), (10.5, 0.0), (0.0, 10.5), (0.0, 4.5)]  # 4.5 <= x + y <= 10.5
    return FI.clip_polygon(V.pixels(spark, sf), GR.rasterize(spark, g, [ring]), ["nir"]).groupBy("row", "col").agg(F.count("nir").alias("n"))


# Windows ------------------------------------------------------------------------------------------------------------


@query(f"""WITH {V.PX}, d AS (SELECT {TYPED} AS day, avg(nir) AS v FROM px GROUP BY 1)
    SELECT day, {r6("v")} AS v, CASE WHEN count(v) OVER w = 7 THEN {r6("avg(v) OVER w")} END AS v_rolling FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def rolling_mean_7(spark, sf):
    d = V.pixels(spark, sf).groupBy(F.to_date("time").alias("day")).agg(F.avg("nir").alias("v"))
    return ST.rolling_mean(d, "v", 7, "day").select("day", rounded(F.col("v")).alias("v"), rounded(F.col("v_rolling")).alias("v_rolling"))


@query(f"""WITH {V.CUBE}, d AS (SELECT "row", col, abs(lag(nir, 2) OVER w - 2 * lag(nir, 1) OVER w + nir) AS d2 FROM cube WINDOW w AS (PARTITION BY "row", col ORDER BY time))
    SELECT "row", col, count(d2) AS n, {r6("avg(d2)")} AS d2 FROM d GROUP BY 1, 2""")
def second_difference(spark, sf):
    return ST.second_difference(V.cube(spark, sf), "nir").groupBy("row", "col").agg(F.count("d2").alias("n"), rounded(F.avg("d2")).alias("d2"))


@query("""WITH w AS (SELECT event_type, value, event_id % 7 + 1 AS k FROM events), c AS (SELECT event_type, value, sum(k) OVER (PARTITION BY event_type ORDER BY value RANGE UNBOUNDED PRECEDING) AS r, sum(k) OVER (PARTITION BY event_type) AS t FROM w)
    SELECT event_type, min(value) AS m FROM c WHERE r >= t / 2.0 GROUP BY 1""")
def weighted_median_consensus(spark, sf):
    e = V.table(spark, sf, "events").select("event_type", "value", (F.col("event_id") % 7 + 1).alias("k"))
    return G.weighted_median(e, ["event_type"], "value", "k", "m")


@query("""WITH e AS (SELECT event_type, value AS x, value / 2 AS y, CAST(event_id % 7 + 1 AS DOUBLE) AS w FROM events),
    c AS (SELECT *, sum(w) OVER (PARTITION BY event_type ORDER BY x RANGE UNBOUNDED PRECEDING) AS r, sum(w) OVER (PARTITION BY event_type) AS t FROM e),
    m AS (SELECT event_type, min(x) AS mx FROM c WHERE r >= t / 2 GROUP BY 1), d AS (SELECT e.*, sqrt((x - mx) * (x - mx) + (y - mx / 2) * (y - mx / 2)) AS d FROM e JOIN m USING (event_type)),
    l AS (SELECT event_type, greatest(0.2, 0.5 * median(d)) AS lim FROM d GROUP BY 1)
    SELECT event_type, round(sum(x * w) / sum(w) + 1e-9, 4) AS x, count(*) AS inliers FROM d JOIN l USING (event_type) WHERE d <= lim GROUP BY 1""")
def shift_consensus(spark, sf):
    e = V.table(spark, sf, "events").select("event_type", F.col("value").alias("x"), (F.col("value") / 2).alias("y"), (F.col("event_id") % 7 + 1).cast("double").alias("reliability"))
    return G.consensus(e, ["event_type"], factor=0.5).select("event_type", rounded(F.col("x"), 4).alias("x"), "inliers")


@query(f"""WITH {V.PX} SELECT "row", col, max(nir IS NOT NULL AND {CLEAR}) AS ever FROM px GROUP BY 1, 2""")
def ever_imaged_footprint(spark, sf):
    return ST.ever_imaged(M.class_mask(V.pixels(spark, sf), L2A, ["nir"]), "nir")


# Neighbourhood ------------------------------------------------------------------------------------------------------

_CLOUDS = f"""{V.CUBE}, cl AS (SELECT time, "row", col, CAST(45 * (scl % 8) AS DOUBLE) AS az FROM cube WHERE scl IN (8, 9, 10))"""


def _clouds(spark, sf):
    return V.cube(spark, sf).filter(F.col("scl").isin(8, 9, 10)).select("time", "row", "col", (45 * (F.col("scl") % 8)).cast("double").alias("sun_azimuth"))


@query(f"""WITH {_CLOUDS} SELECT DISTINCT time, "row" + CAST(round_even(k * 10 * cos(radians(az)) / 10, 0) AS INT) AS "row", col + CAST(round_even(-k * 10 * sin(radians(az)) / 10, 0) AS INT) AS col FROM cl, (SELECT unnest(range(1, 5)) AS k)""")
def shadow_zone(spark, sf):
    return N.shadow_zone(_clouds(spark, sf), 10.0, 40.0, 10.0)


@query(f"""WITH {_CLOUDS}, o AS (SELECT r, c FROM (SELECT unnest(range(-2, 3)) AS r), (SELECT unnest(range(-2, 3)) AS c) WHERE r * r + c * c <= 4)
    SELECT DISTINCT time, CAST("row" + r AS INT) AS "row", CAST(col + c AS INT) AS col FROM cl, o WHERE "row" + r BETWEEN 0 AND 7 AND col + c BETWEEN 0 AND 7""")
def dilate_mask(spark, sf):
    return N.dilate(_clouds(spark, sf), 2, (8, 8))


@query(f"""WITH {_CLOUDS}, o AS (SELECT r, c FROM (SELECT unnest(range(-1, 2)) AS r), (SELECT unnest(range(-1, 2)) AS c) WHERE r * r + c * c <= 1),
    m AS (SELECT DISTINCT time, r, col FROM (SELECT time, unnest([ "row", CASE WHEN "row" < 1 THEN -1 - "row" ELSE "row" END, CASE WHEN "row" >= 7 THEN 15 - "row" ELSE "row" END ]) AS r, col FROM cl)),
    n AS (SELECT DISTINCT time, r, c FROM (SELECT time, r, unnest([ col, CASE WHEN col < 1 THEN -1 - col ELSE col END, CASE WHEN col >= 7 THEN 15 - col ELSE col END ]) AS c FROM m)),
    v AS (SELECT time, n.r + o.r AS "row", n.c + o.c AS col, count(*) AS k FROM n, o GROUP BY 1, 2, 3)
    SELECT time, CAST("row" AS INT) AS "row", CAST(col AS INT) AS col FROM v WHERE k > 2.5 AND "row" BETWEEN 0 AND 7 AND col BETWEEN 0 AND 7""")
def disk_majority(spark, sf):
    return N.majority(_clouds(spark, sf), 1, (8, 8))


@query(f"""WITH {_CLOUDS}, z AS (SELECT DISTINCT time, "row" + CAST(round_even(k * cos(radians(az)), 0) AS INT) AS "row", col + CAST(round_even(-k * sin(radians(az)), 0) AS INT) AS col FROM cl, (SELECT unnest(range(1, 5)) AS k))
    SELECT c.time, c."row", c.col FROM cube c JOIN z ON c.time = z.time AND c."row" = z."row" AND c.col = z.col WHERE nir > 0 AND nir < 0.4 AND scl NOT IN (0, 6)
    AND NOT EXISTS (SELECT 1 FROM cl WHERE cl.time = c.time AND cl."row" = c."row" AND cl.col = c.col)""")
def shadow_detection(spark, sf):
    g = GR.Grid("EPSG:32632", 10, -10, 0, 80, 8, 8)
    return N.detect_shadows(V.cube(spark, sf), _clouds(spark, sf), g, 40.0, 10.0, 0.4, average_over=0, dilation=0)


@query(f"""WITH {V.PX}, d AS (SELECT "row", col, avg(nir) * 100 AS z FROM px GROUP BY 1, 2), g AS (SELECT a."row", a.col, count(*) AS n,
    sum(b.z * (b.col - a.col) * (CASE WHEN b."row" = a."row" THEN 2 ELSE 1 END)) / 80 AS dx, sum(b.z * (b."row" - a."row") * (CASE WHEN b.col = a.col THEN 2 ELSE 1 END)) / 80 AS dy
    FROM d a JOIN d b ON abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1 GROUP BY 1, 2)
    SELECT "row", col, CASE WHEN n = 9 THEN round(degrees(atan(sqrt(dx * dx + dy * dy))) + 1e-9, 4) END AS slope FROM g""")
def terrain_slope(spark, sf):
    dem = V.pixels(spark, sf).groupBy("row", "col").agg((F.avg("nir") * 100).alias("dem"))
    return N.slope_aspect(dem, "dem", 10.0).select("row", "col", rounded(F.col("slope"), 4).alias("slope"))


# Resampling and packing ---------------------------------------------------------------------------------------------


@query(f"""WITH {V.CUBE}, t AS (SELECT r, c, CAST(floor((80 - (75 - 7 * (r + 0.5))) / 10) AS INT) AS "row", CAST(floor((3 + 7 * (c + 0.5)) / 10) AS INT) AS col FROM (SELECT unnest(range(0, 10)) AS r), (SELECT unnest(range(0, 10)) AS c))
    SELECT cube.time, CAST(t.r AS INT) AS "row", CAST(t.c AS INT) AS col, cube.nir FROM cube JOIN t ON cube."row" = t."row" AND cube.col = t.col""")
def reproject_nearest(spark, sf):
    a, b = GR.Grid("EPSG:32632", 10, -10, 0, 80, 8, 8), GR.Grid("EPSG:32632", 7, -7, 3, 75, 10, 10)
    return RS.reproject_nearest(V.cube(spark, sf).select("time", "row", "col", "nir"), a, b)


@query(f"""WITH {V.PX}, m AS (SELECT (max(nir) - min(nir)) / 65534 AS s, (max(nir) + min(nir)) / 2 AS o FROM px)
    SELECT "row", count(*) AS n, CAST(min(p) AS SMALLINT) AS low, CAST(max(p) AS SMALLINT) AS high, max(abs(p * s + o - nir) <= s / 2 + 1e-12) AS within FROM (SELECT *, greatest(-32767, least(32767, round_even((nir - o) / s, 0))) AS p FROM px, m) GROUP BY 1""")
def pack_int16_roundtrip(spark, sf):
    px = V.pixels(spark, sf).select("row", "nir", F.col("nir").alias("p"))
    packed, s, o = R.pack_int16(px, ["p"])
    back = F.max(F.abs(R.unpacked(F.col("p"), s, o) - F.col("nir")) <= s / 2 + 1e-12)
    return packed.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("low"), F.max("p").alias("high"), back.alias("within"))


@query("""WITH s AS (SELECT DISTINCT p_size * 17 AS size FROM part), p AS (SELECT size, unnest(range(0, 20)) * 96 AS k FROM s)
    SELECT CAST(size AS INT) AS size, CAST(k AS INT) AS start FROM p WHERE k < size - 128 UNION ALL SELECT CAST(size AS INT), CAST(greatest(size - 128, 0) AS INT) FROM s""")
def patch_positions(spark, sf):
    sizes = V.table(spark, sf, "part").select((F.col("p_size") * 17).cast("int").alias("size")).distinct()
    return sizes.select("size", F.explode(RS.patch_starts(F.col("size"))).alias("start"))


@query("""WITH c AS (SELECT c_custkey AS id, CAST(pow(10, c_custkey % 14) * (c_custkey % 9 + 1) AS DOUBLE) AS n FROM customer)
    SELECT id, CASE WHEN n < 1024 THEN printf('%.0f B', n) WHEN n < pow(1024, 2) THEN printf('%.1f KB', n / 1024) WHEN n < pow(1024, 3) THEN printf('%.1f MB', n / pow(1024, 2)) WHEN n < pow(1024, 4) THEN printf('%.1f GB', n / pow(1024, 3)) ELSE printf('%.1f TB', n / pow(1024, 4)) END AS size FROM c""")
def human_sizes(spark, sf):
    k = F.col("c_custkey")
    return V.table(spark, sf, "customer").select(k.alias("id"), GR.human_size_column(F.pow(F.lit(10.0), k % 14) * (k % 9 + 1)).alias("size"))


def _ground(spark, sf):
    """An image of 64 x 64 pixels: the mean price of the line items that a hash sends to each, 0.3 where there is none."""
    place = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(64 * 64))
    known = V.table(spark, sf, "lineitem").groupBy(place.alias("p")).agg((F.avg("l_extendedprice") / 100000).alias("red"))
    every = spark.range(64 * 64).withColumnRenamed("id", "p").join(known, "p", "left")
    return every.select((F.col("p") / 64).cast("int").alias("row"), (F.col("p") % 64).cast("int").alias("col"), F.coalesce("red", F.lit(0.3)).alias("red"))


def _moved_scenes(spark, sf, still=0):
    """The image a day for each nation, moved by rows and columns of its own, but for the first ``still`` days."""
    k, moves = F.col("n_nationkey"), F.col("n_nationkey") >= still
    dy, dx = F.when(moves, (k + 2) % 5 - 2).otherwise(0), F.when(moves, (2 * k + 3) % 7 - 3).otherwise(0)
    scene = V.table(spark, sf, "nation").select(k.cast("int").alias("k"), dy.cast("int").alias("dy"), dx.cast("int").alias("dx"))
    at = _ground(spark, sf).join(F.broadcast(scene), F.lit(True))  # 25 scenes
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("k")).cast("timestamp_ntz")
    moved = lambda c, by: F.pmod(F.col(c) + F.col(by), F.lit(64)).alias(c)
    return at.select(F.lit("c").alias("cube_id"), day.alias("time"), moved("row", "dy"), moved("col", "dx"), "red")


def _whole_shifts(found):
    return found.select("cube_id", F.to_date("time").alias("day"), F.round("shift_row").cast("int").alias("shift_row"), F.round("shift_col").cast("int").alias("shift_col"), "kept")


_MOVED = "SELECT 'c' AS cube_id, CAST(DATE '2024-01-01' + CAST(n_nationkey AS INT) AS DATE) AS day, CAST((n_nationkey + 2) % 5 - 2 AS INT) AS shift_row, CAST((2 * n_nationkey + 3) % 7 - 3 AS INT) AS shift_col, TRUE AS kept FROM nation"


@query(_MOVED)
def phase_shift_consensus(spark, sf):
    """Shifts against a running reference that starts from the first day; the SQL states how far each scene was moved."""
    return _whole_shifts(G.estimate_shifts(_moved_scenes(spark, sf), "red", size=32, composite_days=0))


@query(f"WITH m AS ({_MOVED}), a AS (SELECT shift_row AS y, shift_col AS x FROM m WHERE day = DATE '2024-01-13') SELECT cube_id, day, CAST(shift_row - y AS INT) AS shift_row, CAST(shift_col - x AS INT) AS shift_col, kept FROM m, a")
def phase_shift_anchor(spark, sf):
    """Shifts from an anchor in the middle, forward and backward."""
    return _whole_shifts(G.estimate_shifts(_moved_scenes(spark, sf), "red", size=32, mode="anchor", anchor="2024-01-13"))


_STILL = _MOVED.replace("CAST((n_nationkey", "CASE WHEN n_nationkey >= 5 THEN 1 ELSE 0 END * CAST((n_nationkey").replace("CAST((2 *", "CASE WHEN n_nationkey >= 5 THEN 1 ELSE 0 END * CAST((2 *")


@query(_STILL)
def phase_shift_composite(spark, sf):
    """Shifts against the median of the first days, in two passes."""
    return _whole_shifts(G.estimate_shifts(_moved_scenes(spark, sf, 5), "red", size=32, composite_days=4, update_ref=10_000, passes=2))


@query(f"SELECT cube_id, day, kept, TRUE AS aligned FROM ({_STILL})")
def coregister_scenes(spark, sf):
    """Scenes moved back by one warp: whether each one's inner pixels are those of the ground."""
    out, shifts = G.coregister(_moved_scenes(spark, sf, 5), ["red"], passes="auto", size=32, composite_days=4)
    ground = _ground(spark, sf).filter("row between 8 and 55 and col between 8 and 55").withColumnRenamed("red", "was")
    near = out.join(ground, ["row", "col"]).groupBy("cube_id", F.to_date("time").alias("day")).agg((F.avg(F.abs(F.col("red") - F.col("was"))) < 0.02).alias("aligned"))
    return shifts.select("cube_id", F.to_date("time").alias("day"), "kept").join(near, ["cube_id", "day"])


@query()
def super_resolution(spark, sf):
    """Half the pixel size with the default model (tested against the same interpolation of the whole image)."""
    cube = V.cube(spark, sf).select("time", "row", "col", "nir")
    return RS.super_resolve(cube, ["nir"], 2, tile=32)


@query()
def cloud_probability(spark, sf):
    """Scores of the stand-in scorer (tested against the same formula)."""
    return N.score_pixels(V.cube(spark, sf), ["blue", "green", "red", "nir"], N.brightness_scorer)


# Whole requests -----------------------------------------------------------------------------------------------------


@query(f"""WITH {_STATS}, k AS (SELECT time FROM st WHERE cloud_percentage <= 40), v AS (SELECT "row", col, {nd("nir", "red")} AS ndvi, nir FROM px WHERE time IN (SELECT time FROM k) AND {CLEAR} AND time >= TIMESTAMP '1996-01-01' AND time < TIMESTAMP '1998-01-01')
    SELECT 'mean_timeseries' AS layer, "row", col, {r6("avg(nir * 1e-4)")} AS nir, {r6("avg(ndvi)")} AS ndvi FROM v GROUP BY 2, 3""")
def build_request(spark, sf):
    from .plans.cube import build
    from .plans.request import CubeRequest

    r = CubeRequest(L2A, bands=["red", "nir"], indices=["ndvi"], daterange=["1996-01-01", "1997-12-31"], cloud_masking=True, scene_cloud_coverage=40, stats=["mean_timeseries"], tile_handling="separate")
    _, layers = build(r, V.pixels(spark, sf), GR.Grid("EPSG:32632", 10, -10, 0, 80, 8, 8))
    return layers.select("layer", "row", "col", rounded(F.col("nir")).alias("nir"), rounded(F.col("ndvi")).alias("ndvi"))


@query(f"""WITH {V.PX} SELECT ord % 5 AS feature_id, "row", col, {r6("avg(nir * 1e-4)")} AS nir_mean, {r6("max(" + nd("nir", "red") + ")")} AS ndvi_max FROM px WHERE {CLEAR} GROUP BY 1, 2, 3""")
def build_features(spark, sf):
    from .plans.cube import build_features as many
    from .plans.request import CubeRequest

    r = CubeRequest(L2A, bands=["red", "nir"], indices=["ndvi"], cloud_masking=True, stats=["mean", "max"], tile_handling="separate")
    out = many(r, V.pixels(spark, sf).withColumn("feature_id", F.col("ord") % 5), GR.Grid("EPSG:32632", 10, -10, 0, 80, 8, 8))
    of = lambda op, band: rounded(F.max(F.when(F.col("layer") == f"{op}_timeseries", F.col(band)))).alias(f"{band}_{op}")
    return out.groupBy("feature_id", "row", "col").agg(of("mean", "nir"), of("max", "ndvi"))


@query("SELECT CAST(ts AS DATE) AS day, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def stream_daily_window(spark, sf):
    """A file stream, deduplicated and counted by day, run to its end."""
    import os
    import uuid

    path = f"{sf}/events.parquet"
    # A table may be one file or a folder of files; a stream reads folders and patterns.
    where = f"{sf}/event[s].parquet" if len(spark.read.parquet(path).inputFiles()) == 1 and not os.path.isdir(path) else path
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(where)
    items = stream.dropDuplicates(["event_id"])
    days = items.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("date").alias("day"), "n")
    name = f"days_{uuid.uuid4().hex}"
    days.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


from . import queries_rasters, queries_tools  # noqa: E402, F401  register more
