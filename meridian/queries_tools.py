"""More registered queries: scene properties, masks, resampling, storage and whole requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views as V
from .functions import radiometry as R
from .functions import registry as RG
from .functions import scene as S
from .functions.expr import rounded
from .functions.indices import index
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
from .plans.cube import Cube, build
from .plans.request import CubeRequest
from .queries import CLEAR, L2A, TYPED, _clouds, _pieces, _PLACED, nd, query, r6
from .sources import stac, store
from .sources.scratch import scratch
from .streaming import scenes as STR

EIGHT = GR.Grid("EPSG:32632", 10, -10, 0, 80, 8, 8)


# Scene properties -----------------------------------------------------------------------------------------------------

_LETTERS = "CDEFGHJKLMNPQRSTUVWX"
_PROPS = f"""pr AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderdate AS datetime, CAST(o_orderkey % 4 AS INT) AS k, lpad(CAST(o_custkey % 60 + 1 AS VARCHAR), 2, '0') AS z, substr('{_LETTERS}', CAST(o_custkey % 20 + 1 AS INT), 1) AS band FROM orders),
    tl AS (SELECT *, CASE k WHEN 0 THEN z || band || 'AB' WHEN 1 THEN z || 'TPK' WHEN 2 THEN z || 'HUB' ELSE CAST(c % 60 + 1 AS VARCHAR) || '/027' END AS tile FROM pr)"""


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes whose properties are written in four dialects."""
    o = V.table(spark, sf, "orders")
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey")
    zone = F.lpad((c % 60 + 1).cast("string"), 2, "0")
    given = {
        "mgrs:utm_zone": F.when(k == 0, (c % 60 + 1).cast("string")), "mgrs:latitude_band": F.when(k == 0, F.substring(F.lit(_LETTERS), (c % 20 + 1).cast("int"), F.lit(1))), "mgrs:grid_square": F.when(k == 0, "AB"),
        "s2:mgrs_tile": F.when(k == 1, F.concat(zone, F.lit("TPK"))), "grid:code": F.when(k == 2, F.concat(F.lit("MGRS-"), zone, F.lit("HUB"))),
        "landsat:wrs_path": F.when(k == 3, (c % 60 + 1).cast("string")), "landsat:wrs_row": F.when(k == 3, "027"),
        "proj:epsg": F.when(c % 3 == 0, "32632"), "sat:relative_orbit": F.when(c % 5 == 0, (c % 143 + 1).cast("string")), "s2:product_uri": F.when(c % 5 == 1, "S2A_MSIL2A_x_R065_y"),
        "sat:orbit_state": F.when(c % 5 == 2, F.when(c % 2 == 0, "ascending").otherwise("descending")), "s2:mean_solar_azimuth": (c % 360).cast("string"), "view:sun_azimuth": F.when(c % 2 == 0, (c % 90).cast("string")),
        "s2:mean_solar_zenith": (c % 80).cast("string"), "processing:version": F.when(c % 7 > 0, F.concat(F.lit("0"), (c % 7).cast("string"), F.lit(".10"))), "eo:cloud_cover": (c % 101).cast("string"),
        "s2:datastrip_id": F.when(c % 4 > 0, F.concat(F.lit("S2A_x_S"), F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss"), F.lit("_N02"))),
    }
    props = F.map_filter(F.create_map(*(x for name, v in given.items() for x in (F.lit(name), v))), lambda _, v: v.isNotNull())
    return o.select(F.col("o_orderkey").alias("item_id"), F.col("o_orderdate").alias("datetime"), props.alias("properties"))


@query(f"WITH {_PROPS} SELECT tile, count(*) AS n FROM tl GROUP BY 1")
def tile_ids(spark, sf):
    return _items(spark, sf).groupBy(S.tile(F.col("properties")).alias("tile")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_PROPS} SELECT CASE WHEN c % 3 = 0 THEN 'EPSG:32632' WHEN k = 3 THEN NULL ELSE 'EPSG:' || CASE WHEN (k = 0 AND band >= 'N') OR k = 1 THEN '326' ELSE '327' END || z END AS crs, count(*) AS n FROM tl GROUP BY 1""")
def item_crs(spark, sf):
    return _items(spark, sf).groupBy(S.crs(F.col("properties")).alias("crs")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_PROPS}, l AS (SELECT CASE c % 5 WHEN 0 THEN CAST(c % 143 + 1 AS VARCHAR) WHEN 1 THEN '65' WHEN 2 THEN CASE WHEN c % 2 = 0 THEN 'ascending' ELSE 'descending' END ELSE 'unknown' END AS orbit FROM pr)
    SELECT orbit, count(*) AS n, CASE WHEN orbit = 'unknown' THEN 2 WHEN orbit LIKE '%scending' THEN 1 ELSE 0 END AS kind FROM l GROUP BY 1""")
def orbit_labels(spark, sf):
    label = S.orbit_label(F.col("properties")).alias("orbit")
    return _items(spark, sf).groupBy(label).agg(F.count(F.lit(1)).alias("n")).select("orbit", "n", S.orbit_order(F.col("orbit"))["kind"].alias("kind"))


@query(f"""WITH {_PROPS} SELECT CAST(datetime AS DATE) AS day, {r6("avg(CASE WHEN c % 2 = 0 THEN c % 90 ELSE c % 360 END)")} AS sun_azimuth, {r6("avg(90 - c % 80)")} AS sun_elevation, max(CASE WHEN c % 7 > 0 THEN CAST(c % 7 + 0.1 AS DOUBLE) END) AS baseline FROM pr GROUP BY 1""")
def scene_angles(spark, sf):
    p = F.col("properties")
    return _items(spark, sf).groupBy(F.to_date("datetime").alias("day")).agg(rounded(F.avg(S.sun_azimuth(p))).alias("sun_azimuth"), rounded(F.avg(S.sun_elevation(p))).alias("sun_elevation"), F.max(S.baseline(p)).alias("baseline"))


@query(f"""WITH {_PROPS}, g AS (SELECT tile, CASE WHEN c % 4 > 0 THEN strftime(datetime, '%Y%m%dT%H%M%S') ELSE '' END AS sensed FROM tl) SELECT tile, sensed, count(*) AS n FROM g GROUP BY 1, 2""")
def granule_keys(spark, sf):
    g = S.granule(F.col("properties"))
    return _items(spark, sf).groupBy(g["tile"].alias("tile"), g["sensed"].alias("sensed")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS item_id, o_orderdate AS datetime FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 200")
def item_cap(spark, sf):
    return SC.first_items(_items(spark, sf), 200).select("item_id", "datetime")


@query(f"""WITH {_PROPS} SELECT tile, count(*) AS n, CAST(min(datetime) AS DATE) AS first, {r6("avg(c % 101)")} AS cloud_cover FROM tl WHERE c % 101 <= 60 AND datetime >= TIMESTAMP '1995-01-01' GROUP BY 1""")
def stac_items(spark, sf):
    """Scenes written as catalogue items, one JSON line each, and read back with their outlines."""
    path = scratch(spark, "items")
    o = _items(spark, sf)
    x = (F.col("item_id") % 10).cast("double")
    ring = F.array(*(F.array(x + a, F.lit(float(b))) for a, b in ((0, 0), (1, 0), (1, 1), (0, 0))))
    props = F.map_concat("properties", F.create_map(F.lit("datetime"), F.date_format("datetime", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    items = o.select(F.col("item_id").cast("string").alias("id"), F.lit("c").alias("collection"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), props.alias("properties"))
    items.write.json(path)
    rows = stac.footprints(stac.read_items(spark, path)).filter(F.col("datetime") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    return FI.cloud_cover(rows, 60).groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.to_date(F.min("datetime")).alias("first"), rounded(F.avg("cloud_cover")).alias("cloud_cover"))


@query(f"""WITH {V.SCENES}, f AS (SELECT tile, source AS crs, item_id, 1 + item_id % 9 AS w, 1 + item_id % 5 AS h FROM sc)
    SELECT crs, tile, CAST(max(w * h) AS DOUBLE) AS area FROM f GROUP BY 1, 2""")
def representative_footprints(spark, sf):
    w, h = (1 + F.col("item_id") % 9).cast("double"), (1 + F.col("item_id") % 5).cast("double")
    s = V.scenes(spark, sf).withColumns({"crs": F.col("source"), "geometry": F.array(F.struct(w.alias("x"), h.alias("y")))})
    out = SC.representative_footprints(s, w * h)
    return out.filter(F.col("geometry")[0]["x"] * F.col("geometry")[0]["y"] == F.col("area")).select("crs", "tile", "area")


@query(f"""WITH {V.SCENES}, d AS (SELECT CAST(datetime AS DATE) AS day, avg(sun_azimuth) AS a FROM sc GROUP BY 1), {V.PX}, t AS (SELECT DISTINCT time FROM px)
    SELECT t.time, round(d.a + 1e-9, 6) AS sun_azimuth FROM t LEFT JOIN d ON CAST(t.time AS DATE) = d.day""")
def attach_azimuths(spark, sf):
    daily = J.daily_metadata(V.scenes(spark, sf), {"sun_azimuth": (F.col("sun_azimuth"), "avg")}, F.to_date("datetime"))
    times = V.pixels(spark, sf).select("time").distinct()
    return J.attach_daily(times, daily).select("time", rounded(F.col("sun_azimuth")).alias("sun_azimuth"))


@query(f"""WITH {V.PX}, st AS (SELECT time, count(*) AS n, avg(qa) AS cloud, avg(nir) AS g FROM px GROUP BY 1), r AS (SELECT *, epoch(time) AS t, min(epoch(time)) OVER () AS a, max(epoch(time)) OVER () AS z FROM st)
    SELECT time FROM r WHERE cloud <= 10 AND n >= 2 ORDER BY t >= a + (z - a) / 4 AND t <= z - (z - a) / 4 DESC, g DESC, time LIMIT 1""")
def anchor_scene(spark, sf):
    px = V.pixels(spark, sf).groupBy("time").agg(F.avg("qa").alias("cloud_percentage"), F.when(F.count(F.lit(1)) < 2, 1.0).otherwise(0.0).alias("missing"), F.avg("nir").alias("gradient"))
    return G.auto_anchor(px).select("time")


# Pixels ---------------------------------------------------------------------------------------------------------------


@query(f"""WITH {V.PX}, u AS (SELECT floor(greatest(0, least(1, nir)) * 255 + 0.5) / 255 AS x FROM px), c AS (SELECT CASE WHEN x <= 0.5 THEN floor(255 * x / 0.5 + 0.5) ELSE 255 END AS r, CASE WHEN x <= 0.5 THEN 0 ELSE floor(255 * (x - 0.5) / 0.5 + 0.5) END AS g FROM u)
    SELECT CAST(r AS INT) AS r, CAST(g AS INT) AS g, count(*) AS n FROM c GROUP BY 1, 2""")
def colour_lut(spark, sf):
    lut = R.piecewise_lut([(0, (0, 0, 0)), (0.5, (255, 0, 0)), (1, (255, 255, 255))])
    rgb = V.pixels(spark, sf).select(R.apply_lut(F.col("nir"), lut, 0.0, 1.0).alias("c"))
    return rgb.groupBy(F.col("c")[0].alias("r"), F.col("c")[1].alias("g")).agg(F.count(F.lit(1)).alias("n"))


@query(f'WITH {V.PX} SELECT "row", {r6("avg(red)")} AS red, {r6("avg(nir)")} AS nir, {r6("avg(swir16)")} AS swir16 FROM px GROUP BY 1')
def band_renames(spark, sf):
    assets = V.pixels(spark, sf).select("row", F.col("red").alias("B04_10m"), F.col("nir").alias("B08_10m"), F.col("swir16").alias("B11_20m"))
    out = RG.rename_to_common(assets, "s2", "cdse")
    return out.groupBy("row").agg(*(rounded(F.avg(b)).alias(b) for b in ("red", "nir", "swir16")))


@query(f'WITH {V.PX} SELECT "row", col, count(*) AS n FROM px WHERE "row" BETWEEN 2 AND 5 AND col BETWEEN 1 AND 3 GROUP BY 1, 2')
def crop_rows(spark, sf):
    return FI.crop(V.pixels(spark, sf), (5, 2), (1, 3)).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {V.PX}, st AS (SELECT time, CASE WHEN max(ord) % 2 = 0 THEN 'ascending' ELSE 'descending' END AS orbit_state FROM px GROUP BY 1)
    SELECT time, count(*) AS n FROM px WHERE time IN (SELECT time FROM st WHERE orbit_state = 'ascending') GROUP BY 1""")
def orbit_state_filter(spark, sf):
    px = V.pixels(spark, sf)
    stats = px.groupBy("time").agg(F.when(F.max("ord") % 2 == 0, "ascending").otherwise("descending").alias("orbit_state"))
    return FI.by_orbit_state(px, stats, "ascending").groupBy("time").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {V.PX} SELECT time FROM px GROUP BY 1 HAVING NOT bool_or((blue <> 0 OR green <> 0) AND qa < 8)")
def empty_scenes(spark, sf):
    seen = V.pixels(spark, sf).withColumns({b: F.when(F.col("qa") < 8, F.col(b)) for b in ("blue", "green")})
    return M.empty_scenes(seen, ["blue", "green"])


@query(f"""WITH {V.CUBE} SELECT "row", col, count(*) AS n, {r6("avg(nir)")} AS nir FROM cube GROUP BY 1, 2""")
def auxiliary_on_grid(spark, sf):
    """A layer in map coordinates, each point up to 4 m off its pixel's centre, put on the cube's grid."""
    cube = V.cube(spark, sf)
    layer = cube.select((EIGHT.x(F.col("col")) + F.col("scl") % 5).alias("x"), (EIGHT.y(F.col("row")) - F.col("scl") % 4).alias("y"), "nir")
    return J.snap_to_grid(layer, EIGHT).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("nir")).alias("nir"))


@query(f"""WITH {V.PX} SELECT {TYPED} AS day, count(*) AS n FROM px WHERE {TYPED} IN (SELECT CAST(time AS DATE) FROM px WHERE month(time) = 7) GROUP BY 1""")
def required_days(spark, sf):
    px = V.pixels(spark, sf)
    return J.require_days(px.filter(F.month("time") == 7), px, "layer").groupBy(F.to_date("time").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {V.CUBE} SELECT time, count(*) FILTER (WHERE {CLEAR} OR scl IN (8, 9, 10)) / 64 AS scene_coverage FROM cube GROUP BY 1")
def coverage_first_band(spark, sf):
    seen = V.cube(spark, sf).withColumn("nir", F.when(~F.col("scl").isin(0, 8, 9, 10), F.col("nir")))
    return ST.coverage_from_band(seen, "nir", 64, F.coalesce(F.col("scl").isin(8, 9, 10), F.lit(False)))


@query(f"""WITH {V.CUBE}, m AS (SELECT "row", col, avg(nir) AS v FROM cube GROUP BY 1, 2),
    g AS (SELECT m."row", m.col, sqrt(power(r.v - m.v, 2) + power(b.v - m.v, 2)) AS g FROM m JOIN m r ON r."row" = m."row" AND r.col = m.col + 1 JOIN m b ON b."row" = m."row" + 1 AND b.col = m.col),
    e AS (SELECT "row", col FROM g WHERE g >= (SELECT quantile_cont(g, 0.9) FROM g)),
    d AS (SELECT abs(lag(nir, 2) OVER w - 2 * lag(nir, 1) OVER w + nir) AS d2 FROM cube JOIN e USING ("row", col) WINDOW w AS (PARTITION BY "row", col ORDER BY time))
    SELECT {r6("avg(d2)")} AS roughness FROM d""")
def edge_roughness(spark, sf):
    return ST.edge_roughness(V.cube(spark, sf), "nir").select(rounded(F.col("roughness")).alias("roughness"))


@query(f"WITH {V.CUBE} SELECT time, avg(CASE WHEN scl IN (8, 9, 10) THEN 1.0 ELSE 0.0 END) * 100 AS masked_percentage FROM cube GROUP BY 1")
def masked_percentage(spark, sf):
    return ST.masked_percentage(M.scl_mask(V.cube(spark, sf)), "cloud_mask_scl")


@query(f"""WITH {V.CUBE} SELECT time, "row", col, CAST(scl IN (8, 9, 10) AS TINYINT) AS cloud_mask_scl, CAST(nir > 0.5 AS TINYINT) AS shadow_mask FROM cube""")
def mask_band_replace(spark, sf):
    cube = V.cube(spark, sf)
    mask = M.scl_mask(cube).drop("mask_method").withColumn("shadow_mask", F.lit(0).cast("tinyint"))
    return M.add_mask_bands(mask, cube.select("time", "row", "col", (F.col("nir") > 0.5).cast("tinyint").alias("shadow_mask")), ["shadow_mask"])


@query(f"""WITH {V.CUBE} SELECT CAST(time AS DATE) AS day, count(*) AS n, CAST(sum(CASE WHEN scl IN (8, 9, 10) THEN 1 ELSE 0 END) AS BIGINT) AS cloudy FROM cube GROUP BY 1""")
def scl_mask_update(spark, sf):
    cube = V.cube(spark, sf)
    out = M.update_scl_mask(M.scl_mask(cube.filter(F.month("time") < 6)), cube)
    return out.groupBy(F.to_date("time").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("cloud_mask_scl").cast("long")).alias("cloudy"))


@query(f"""WITH {V.PX} SELECT CAST(ord % 3 AS INT) AS tile, time, "row", col, {r6("arg_min(nir, ord)")} AS nir FROM px GROUP BY 1, 2, 3, 4""")
def tiles_apart(spark, sf):
    px = V.pixels(spark, sf).withColumn("tile", (F.col("ord") % 3).cast("int"))
    parts = [C.solar_day_mosaic(px.filter(F.col("tile") == k), ["nir"], F.col("ord"), ("tile", "time", "row", "col")) for k in range(3)]
    return U.tiles_kept_apart(parts).select("tile", "time", "row", "col", rounded(F.col("nir")).alias("nir"))


@query(f"""WITH {V.CUBE}, p AS (SELECT time, "row", col, floor(nir * 95) AS p FROM cube), o AS (SELECT r, c FROM (SELECT unnest(range(-1, 2)) AS r), (SELECT unnest(range(-1, 2)) AS c) WHERE r * r + c * c <= 1),
    m AS (SELECT DISTINCT time, r, col, p FROM (SELECT time, unnest([ "row", CASE WHEN "row" < 1 THEN -1 - "row" ELSE "row" END, CASE WHEN "row" >= 7 THEN 15 - "row" ELSE "row" END ]) AS r, col, p FROM p)),
    n AS (SELECT DISTINCT time, r, c, p FROM (SELECT time, r, p, unnest([ col, CASE WHEN col < 1 THEN -1 - col ELSE col END, CASE WHEN col >= 7 THEN 15 - col ELSE col END ]) AS c FROM m)),
    v AS (SELECT time, n.r + o.r AS "row", n.c + o.c AS col, sum(p) AS s FROM n, o GROUP BY 1, 2, 3),
    a AS (SELECT time, "row", col FROM v WHERE s > 15 * 5 AND "row" BETWEEN 0 AND 7 AND col BETWEEN 0 AND 7),
    g AS (SELECT DISTINCT time, "row" + r AS "row", col + c AS col FROM a, o)
    SELECT p.time, p."row", p.col, CAST(CASE WHEN year(p.time) % 2 = 0 THEN p.p >= 100 ELSE g.time IS NOT NULL END AS TINYINT) AS cloud_mask_15 FROM p LEFT JOIN g ON p.time = g.time AND p."row" = g."row" AND p.col = g.col""")
def probability_masks(spark, sf):
    p = V.cube(spark, sf).select("time", "row", "col", F.floor(F.col("nir") * 95).alias("cloud_prob"), F.when(F.year("time") % 2 == 0, "scl").otherwise("s2cloudless").alias("mask_method"))
    own = p.filter(F.col("mask_method") != "scl")
    return N.probability_masks(own, [15], (8, 8), 1, 1).unionByName(N.probability_masks(p.filter(F.col("mask_method") == "scl"), [15], (8, 8), 1, 1)).select("time", "row", "col", "cloud_mask_15")


_SHADOW = f"""{V.SCENES}, az AS (SELECT CAST(datetime AS DATE) AS day, avg(sun_azimuth) AS a FROM sc GROUP BY 1), {V.CUBE}, cl AS (SELECT time, "row", col, a FROM cube JOIN az ON CAST(time AS DATE) = day WHERE scl IN (8, 9, 10)),
    z AS (SELECT DISTINCT time, "row" + CAST(round_even(k * cos(radians(a)), 0) AS INT) AS "row", col + CAST(round_even(-k * sin(radians(a)), 0) AS INT) AS col FROM cl, (SELECT unnest(range(1, 5)) AS k)),
    sh AS (SELECT c.time, c."row", c.col FROM cube c JOIN z ON c.time = z.time AND c."row" = z."row" AND c.col = z.col WHERE nir > 0 AND nir < 0.4 AND scl NOT IN (0, 6, 8, 9, 10))"""


def _seen_days(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The cube on days that the catalogue knows, and the azimuth of each day."""
    azimuths = V.scenes(spark, sf).groupBy(F.to_date("datetime").alias("day")).agg(F.avg("sun_azimuth").alias("sun_azimuth"))
    return V.cube(spark, sf).join(azimuths.select("day"), F.to_date("time") == F.col("day"), "left_semi"), azimuths


@query(f"""WITH {_SHADOW} SELECT c.time, c."row", c.col, CAST(c.scl IN (8, 9, 10) AS TINYINT) AS cloud_mask, CAST(sh.time IS NOT NULL AS TINYINT) AS shadow_mask, CAST(c.scl IN (8, 9, 10) OR sh.time IS NOT NULL AS TINYINT) AS cloudshadow_mask
    FROM cube c JOIN az ON CAST(c.time AS DATE) = az.day LEFT JOIN sh ON sh.time = c.time AND sh."row" = c."row" AND sh.col = c.col""")
def shadow_masks(spark, sf):
    cube, azimuths = _seen_days(spark, sf)
    mask = M.scl_mask(cube).withColumnRenamed("cloud_mask_scl", "cloud_mask")
    return N.shadow_layers(cube, mask, azimuths, EIGHT, 45, 40.0, 10.0, 0.4, 0, 0)


@query(f"""WITH {V.CUBE} SELECT time, CAST("row" + 2 AS INT) AS "row", CAST(col - 1 AS INT) AS col, {r6("nir")} AS nir FROM cube""")
def shift_whole(spark, sf):
    return RS.shift_whole(V.cube(spark, sf).select("time", "row", "col", "nir"), 2, -1).withColumn("nir", rounded(F.col("nir")))


_MONTHLY = """, mo AS (SELECT date_trunc('month', time)::TIMESTAMP AS time, "row", col, avg(nir) AS nir FROM cube GROUP BY 1, 2, 3)"""


def _monthly(spark, sf) -> DataFrame:
    return V.cube(spark, sf).groupBy(F.date_trunc("MONTH", "time").cast("timestamp_ntz").alias("time"), "row", "col").agg(F.avg("nir").alias("nir"))


@query(f"""WITH {V.CUBE}{_MONTHLY} SELECT b.time, b."row", b.col, {r6("a.nir")} AS nir FROM mo b LEFT JOIN mo a ON a.time = b.time AND a."row" = b."row" - 1 AND a.col = b.col + 2""")
def warp_by_whole_pixels(spark, sf):
    """Monthly means moved by the cubic warp; by whole pixels it is a move of rows and columns."""
    return RS.warp(_monthly(spark, sf), ["nir"], 1.0, -2.0, tile=64).withColumn("nir", rounded(F.col("nir")))


@query(f"""WITH {V.CUBE}{_MONTHLY}, t AS (SELECT r, c, (3 + 7 * (c + 0.5)) / 10 - 0.5 AS u, (80 - (75 - 7 * (r + 0.5))) / 10 - 0.5 AS v FROM (SELECT unnest(range(0, 10)) AS r), (SELECT unnest(range(0, 10)) AS c)),
    k AS (SELECT r, c, floor(v) + dr AS "row", floor(u) + dc AS col, (1 - abs(dr - (v - floor(v)))) * (1 - abs(dc - (u - floor(u)))) AS w FROM t, (SELECT unnest([0, 1]) AS dr), (SELECT unnest([0, 1]) AS dc))
    SELECT time, CAST(r AS INT) AS "row", CAST(c AS INT) AS col, {r6("sum(nir * w) / nullif(sum(w), 0)")} AS nir FROM mo JOIN k ON mo."row" = k."row" AND mo.col = k.col AND w > 0 GROUP BY 1, 2, 3""")
def reproject_bilinear(spark, sf):
    b = GR.Grid("EPSG:32632", 7, -7, 3, 75, 10, 10)
    return RS.reproject(_monthly(spark, sf), EIGHT, b, ["nir"], "bilinear").select("time", "row", "col", rounded(F.col("nir")).alias("nir"))


_KEYS = "CASE WHEN d <= 1 THEN 1.5 * d * d * d - 2.5 * d * d + 1 WHEN d < 2 THEN -0.5 * d * d * d + 2.5 * d * d - 4 * d + 2 ELSE 0 END"


@query(f"""WITH {V.CUBE}{_MONTHLY}, g AS (SELECT unnest(range(0, 10)) AS i), tr AS (SELECT i AS r, n AS "row", abs(v - n) AS d FROM (SELECT i, (80 - (75 - 7 * (i + 0.5))) / 10 - 0.5 AS v FROM g), (SELECT unnest(range(-3, 12)) AS n)),
    tc AS (SELECT i AS c, n AS col, abs(u - n) AS d FROM (SELECT i, (3 + 7 * (i + 0.5)) / 10 - 0.5 AS u FROM g), (SELECT unnest(range(-3, 12)) AS n)),
    wr AS (SELECT r, "row", {_KEYS} AS w FROM tr), wc AS (SELECT c, col, {_KEYS} AS w FROM tc)
    SELECT time, CAST(r AS INT) AS "row", CAST(c AS INT) AS col, {r6("CASE WHEN sum(wr.w * wc.w) > 0.5 THEN sum(nir * wr.w * wc.w) / sum(wr.w * wc.w) END")} AS nir
    FROM mo JOIN wr ON mo."row" = wr."row" AND wr.w <> 0 JOIN wc ON mo.col = wc.col AND wc.w <> 0 GROUP BY 1, 2, 3""")
def reproject_cubic(spark, sf):
    b = GR.Grid("EPSG:32632", 7, -7, 3, 75, 10, 10)
    return RS.reproject(_monthly(spark, sf), EIGHT, b, ["nir"], "cubic").select("time", "row", "col", rounded(F.col("nir")).alias("nir"))


def _snyder(lon: str, lat: str, zone: int) -> tuple[str, str]:
    """Easting and northing in SQL by Snyder's series in longitude, another one than the operators use."""
    e2, k = "0.0066943799901413165", 0.9996
    ep, nn = f"({e2} / (1 - {e2}))", f"(6378137.0 / sqrt(1 - {e2} * pow(sin(radians({lat})), 2)))"
    a, t, c = f"(cos(radians({lat})) * radians({lon} - {zone * 6 - 183}))", f"pow(tan(radians({lat})), 2)", f"({ep} * pow(cos(radians({lat})), 2))"
    f = f"radians({lat})"
    m = f"(6378137.0 * ((1 - {e2} / 4 - 3 * pow({e2}, 2) / 64 - 5 * pow({e2}, 3) / 256) * {f} - (3 * {e2} / 8 + 3 * pow({e2}, 2) / 32 + 45 * pow({e2}, 3) / 1024) * sin(2 * {f}) + (15 * pow({e2}, 2) / 256 + 45 * pow({e2}, 3) / 1024) * sin(4 * {f}) - (35 * pow({e2}, 3) / 3072) * sin(6 * {f})))"
    x = f"{k} * {nn} * ({a} + (1 - {t} + {c}) * pow({a}, 3) / 6 + (5 - 18 * {t} + pow({t}, 2) + 72 * {c} - 58 * {ep}) * pow({a}, 5) / 120) + 500000"
    y = f"{k} * ({m} + {nn} * tan(radians({lat})) * (pow({a}, 2) / 2 + (5 - {t} + 9 * {c} + 4 * pow({c}, 2)) * pow({a}, 4) / 24 + (61 - 58 * {t} + pow({t}, 2) + 600 * {c} - 330 * {ep}) * pow({a}, 6) / 720))"
    return x, y


#: Pixels of a kilometre at 12 degrees east, 48 north, the edge of zones 32 and 33; the target lies in zone 33.
_WEST, _EAST = GR.Grid("EPSG:32632", 1000, -1000, 720_000, 5_323_000, 8, 8), GR.Grid("EPSG:32633", 1000, -1000, 273_055, 5_323_000, 9, 9)


@query(f"""WITH {V.CUBE}, cell AS (SELECT "row", col, 720000 + 1000 * (col + 0.5) AS x, 5323000 - 1000 * ("row" + 0.5) AS y FROM (SELECT unnest(range(0, 8)) AS "row"), (SELECT unnest(range(0, 8)) AS col)),
    deg AS (SELECT lon, lat, {_snyder("lon", "lat", 32)[0]} AS x32, {_snyder("lon", "lat", 32)[1]} AS y32, {_snyder("lon", "lat", 33)[0]} AS x33, {_snyder("lon", "lat", 33)[1]} AS y33
        FROM (SELECT 11.9 + unnest(range(0, 1300)) / 5000.0 AS lon), (SELECT 47.9 + unnest(range(0, 1000)) / 5000.0 AS lat)),
    near AS (SELECT r, c, arg_min(x32, d) AS x, arg_min(y32, d) AS y, min(d) AS d, arg_min(x33, d) AS ex, arg_min(y33, d) AS ey, any_value(tx) AS tx, any_value(ty) AS ty FROM (SELECT *, 273055 + 1000 * (c + 0.5) AS tx, 5323000 - 1000 * (r + 0.5) AS ty, pow(x33 - 273055 - 1000 * (c + 0.5), 2) + pow(y33 - 5323000 + 1000 * (r + 0.5), 2) AS d
        FROM (SELECT *, CAST(floor((x33 - 273055) / 1000) AS INT) AS c, CAST(floor((5323000 - y33) / 1000) AS INT) AS r FROM deg) WHERE r BETWEEN 0 AND 8 AND c BETWEEN 0 AND 8) GROUP BY 1, 2),
    map AS (SELECT r, c, CAST(floor((5323000 - y) / 1000) AS INT) AS "row", CAST(floor((x - 720000) / 1000) AS INT) AS col FROM near)
    SELECT cube.time, m.r AS "row", m.c AS col, cube.nir FROM cube JOIN map m ON cube."row" = m."row" AND cube.col = m.col""")
def reproject_between_zones(spark, sf):
    """Nearest pixels of another UTM zone; the SQL finds them on a fine net of degrees, projected by another series."""
    return RS.reproject(V.cube(spark, sf).select("time", "row", "col", "nir"), _WEST, _EAST, ["nir"])


@query("""SELECT c_custkey AS id, round(c_custkey % 360 - 180 + 0.5, 6) AS lon, round(c_custkey % 160 - 80 + 0.25, 6) AS lat FROM customer""")
def utm_there_and_back(spark, sf):
    """Degrees to the zone's metres and back."""
    p = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 360 - 180 + 0.5).alias("lon"), (F.col("c_custkey") % 160 - 80 + 0.25).alias("lat"))
    x, y = GR.utm(F.col("lon"), F.col("lat"), GR.utm_zone(F.col("lon")))
    p = p.withColumns({"x": x, "y": y, "zone": GR.utm_zone(F.col("lon"))})
    lon, lat = GR.utm_inverse(F.col("x"), F.col("y") - F.when(F.col("lat") < 0, 1e7).otherwise(0.0), 31, False)
    return p.select("id", F.round(lon + (F.col("zone") - 31) * 6, 6).alias("lon"), F.round(lat, 6).alias("lat"))


# Grids and mosaics ----------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT p_size AS resolution, CAST(CASE WHEN lcm(p_size, 60) <= 10 * p_size THEN lcm(p_size, 60) ELSE p_size END AS DOUBLE) AS unit FROM part")
def snap_units(spark, sf):
    """For the coastal band, whose pixel is 60 m."""
    sizes = V.table(spark, sf, "part").select(F.col("p_size").alias("resolution")).distinct()
    return sizes.select("resolution", GR.snap_unit_column(F.col("resolution"), 60.0).alias("unit"))


@query("""SELECT DISTINCT CAST(code AS VARCHAR) AS code, (code BETWEEN 32601 AND 32660 OR code BETWEEN 32701 AND 32760) AS allowed FROM (SELECT 32600 + 100 * (n_nationkey % 3) + n_nationkey * 3 AS code FROM nation)""")
def allowed_systems(spark, sf):
    k = F.col("n_nationkey")
    codes = V.table(spark, sf, "nation").select((32600 + 100 * (k % 3) + k * 3).cast("string").alias("code")).distinct()
    return codes.select("code", GR.is_metric_crs(F.col("code")).alias("allowed"))


def _mosaic_query(name: str, sql: str, **how):
    def run(spark, sf):
        p = _pieces(spark, sf)
        p[2] = MO.Piece(p[2].pixels.drop("red"), p[2].grid, p[2].name, ("nir",), p[2].attrs)
        out, _, _ = MO.mosaic(p, **how)
        return out.select("time", "row", "col", *(rounded(F.col(b)).alias(b) for b in ("nir", "red") if b in out.columns))

    query(sql, name)(run)


_mosaic_query("mosaic_bands_inner", f'WITH {_PLACED} SELECT time, CAST("row" AS INT) AS "row", CAST(col AS INT) AS col, {r6("arg_min(nir, priority)")} AS nir FROM pl GROUP BY 1, 2, 3', band_join="inner")
_mosaic_query("mosaic_bands_union", f'WITH {_PLACED} SELECT time, CAST("row" AS INT) AS "row", CAST(col AS INT) AS col, {r6("arg_min(nir, priority)")} AS nir, {r6("arg_min(red, priority) FILTER (WHERE priority < 3)")} AS red FROM pl GROUP BY 1, 2, 3', band_join="union")


@query(f"""WITH {_PLACED}, two AS (SELECT * FROM pl WHERE priority < 3), d AS (SELECT time FROM two GROUP BY 1 HAVING count(DISTINCT priority) = 2)
    SELECT time, CAST("row" AS INT) AS "row", CAST(col AS INT) AS col, {r6("arg_min(nir, priority)")} AS nir FROM two WHERE time IN (SELECT time FROM d) GROUP BY 1, 2, 3""")
def mosaic_time_inner(spark, sf):
    out, _, _ = MO.mosaic(_pieces(spark, sf)[:2], time_join="inner")
    return out.select("time", "row", "col", rounded(F.col("nir")).alias("nir"))


@query("SELECT o_orderkey AS id, round(least(o_totalprice / 100, 4000) * 1000 + 1e-9, 3) AS aoi_m2 FROM orders")
def polygon_in_pieces(spark, sf):
    """A rectangle's area in pieces of a lattice, counted piece by piece, for each order's width."""
    @F.pandas_udf("double")
    def area(width):
        import pandas as pd

        ring = lambda w: [(0.0, 0.0), (w, 0.0), (w, 1000.0), (0.0, 1000.0)]
        return pd.Series([sum(GR.clipped_area(ring(w), (x, 0.0, x + 500.0, 2000.0)) for x in range(0, 4000, 500)) for w in width])

    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 100).alias("w"))
    return o.select("id", rounded(area("w"), 3).alias("aoi_m2"))


# Streams and storage --------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def passes(spark, sf):
    e = V.table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = STR.sessions(e, time="ts", key="user_id")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query(f"""WITH {V.CUBE} SELECT CAST(time AS DATE) AS day, count(*) AS n, {r6("avg(nir)")} AS nir FROM cube WHERE time >= TIMESTAMP '1996-03-01' AND time < TIMESTAMP '1997-01-01' GROUP BY 1""")
def stored_cube(spark, sf):
    """Written, swapped with a second version, opened, pruned by day."""
    path = scratch(spark, "cube")
    cube = V.cube(spark, sf).select("time", "row", "col", "nir")
    store.write_cube(cube.filter(F.year("time") == 1996), path, EIGHT, {"mission": L2A})
    old, grid, attrs, _ = store.open_cube(spark, path)
    assert grid == EIGHT and attrs["mission"] == L2A
    store.write_cube(U.append_dates(old.drop("day", "month"), cube.filter(F.year("time") > 1996)), path, EIGHT, attrs)
    now = store.open_cube(spark, path)[0]
    return store.days(now, "1996-03-01", "1996-12-31").groupBy("day").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("nir")).alias("nir"))


# Whole requests -------------------------------------------------------------------------------------------------------

_VALID = f"""(SELECT *, nir * 1e-4 AS v FROM cube WHERE {CLEAR})"""


def _request(**what) -> CubeRequest:
    return CubeRequest(**{"mission": L2A, "bands": ["red", "nir"], "cloud_masking": True, **what})


@query(f'WITH {V.CUBE} SELECT "row", col, {r6("median(v)")} AS nir FROM {_VALID} WHERE "row" BETWEEN 2 AND 5 AND col BETWEEN 1 AND 6 AND "row" + col <= 8 GROUP BY 1, 2')
def build_clip(spark, sf):
    """Day mosaic, clipped to a polygon's pixels: 10 to 75 by 20 to 60, x - y <= 15."""
    r = _request(polygon=[(10.0, 20.0), (35.0, 20.0), (75.0, 60.0), (10.0, 60.0)], clip_raster=True, aggregator="median")
    _, layers = build(r, V.pixels(spark, sf), EIGHT, F.col("ord"))
    return layers.filter("nir is not null").select("row", "col", rounded(F.col("nir")).alias("nir"))


@query(f"""WITH {V.SCENES}, ok AS (SELECT DISTINCT CAST(datetime AS DATE) AS day FROM sc WHERE cloud_cover BETWEEN 0 AND 30), {V.CUBE}
    SELECT "row", col, {r6("avg(v)")} AS nir, count(v) AS n FROM {_VALID} WHERE CAST(time AS DATE) IN (SELECT day FROM ok) GROUP BY 1, 2""")
def build_catalogue_cloud(spark, sf):
    cube, _ = build(_request(max_cc=30), V.pixels(spark, sf), EIGHT, F.col("ord"), V.scenes(spark, sf))
    return cube.pixels.filter("nir is not null").groupBy("row", "col").agg(rounded(F.avg("nir")).alias("nir"), F.count("nir").alias("n"))


@query(f"""WITH {V.SCENES}, {V.PX}, t AS (SELECT DISTINCT time FROM px), s AS (SELECT datetime, max(baseline) AS b FROM sc GROUP BY 1),
    a AS (SELECT t.time, s.b, row_number() OVER (PARTITION BY t.time ORDER BY abs(epoch_us(t.time) - epoch_us(s.datetime)), s.datetime) AS k FROM t JOIN s ON s.datetime BETWEEN t.time - INTERVAL 200 DAY AND t.time + INTERVAL 200 DAY)
    SELECT "row", {r6("avg(CASE WHEN b >= 4 THEN (l - 1000) / 10000 ELSE l / 10000 END)")} AS nir, count(*) AS n FROM (SELECT time, "row", floor(nir * 10000) AS l FROM px) p JOIN a ON a.time = p.time AND a.k = 1 GROUP BY 1""")
def build_l1c(spark, sf):
    """Raw numbers scaled by the baseline of the scene nearest in time."""
    px = V.pixels(spark, sf).withColumn("nir", F.floor(F.col("nir") * 10000))
    r = CubeRequest("sentinel_2_l1c", bands=["nir"], tile_handling="separate")
    cube, _ = build(r, px, EIGHT, scenes=V.scenes(spark, sf))
    return cube.pixels.groupBy("row").agg(rounded(F.avg("nir")).alias("nir"), F.count("nir").alias("n"))


@query(f"""WITH {V.SCENES}, az AS (SELECT CAST(datetime AS DATE) AS day, avg(sun_azimuth) AS a FROM sc GROUP BY 1), {V.CUBE}, c AS (SELECT cube.*, a FROM cube JOIN az ON CAST(time AS DATE) = day),
    cl AS (SELECT * FROM c WHERE scl IN (8, 9, 10)), o4 AS (SELECT r, c FROM (SELECT unnest(range(-4, 5)) AS r), (SELECT unnest(range(-4, 5)) AS c) WHERE r * r + c * c <= 16), o2 AS (SELECT r, c FROM o4 WHERE r * r + c * c <= 4),
    z AS (SELECT DISTINCT time, "row" + CAST(round_even(k * cos(radians(a)), 0) AS INT) AS "row", col + CAST(round_even(-k * sin(radians(a)), 0) AS INT) AS col FROM cl, (SELECT unnest(range(10, 41, 10)) AS k)),
    d AS (SELECT DISTINCT c.time, c."row", c.col FROM c JOIN z ON c.time = z.time AND c."row" = z."row" AND c.col = z.col WHERE nir > 0 AND nir * 1e-4 < 0.18 AND scl NOT IN (0, 6)),
    m AS (SELECT DISTINCT time, r, col FROM (SELECT time, unnest([ "row", -1 - "row", 15 - "row" ]) AS r, col FROM d) WHERE r BETWEEN -4 AND 11), n AS (SELECT DISTINCT time, r, c FROM (SELECT time, r, unnest([ col, -1 - col, 15 - col ]) AS c FROM m) WHERE c BETWEEN -4 AND 11),
    v AS (SELECT time, n.r + o4.r AS "row", n.c + o4.c AS col FROM n, o4 GROUP BY 1, 2, 3 HAVING count(*) > 24.5), g AS (SELECT DISTINCT time, "row" + r AS "row", col + o2.c AS col FROM v, o2 WHERE "row" BETWEEN 0 AND 7 AND col BETWEEN 0 AND 7)
    SELECT "row", col, count(*) AS n, {r6("avg(nir * 1e-4)")} AS nir FROM c WHERE {CLEAR} AND NOT EXISTS (SELECT 1 FROM g WHERE g.time = c.time AND g."row" = c."row" AND g.col = c.col) GROUP BY 1, 2""")
def build_shadows(spark, sf):
    cube, _ = _seen_days(spark, sf)
    r = _request(shadow_masking=True, shadow_proj_distance=0.4, tile_handling="separate")
    out, _ = build(r, cube, EIGHT, scenes=V.scenes(spark, sf))
    return out.pixels.filter("nir is not null").groupBy("row", "col").agg(F.count("nir").alias("n"), rounded(F.avg("nir")).alias("nir"))


@query(f"""WITH {V.CUBE}, v AS {_VALID} SELECT 'max_annual' AS kind, strftime(time, '%Y') AS label, count(DISTINCT ("row", col)) AS cells, {r6("max(v)")} AS nir FROM v GROUP BY 2
    UNION ALL SELECT 'spring', CAST(year(time) AS VARCHAR), count(DISTINCT ("row", col)), {r6("max(v)")} FROM v WHERE month(time) BETWEEN 3 AND 5 AND year(time) IN (1995, 1996) GROUP BY 2""")
def build_composites_only(spark, sf):
    """Named and own composites, without a time series."""
    r = _request(keep_timeseries=False, stats=["max_annual", {"op": "max", "start": "03-01", "end": "05-31", "years": [1995, 1996], "name": "spring"}])
    cube, layers = build(r, V.pixels(spark, sf), EIGHT, F.col("ord"))
    assert cube is None
    kind = F.when(F.col("layer").startswith("spring"), "spring").otherwise("max_annual").alias("kind")
    rows = layers.filter("nir is not null").groupBy(kind, F.element_at(F.split("layer", "_"), -1).alias("label"))
    return rows.agg(F.count_distinct("row", "col").alias("cells"), rounded(F.max("nir")).alias("nir"))


@query(f"""WITH {V.CUBE} SELECT year(time) AS y, count(*) AS n, {r6("avg(v)")} AS nir FROM {_VALID} WHERE year(time) IN (1996, 1997) GROUP BY 1""")
def build_update(spark, sf):
    """One year written, the next added to it by an update; days that are there are not taken again."""
    path, px = scratch(spark, "cube"), V.pixels(spark, sf)
    build(_request(bands=["nir"], daterange=["1996-01-01", "1996-12-31"], output=path), px, EIGHT, F.col("ord"))
    cube, _ = build(_request(bands=["nir"], daterange=["1996-06-01", "1997-12-31"], update=path), px, EIGHT, F.col("ord"))
    return cube.pixels.filter("nir is not null").groupBy(F.year("time").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("nir")).alias("nir"))


@query(f"""WITH {V.SCENES}, d AS (SELECT CAST(datetime AS DATE) AS day, avg(sun_azimuth) AS a FROM sc GROUP BY 1), {V.CUBE}
    SELECT cube.time, CAST(coalesce(floor(100.0 * count(*) FILTER (WHERE scl IN (8, 9, 10)) / nullif(count(*) FILTER (WHERE scl <> 0), 0) + 0.5), 0) AS SMALLINT) AS cloud_percentage, {r6("max(d.a)")} AS sun_azimuth
    FROM cube LEFT JOIN d ON CAST(cube.time AS DATE) = d.day GROUP BY 1""")
def build_metadata(spark, sf):
    cube, _ = build(_request(scene_metadata=["sun_azimuth"]), V.pixels(spark, sf), EIGHT, F.col("ord"), V.scenes(spark, sf))
    return cube.stats.select("time", "cloud_percentage", rounded(F.col("sun_azimuth")).alias("sun_azimuth"))


@query(f"""WITH {V.CUBE} SELECT CAST("row" // 2 AS INT) AS "row", CAST(col // 2 AS INT) AS col, {r6("max(CASE WHEN " + CLEAR + " THEN nir * 1e-4 END)")} AS nir FROM cube WHERE "row" % 2 = 1 AND col % 2 = 1 GROUP BY 1, 2""")
def build_coarser(spark, sf):
    """Twice the pixel size by the nearest pixel: a coarse centre lies on a corner and takes the pixel beyond it."""
    _, layers = build(_request(bands=["nir"], resolution=20, stats=["max"]), V.pixels(spark, sf), EIGHT, F.col("ord"))
    return layers.select("row", "col", rounded(F.col("nir")).alias("nir"))


@query(f"""WITH {V.CUBE}, f AS (SELECT *, ord % 3 AS f FROM px), m AS (SELECT f, time, "row", col, arg_min(nir, ord) AS nir, arg_min(scl, ord) AS scl FROM f GROUP BY 1, 2, 3, 4),
    st AS (SELECT f, time, 100.0 * count(*) FILTER (WHERE scl IN (8, 9, 10)) / nullif(count(*) FILTER (WHERE scl <> 0), 0) AS cp FROM m GROUP BY 1, 2)
    SELECT f AS feature_id, strftime(time, '%Y') AS label, "row", col, {r6("min(CASE WHEN " + CLEAR + " THEN nir * 1e-4 END)")} AS nir FROM m JOIN st USING (f, time) WHERE coalesce(floor(cp + 0.5), 0) <= 40 GROUP BY 1, 2, 3, 4""")
def build_features_filtered(spark, sf):
    from .plans.cube import build_features

    px = V.pixels(spark, sf).withColumn("feature_id", F.col("ord") % 3)
    out = build_features(_request(bands=["nir"], scene_cloud_coverage=40, stats=["min_annual"]), px, EIGHT, order=F.col("ord"))
    return out.select("feature_id", F.substring("layer", 5, 4).alias("label"), "row", "col", rounded(F.col("nir")).alias("nir"))
