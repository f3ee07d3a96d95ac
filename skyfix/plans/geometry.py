"""Queries of the geometry and camera functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyfix.functions import camera, geo
from skyfix.plans.fixtures import ctes, view
from skyfix.plans.registry import query

PI4, PI2 = "0.7853981633974483e0", "1.5707963267948966e0"
R, WORLD = "6378137e0", "40075016.68557849e0"


def merc_x(lon):
    return f"(radians({lon}) * {R})"


def merc_y(lat):
    return f"({R} * ln(tan({PI4} + radians({lat}) / 2e0)))"


def lon_of(x):
    return f"degrees(({x}) / {R})"


def lat_of(y):
    return f"degrees(2e0 * atan(exp(({y}) / {R})) - {PI2})"


def hav(a, b, c, d):
    return f"2e0 * {R} * asin(sqrt(pow(sin(radians({c} - {a}) / 2e0), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2e0), 2)))"


def m_lat(lat):
    return f"(111132.92e0 - 559.82e0 * cos(2e0 * radians({lat})) + 1.175e0 * cos(4e0 * radians({lat})))"


def m_lon(lat):
    return f"(111412.84e0 * cos(radians({lat})) - 93.5e0 * cos(3e0 * radians({lat})))"


@query("mercator_roundtrip", ctes("points") + f"""
SELECT event_id, round(x, 3) AS x, round(y, 3) AS y, round({lon_of('x')}, 9) AS lon, round({lat_of('y')}, 9) AS lat
FROM (SELECT event_id, {merc_x('lon')} AS x, {merc_y('lat')} AS y FROM points) p""")
def mercator_roundtrip(spark, sf_dir):
    x, y = geo.to_mercator(F.col("lon"), F.col("lat"))
    rows = view(spark, sf_dir, "points").select("event_id", x.alias("x"), y.alias("y"))
    lon, lat = geo.from_mercator(F.col("x"), F.col("y"))
    return rows.select("event_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))


@query("haversine", ctes("frame_scores") + " SELECT frame, round(err_m, 6) AS err_m FROM frame_scores WHERE est_lat IS NOT NULL")
def haversine(spark, sf_dir):
    rows = view(spark, sf_dir, "frame_scores").where("est_lat is not null")
    return rows.select("frame", F.round(geo.haversine(F.col("gt_lat"), F.col("gt_lon"), F.col("est_lat"), F.col("est_lon")), 6).alias("err_m"))


@query("local_plane", ctes("points") + f"""
SELECT event_id, round(east, 6) AS east, round(north, 6) AS north, round(43.521955e0 + north / {m_lat('43.521955e0')}, 9) AS lat, round(-5.62429e0 + east / {m_lon('43.521955e0')}, 9) AS lon
FROM (SELECT event_id, (lon - -5.62429e0) * {m_lon('43.521955e0')} AS east, (lat - 43.521955e0) * {m_lat('43.521955e0')} AS north FROM points) p""")
def local_plane(spark, sf_dir):
    ref = F.lit(43.521955), F.lit(-5.62429)
    e, n = geo.to_local(F.col("lat"), F.col("lon"), *ref)
    rows = view(spark, sf_dir, "points").select("event_id", e.alias("east"), n.alias("north"))
    lat, lon = geo.from_local(F.col("east"), F.col("north"), *ref)
    return rows.select("event_id", F.round("east", 6).alias("east"), F.round("north", 6).alias("north"), F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))


@query("tile_bbox", ctes("points") + f"""
SELECT event_id, round({merc_x('lon')} - span_m / 2e0, 3) AS minx, round({merc_y('lat')} - span_m / 2e0, 3) AS miny, round({merc_x('lon')} + span_m / 2e0, 3) AS maxx, round({merc_y('lat')} + span_m / 2e0, 3) AS maxy,
  round(span_m / 640e0, 6) AS m_per_px FROM points""")
def tile_bbox(spark, sf_dir):
    box = geo.bbox_around(F.col("lon"), F.col("lat"), F.col("span_m"))
    names = ["minx", "miny", "maxx", "maxy"]
    rows = view(spark, sf_dir, "points").select("event_id", F.struct(*[c.alias(n) for c, n in zip(box, names)], F.lit(640).alias("width"), F.lit(640).alias("height")).alias("tile"))
    return rows.select("event_id", *[F.round(f"tile.{n}", 3).alias(n) for n in names], F.round(geo.metres_per_pixel()[0], 6).alias("m_per_px"))


def with_tile(spark, sf_dir, rows):
    """The one tile beside every row."""
    tile = view(spark, sf_dir, "tile_row").select(F.struct("*").alias("tile"))
    return rows.join(F.broadcast(tile))


PX = "((event_id * 37) % 3072)", "((event_id * 53) % 3072)"


@query("pixel_maps", ctes("points", "tile_row") + f"""
SELECT event_id, round(x, 3) AS x, round(y, 3) AS y, round({lon_of('x')}, 9) AS lon, round({lat_of('y')}, 9) AS lat,
  round(({merc_x(lon_of('x'))} - minx) / ((maxx - minx) / width), 3) AS px, round((maxy - {merc_y(lat_of('y'))}) / ((maxy - miny) / height), 3) AS py
FROM (SELECT event_id, minx, miny, maxx, maxy, width, height, minx + {PX[0]} * ((maxx - minx) / width) AS x, maxy - {PX[1]} * ((maxy - miny) / height) AS y FROM points, tile_row) p""")
def pixel_maps(spark, sf_dir):
    rows = with_tile(spark, sf_dir, view(spark, sf_dir, "points"))
    x, y = geo.pixel_to_mercator(F.expr(PX[0]), F.expr(PX[1]))
    lon, lat = geo.from_mercator(F.col("x"), F.col("y"))
    px, py = geo.mercator_to_pixel(*geo.to_mercator(lon, lat))
    return rows.select("event_id", "tile", x.alias("x"), y.alias("y")).select("event_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"), F.round(px, 3).alias("px"), F.round(py, 3).alias("py"))


@query("xyz_tile_cover", ctes("points") + f""",
z AS (SELECT event_id, {merc_x('lon')} AS x, {merc_y('lat')} AS y, span_m, cast(greatest(0, least(17, ceil(log2({WORLD} * 640 / (256 * span_m))))) AS integer) AS zoom FROM points),
g AS (SELECT event_id, zoom, (x - span_m / 2e0 + {WORLD} / 2e0) / {WORLD} * (256 * pow(2e0, zoom)) AS l, (x + span_m / 2e0 + {WORLD} / 2e0) / {WORLD} * (256 * pow(2e0, zoom)) AS r,
  ({WORLD} / 2e0 - (y + span_m / 2e0)) / {WORLD} * (256 * pow(2e0, zoom)) AS t, ({WORLD} / 2e0 - (y - span_m / 2e0)) / {WORLD} * (256 * pow(2e0, zoom)) AS b FROM z),
xs AS (SELECT event_id, zoom, t, b, unnest(range(cast(floor(l / 256) AS bigint), cast(floor((r - 1e-6) / 256) AS bigint) + 1)) AS tx FROM g)
SELECT event_id, cast(zoom AS bigint) AS zoom, cast(tx % cast(pow(2, zoom) AS bigint) AS bigint) AS tile_x, unnest(range(cast(floor(t / 256) AS bigint), cast(floor((b - 1e-6) / 256) AS bigint) + 1)) AS tile_y FROM xs""")
def xyz_tile_cover(spark, sf_dir):
    box = geo.bbox_around(F.col("lon"), F.col("lat"), F.col("span_m"))
    rows = view(spark, sf_dir, "points").select("event_id", *[c.alias(n) for c, n in zip(box, ("minx", "miny", "maxx", "maxy"))], geo.zoom_for(F.col("span_m"), F.lit(640), 17).alias("zoom"))
    left, top = geo.global_pixel(F.col("minx"), F.col("maxy"), F.col("zoom"))
    right, bottom = geo.global_pixel(F.col("maxx"), F.col("miny"), F.col("zoom"))
    cover = lambda lo, hi: F.explode(F.sequence(F.floor(lo / geo.TILE_PX).cast("long"), F.floor((hi - 1e-6) / geo.TILE_PX).cast("long")))
    rows = rows.withColumn("tx", cover(left, right)).withColumn("tile_y", cover(top, bottom))
    return rows.select("event_id", F.col("zoom").cast("long").alias("zoom"), F.pmod("tx", F.pow(F.lit(2), F.col("zoom")).cast("long")).alias("tile_x"), "tile_y")


@query("world_crop_rect", ctes("points", "tile_row") + f""",
p AS (SELECT event_id, span_m, width, height, minx, maxy, (maxx - minx) / width AS sx, (maxy - miny) / height AS sy, {merc_x('(-5.62429e0 + ((event_id % 61) - 30) * 1e-4)')} AS x, {merc_y('(43.521955e0 + ((event_id % 53) - 26) * 1e-4)')} AS y FROM points, tile_row),
r AS (SELECT event_id, minx, maxy, sx, sy, greatest(0, cast(round_even((x - span_m / 2e0 - minx) / sx, 0) AS bigint)) AS x0, greatest(0, cast(round_even((maxy - (y + span_m / 2e0)) / sy, 0) AS bigint)) AS y0,
  least(width, cast(round_even((x + span_m / 2e0 - minx) / sx, 0) AS bigint)) AS x1, least(height, cast(round_even((maxy - (y - span_m / 2e0)) / sy, 0) AS bigint)) AS y1 FROM p)
SELECT event_id, x0, y0, x1, y1, round(minx + x0 * sx, 3) AS minx, round(maxy - y1 * sy, 3) AS miny FROM r WHERE x1 - x0 >= 2 AND y1 - y0 >= 2""")
def world_crop_rect(spark, sf_dir):
    rows = with_tile(spark, sf_dir, view(spark, sf_dir, "points"))
    rect = geo.crop_rect(F.expr("-5.62429e0 + ((event_id % 61) - 30) * 1e-4"), F.expr("43.521955e0 + ((event_id % 53) - 26) * 1e-4"), F.col("span_m"))
    rows = rows.select("event_id", "tile", *[c.alias(n) for c, n in zip(rect, ("x0", "y0", "x1", "y1"))]).where("x1 - x0 >= 2 and y1 - y0 >= 2")
    minx, miny = geo.pixel_to_mercator(F.col("x0"), F.col("y1"))
    return rows.select("event_id", "x0", "y0", "x1", "y1", F.round(minx, 3).alias("minx"), F.round(miny, 3).alias("miny"))


SIZE = "(event_id * event_id * event_id * 97e0)"


@query("human_bytes", f"""SELECT event_id, CASE WHEN n < 1024 THEN printf('%.1f B', n) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024e0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576e0)
  WHEN n < 1099511627776 THEN printf('%.1f GB', n / 1073741824e0) WHEN n < 1125899906842624 THEN printf('%.1f TB', n / 1099511627776e0) ELSE printf('%.1f PB', n / 1125899906842624e0) END AS size FROM (SELECT event_id, {SIZE} AS n FROM events) e""")
def human_bytes(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", geo.human_bytes(F.expr(SIZE.replace("event_id", "cast(event_id as double)"))).alias("size"))  # the cube of an id over 2,097,151 is no long


def _homographies(spark, sf_dir):
    h = F.expr("array(a, -b, tx, b, a, ty, g, 0e0, 1e0)")
    return with_tile(spark, sf_dir, view(spark, sf_dir, "homographies").select("frame", h.alias("h")))


def at(x, y):
    """SQL of where a frame point lands in the tile."""
    return f"((a * {x} - b * {y} + tx) / (g * {x} + 1e0))", f"((b * {x} + a * {y} + ty) / (g * {x} + 1e0))"


C, U, RT = at("640e0", "360e0"), at("640e0", "359e0"), at("641e0", "360e0")
SX, SY = "((maxx - minx) / width)", "((maxy - miny) / height)"


@query("pose_from_homography", ctes("homographies", "tile_row") + f""",
p AS (SELECT *, {C[0]} AS px, {C[1]} AS py, {U[0]} AS ux, {U[1]} AS uy, {RT[0]} AS rx, {RT[1]} AS ry FROM homographies, tile_row),
q AS (SELECT *, {lat_of(f'maxy - py * {SY}')} AS lat, {lon_of(f'minx + px * {SX}')} AS lon, degrees(atan2(ux - px, py - uy)) AS yaw FROM p)
SELECT frame, round(lat, 9) AS lat, round(lon, 9) AS lon, round(CASE WHEN yaw < 0 THEN yaw + 360e0 ELSE yaw END, 6) AS yaw_deg,
  round(sqrt((rx - px) * (rx - px) + (ry - py) * (ry - py)) * {SX} * cos(radians(lat)), 9) AS ground_m_per_px FROM q""")
def pose_from_homography(spark, sf_dir):
    p = camera.pose(F.col("h"), F.lit(1280.0), F.lit(720.0))
    return _homographies(spark, sf_dir).select("frame", F.round(p["lat"], 9).alias("lat"), F.round(p["lon"], 9).alias("lon"), F.round(p["yaw_deg"], 6).alias("yaw_deg"), F.round(p["ground_m_per_px"], 9).alias("ground_m_per_px"))


Q = [at(x, y) for x, y in (("0e0", "0e0"), ("1280e0", "0e0"), ("1280e0", "720e0"), ("0e0", "720e0"))]
QS = ", ".join(f"{Q[i][j]} AS q{'xy'[j]}{i}" for i in range(4) for j in range(2))


def seg(a, b):
    return f"sqrt(pow(qx{b} - qx{a}, 2) + pow(qy{b} - qy{a}, 2))"


@query("altitude_agl", ctes("homographies", "tile_row") + f""",
p AS (SELECT *, {C[1]} AS py, {QS} FROM homographies, tile_row),
q AS (SELECT *, ({seg(0, 1)} + {seg(3, 2)}) / 2e0 AS across, ({seg(0, 3)} + {seg(1, 2)}) / 2e0 AS down, cos(radians({lat_of(f'maxy - py * {SY}')})) AS k FROM p)
SELECT frame, round(across * {SX} * k / 2e0 / tan(radians(84e0) / 2e0), 6) AS agl_m, round(across * {SX} * k, 6) AS ground_width_m, round(down * {SY} * k, 6) AS ground_height_m,
  round(across * {SX} * k / 1280e0, 9) AS gsd_m_per_px, round((across / 1280e0) / (down / 720e0), 9) AS tilt_ratio FROM q""")
def altitude_agl(spark, sf_dir):
    a = camera.altitude(F.col("h"), F.lit(1280.0), F.lit(720.0), F.lit(camera.HFOV))
    digits = {"agl_m": 6, "ground_width_m": 6, "ground_height_m": 6, "gsd_m_per_px": 9, "tilt_ratio": 9}
    return _homographies(spark, sf_dir).select("frame", *[F.round(a[n], d).alias(n) for n, d in digits.items()])


@query("scene_search", """WITH s AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS alt, CASE WHEN event_id % 3 = 0 THEN 70e0 + event_id % 20 WHEN event_id % 3 = 1 THEN degrees(2e0 * atan(4000e0 / (2e0 * (2000e0 + event_id % 700)))) END AS fov FROM events),
f AS (SELECT event_id, CASE WHEN alt > 0 AND fov IS NOT NULL THEN 2e0 * alt * tan(radians(fov) / 2e0) END AS span FROM s)
SELECT event_id, coalesce(round_even(round_even(span, 9), 1), 120e0) AS radius_m, coalesce(round_even(round_even(span / 2e0, 9), 1), 60e0) AS grid_step_m, coalesce(round_even(round_even(span * 0.6e0, 9), 1), 50e0) AS scale_0, coalesce(round_even(round_even(span * 0.85e0, 9), 1), 80e0) AS scale_1,
  coalesce(round_even(round_even(span * 1.1e0, 9), 1), 110e0) AS scale_2, coalesce(round_even(round_even(span * 1.4e0, 9), 1), 140e0) AS scale_3 FROM f""")
def scene_search(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    alt = F.expr("case when event_id % 5 = 0 then null else value end")
    fov = camera.field_of_view(F.expr("case when event_id % 3 = 0 then 70e0 + event_id % 20 end"), F.expr("case when event_id % 3 = 1 then 2000e0 + event_id % 700 end"), F.lit(4000.0))
    return events.select("event_id", *[c.alias(n) for n, c in camera.search_for(alt, fov).items()])


TAGS = {
    "CalibratedFocalLength": "case when event_id % 4 = 0 then cast(3713 + event_id % 9 as string) when event_id % 4 = 1 then 'n/a' end",
    "FocalLength": "case when event_id % 3 <> 0 then cast(24 + event_id % 5 as string) end",
    "SensorWidth": "case when event_id % 5 = 0 then '36' end",
    "FocalPlaneXResolution": "case when event_id % 5 in (1, 2) then cast(250 + event_id % 3 as string) end",
    "FocalPlaneResolutionUnit": "case when event_id % 7 < 5 then cast(event_id % 7 as string) end",
    "FocalLengthIn35mmFormat": "case when event_id % 2 = 0 then '24' end",
    "ImageWidth": "case when event_id % 13 <> 0 then '6000' end",
}


@query("focal_precedence", "WITH t AS (SELECT event_id, " + ", ".join(f"try_cast({sql.replace('as string', 'as varchar')} AS double) AS {n}" for n, sql in TAGS.items()) + """ FROM events),
s AS (SELECT *, coalesce(SensorWidth, CASE WHEN FocalPlaneXResolution > 0 THEN ImageWidth / FocalPlaneXResolution * CASE FocalPlaneResolutionUnit WHEN 2 THEN 25.4e0 WHEN 3 THEN 10e0 WHEN 4 THEN 1e0 ELSE 25.4e0 END END) AS sensor FROM t)
SELECT event_id, round(coalesce(CalibratedFocalLength, CASE WHEN sensor > 0 THEN FocalLength * ImageWidth / sensor END, FocalLengthIn35mmFormat / 36e0 * ImageWidth), 6) AS focal_px, round(sensor, 6) AS sensor_mm FROM s""")
def focal_precedence(spark, sf_dir):
    tags = {n: F.expr(sql) for n, sql in TAGS.items()}
    sensor = camera.sensor_width(tags, camera.number(tags["ImageWidth"]))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.round(camera.focal_px(tags), 6).alias("focal_px"), F.round(sensor, 6).alias("sensor_mm"))


@query("link_decompose", ctes("homographies") + " SELECT frame, round(atan2(b / 2e0, a / 2e0), 9) AS theta, round(tx, 6) AS tx, round(ty, 6) AS ty, round(g, 9) AS g FROM homographies")
def link_decompose(spark, sf_dir):
    h = F.expr("array(2 * a, -2 * b, 2 * tx, 2 * b, 2 * a, 2 * ty, 2 * g, 0e0, 2e0)")
    theta, tx, ty = camera.planar_motion(F.col("h"))
    rows = view(spark, sf_dir, "homographies").select("frame", h.alias("h"))
    return rows.select("frame", F.round(theta, 9).alias("theta"), F.round(tx, 6).alias("tx"), F.round(ty, 6).alias("ty"), F.round(camera.normalised(F.col("h"))[6], 9).alias("g"))


@query("map_extent_tiles", f"""WITH r AS (SELECT event_id, -5.7e0 + (event_id % 50) * 1e-3 AS a, -5.7e0 + (event_id % 41) * 1e-3 AS b, 43.5e0 + (event_id % 37) * 1e-3 AS c, 43.5e0 + (event_id % 29) * 1e-3 AS d FROM events)
SELECT event_id, round({merc_x('least(a, b)')}, 3) AS minx, round({merc_y('least(c, d)')}, 3) AS miny, round({merc_x('greatest(a, b)')}, 3) AS maxx, round({merc_y('greatest(c, d)')}, 3) AS maxy FROM r""")
def map_extent_tiles(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "-5.7e0 + (event_id % 50) * 1e-3 as a", "-5.7e0 + (event_id % 41) * 1e-3 as b", "43.5e0 + (event_id % 37) * 1e-3 as c", "43.5e0 + (event_id % 29) * 1e-3 as d")
    minx, miny = geo.to_mercator(F.least("a", "b"), F.least("c", "d"))
    maxx, maxy = geo.to_mercator(F.greatest("a", "b"), F.greatest("c", "d"))
    return rows.select("event_id", *[F.round(c, 3).alias(n) for c, n in ((minx, "minx"), (miny, "miny"), (maxx, "maxx"), (maxy, "maxy"))])
