"""Camera and homography arithmetic as column expressions. A homography is an array of nine doubles, row by row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfix.functions import geo

#: Default field of view, the factors of the scale ladder, the search without a known altitude.
HFOV, LADDER = 84.0, (0.6, 0.85, 1.1, 1.4)
DEFAULT_SEARCH = {"radius_m": 120.0, "grid_step_m": 60.0, "scales_m": (50.0, 80.0, 110.0, 140.0)}
#: Millimetres in a focal-plane unit by its code (else an inch), width of the 35 mm frame.
PLANE_UNIT_MM, INCH_MM, FULL_FRAME_MM = {2: 25.4, 3: 10.0, 4: 1.0}, 25.4, 36.0


#: Fixed value: beyond this tilt a decomposition isn't trusted.
MAX_TILT_DEG = 75.0
#: Under which tags the width of an image is found, the first that is there.
WIDTH_TAGS = ("ImageWidth", "ExifImageWidth", "PixelXDimension")


def project(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    w = h[6] * x + h[7] * y + h[8]
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def normalised(h: Column) -> Column:
    return F.transform(h, lambda v: v / h[8])


def planar_motion(h: Column) -> tuple[Column, Column, Column]:
    """Rotation and translation (theta, tx, ty) of the linear part."""
    return F.atan2(h[3] / h[8], h[0] / h[8]), h[2] / h[8], h[5] / h[8]


def inverse(h: Column) -> Column:
    """The inverse by cofactors; null if singular."""
    a, b, c, d, e, f, g, i, j = (h[k] for k in range(9))
    det = a * (e * j - f * i) - b * (d * j - f * g) + c * (d * i - e * g)
    parts = [e * j - f * i, c * i - b * j, b * f - c * e, f * g - d * j, a * j - c * g, c * d - a * f, d * i - e * g, b * g - a * i, a * e - b * d]
    return F.when(det != 0, F.array(*[p / det for p in parts]))


def product(p: Column, q: Column) -> Column:
    return F.array(*[p[3 * r] * q[c] + p[3 * r + 1] * q[3 + c] + p[3 * r + 2] * q[6 + c] for r in range(3) for c in range(3)])


def intrinsics(focal_px: Column, cx: Column, cy: Column, width: Column, height: Column) -> Column:
    zero = F.lit(0.0)
    return F.array(focal_px, zero, F.coalesce(cx, width / 2), zero, focal_px, F.coalesce(cy, height / 2), zero, zero, F.lit(1.0))


def pose(h: Column, width: Column, height: Column, tile: str = "tile") -> dict[str, Column]:
    """Position under the frame's centre, heading of its upper edge, ground metres of a frame pixel."""
    cx, cy = width / 2, height / 2
    px, py = project(h, cx, cy)
    lon, lat = geo.from_mercator(*geo.pixel_to_mercator(px, py, tile))
    ux, uy = project(h, cx, cy - 1.0)
    rx, ry = project(h, cx + 1.0, cy)
    yaw = F.degrees(F.atan2(ux - px, py - uy))
    yaw = F.when(yaw < 0, yaw + 360.0).otherwise(yaw)
    return {"lat": lat, "lon": lon, "yaw_deg": yaw, "ground_m_per_px": F.hypot(rx - px, ry - py) * geo.metres_per_pixel(tile)[0] * F.cos(F.radians(lat))}


def let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _inverses(m: list) -> list:
    """inverse() of matrices given as nine arrays; NaN where singular."""
    a, b, c, d, e, f, g, i, j = m
    det = a * (e * j - f * i) - b * (d * j - f * g) + c * (d * i - e * g)
    det = np.where(det != 0, det, np.nan)
    return [p / det for p in (e * j - f * i, c * i - b * j, b * f - c * e, f * g - d * j, a * j - c * g, c * d - a * f, d * i - e * g, b * g - a * i, a * e - b * d)]


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("east_m", "north_m", "altitude_m", "tilt_deg")]))
def _ground_poses(*m: pd.Series) -> pd.DataFrame:
    """Of the numbers of many homographies and intrinsics, one column each."""
    with np.errstate(all="ignore"):
        g, k = (_inverses([x.to_numpy(float) for x in part]) for part in (m[:9], m[9:]))
        b = [k[3 * r] * g[c] + k[3 * r + 1] * g[3 + c] + k[3 * r + 2] * g[6 + c] for r in range(3) for c in range(3)]
        c = [np.stack([b[3 * i + j] for i in range(3)]) for j in range(3)]
        u, v, shift = (x / ((np.sqrt((c[0] ** 2).sum(axis=0)) + np.sqrt((c[1] ** 2).sum(axis=0))) / 2) for x in c)
        p, q, s, x, y = (u * u).sum(axis=0), (u * v).sum(axis=0), (v * v).sum(axis=0), (u * shift).sum(axis=0), (v * shift).sum(axis=0)
        d = np.sqrt(p * s - q * q)
        f = np.sqrt(p + s + 2 * d) / ((p + d) * (s + d) - q * q)
        east, north = -f * ((s + d) * x - q * y), -f * ((p + d) * y - q * x)
        third = np.cross(u, v, axis=0) / d  # the third axis: the cross product of the first two, whose length is d
        height, tilt = np.abs((third * shift).sum(axis=0)), np.degrees(np.arccos(np.clip(-third[2], -1, 1)))
        fine = (d > 0) & (height > 0) & (height < np.inf) & ~np.isnan(east) & ~np.isnan(north) & (tilt <= MAX_TILT_DEG)
    return pd.DataFrame({n: np.where(fine, z, np.nan) for n, z in (("east_m", east), ("north_m", north), ("altitude_m", height), ("tilt_deg", tilt))})


def ground_pose(g: Column | list[Column], k: Column) -> Column:
    """Of a frame-to-ground-metres homography (or its nine numbers) and the intrinsics: struct of the camera's foot point east and north of the frame's centre, height and tilt.

    With B = inv(K) inv(G), the first two columns scaled to a mean length of one are two axes of the camera that are nearly at right angles. The nearest rotation
    turns them to (A'A)^(-1/2) times themselves, which has a closed form for two columns; the third axis is their cross product. The sign of the scale changes
    the height's sign only, so the height is taken above ground. Null if a matrix is singular, the height is none, or the tilt is over MAX_TILT_DEG."""
    found = _ground_poses(*[m[i].cast("double") for m in (g, k) for i in range(9)])
    return F.when(found["altitude_m"].isNotNull() & ~F.isnan(found["altitude_m"]), found)


def nadir_pose(h: Column, width: Column, height: Column, k: Column, tile: str = "tile") -> dict[str, Column]:
    """pose(), moved from the point under the frame's centre to the camera's foot point where the intrinsics k (else null) tell it; with tilt, height and whether it was moved."""
    seen = pose(h, width, height, tile)
    sx, sy = geo.metres_per_pixel(tile)
    x, y = geo.pixel_to_mercator(*project(h, width / 2, height / 2), tile)
    shrink = F.cos(F.radians(seen["lat"]))
    mx, my = shrink * (F.col(f"{tile}.minx") - x), shrink * (F.col(f"{tile}.maxy") - y)
    # tile to ground times h, number by number: an array would be copied whole for each of its numbers when the query is planned
    ground = [shrink * sx * h[c] + mx * h[6 + c] for c in range(3)] + [my * h[6 + c] - shrink * sy * h[3 + c] for c in range(3)] + [h[6 + c] for c in range(3)]
    found = ground_pose(ground, k)
    lon, lat = geo.from_mercator(x + found["east_m"] / shrink, y + found["north_m"] / shrink)
    return seen | {"lat": F.coalesce(lat, seen["lat"]), "lon": F.coalesce(lon, seen["lon"]), "tilt_deg": found["tilt_deg"], "altitude_m": found["altitude_m"], "tilt_corrected": found.isNotNull()}


def altitude(h: Column, width: Column, height: Column, hfov: Column, tile: str = "tile") -> dict[str, Column]:
    """Height above ground from the footprint of the frame's corners; null where the footprint is degenerate."""
    zero = F.lit(0.0)
    q = [project(h, x, y) for x, y in ((zero, zero), (width, zero), (width, height), (zero, height))]
    side = lambda a, b: F.hypot(q[b][0] - q[a][0], q[b][1] - q[a][1])
    across, down = (side(0, 1) + side(3, 2)) / 2, (side(0, 3) + side(1, 2)) / 2
    cross = sum((q[i][0] * q[(i + 1) % 4][1] - q[(i + 1) % 4][0] * q[i][1] for i in range(1, 4)), q[0][0] * q[1][1] - q[1][0] * q[0][1])
    degenerate = (across < 1e-6) | (down < 1e-6) | (F.abs(cross) / 2 < across * down * 0.5e-3)
    _, lat = geo.from_mercator(*geo.pixel_to_mercator(*project(h, width / 2, height / 2), tile))
    sx, sy = geo.metres_per_pixel(tile)
    ground = across * sx * F.cos(F.radians(lat))
    return {"agl_m": F.when(~degenerate, ground / 2 / F.tan(F.radians(hfov) / 2)), "ground_width_m": ground, "ground_height_m": down * sy * F.cos(F.radians(lat)), "gsd_m_per_px": ground / width, "degenerate": degenerate, "tilt_ratio": (across / width) / (down / height)}


def field_of_view(hfov: Column, focal_px: Column, width: Column) -> Column:
    """As told, else from a focal length and width that aren't null or zero."""
    derived = F.when((focal_px != 0) & (width != 0), F.degrees(2 * F.atan(width / (2 * focal_px))))
    return F.coalesce(hfov, derived)


def search_for(altitude_m: Column, fov: Column) -> dict[str, Column]:
    """Search radius, step and scale ladder from the expected footprint, or the defaults."""
    known = (altitude_m > 0) & fov.isNotNull()
    span = 2 * altitude_m * F.tan(F.radians(fov) / 2)
    # the noise of a tangent is rounded off first, so that it doesn't decide ties
    pick = lambda c, default: F.when(known, F.bround(F.bround(c, 9), 1)).otherwise(F.lit(default))
    out = {"radius_m": pick(span, DEFAULT_SEARCH["radius_m"]), "grid_step_m": pick(span / 2, DEFAULT_SEARCH["grid_step_m"])}
    return out | {f"scale_{i}": pick(span * f, d) for i, (f, d) in enumerate(zip(LADDER, DEFAULT_SEARCH["scales_m"]))}


def number(c: Column) -> Column:
    return F.expr(f"try_cast({c} as double)") if isinstance(c, str) else c.try_cast("double")


def sensor_width(tags: dict[str, Column], width_px: Column) -> Column:
    res, unit = number(tags["FocalPlaneXResolution"]), number(tags["FocalPlaneResolutionUnit"]).cast("int")
    mm = F.lit(INCH_MM)
    for code, value in PLANE_UNIT_MM.items():
        mm = F.when(unit == code, F.lit(value)).otherwise(mm)
    return F.coalesce(number(tags["SensorWidth"]), F.when(res > 0, width_px / res * mm))


def image_width(tags: dict[str, Column]) -> Column:
    """Of the first of its tags that is there, whether it can be read or not."""
    return number(F.coalesce(*[tags[t].cast("string") for t in WIDTH_TAGS if t in tags], F.lit(None).cast("string")))


def principal_point(tags: dict[str, Column]) -> Column:
    """struct of cx and cy; null unless both can be read."""
    x, y = (number(tags[t]) if t in tags else F.lit(None).cast("double") for t in ("CalibratedOpticalCenterX", "CalibratedOpticalCenterY"))
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("cx"), y.alias("cy")))


def tag_intrinsics(tags: dict[str, Column]) -> Column:
    """Intrinsics of an image's tags: struct of focal_px, principal point and field of view; null without a focal length."""
    fov = tag_fov(tags["FOV"].cast("string")) if "FOV" in tags else F.lit(None).cast("double")
    focal = focal_px(tags)
    return F.when(focal.isNotNull(), F.struct(focal.alias("focal_px"), principal_point(tags).alias("principal_point"), fov.alias("hfov_deg")))


def config_intrinsics(camera: dict) -> Column:
    """Intrinsics of a configuration's camera section, which must name focal_px."""
    if not camera or camera.get("focal_px") is None:
        raise ValueError("the configuration's camera section has no focal_px")
    fov, point = camera.get("hfov_deg"), camera.get("principal_point")
    middle = F.struct(F.lit(float(point[0])).alias("cx"), F.lit(float(point[1])).alias("cy")) if point else F.lit(None).cast("struct<cx: double, cy: double>")
    return F.struct(F.lit(float(camera["focal_px"])).alias("focal_px"), middle.alias("principal_point"), F.lit(None if fov is None else float(fov)).cast("double").alias("hfov_deg"))


def long_edge(width: Column, height: Column, most: int) -> tuple[Column, Column, Column]:
    """Size with its longer edge reduced to `most` (never enlarged), and the factor."""
    longer = F.greatest(width, height)
    factor = F.when(longer > most, F.lit(float(most)) / longer).otherwise(F.lit(1.0))
    size = lambda x: F.greatest(F.lit(1), F.bround(x * factor).cast("int"))
    return size(width), size(height), factor


def focal_px(tags: dict[str, Column]) -> Column:
    """Calibrated pixels, else millimetres on a known sensor, else the 35 mm equivalent; null if none can be read."""
    width = image_width(tags)
    sensor = sensor_width(tags, width)
    return F.coalesce(number(tags["CalibratedFocalLength"]), F.when(sensor > 0, number(tags["FocalLength"]) * width / sensor), number(tags["FocalLengthIn35mmFormat"]) / FULL_FRAME_MM * width)


def tag_fov(value: Column) -> Column:
    """The leading number of a field-of-view tag."""
    return number(F.split(F.trim(value), r"\s+")[0])
