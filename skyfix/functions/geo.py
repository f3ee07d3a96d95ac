"""Web-Mercator and great-circle geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sphere's radius in metres, and the series for metres in a degree of latitude and longitude.
RADIUS = 6378137.0
LAT_SERIES, LON_SERIES = (111132.92, -559.82, 1.175), (111412.84, -93.5)
#: Pixels of a map tile's edge, the map's extent in metres.
TILE_PX, WORLD = 256, 2 * 3.141592653589793 * RADIUS
PI = 3.141592653589793


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * RADIUS, RADIUS * F.log(F.tan(F.lit(PI / 4) + F.radians(lat) / 2))


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """(lon, lat) in degrees."""
    return F.degrees(x / RADIUS), F.degrees(2 * F.atan(F.exp(y / RADIUS)) - F.lit(PI / 2))


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    r = F.radians(lat)
    a, b, c = LAT_SERIES
    p, q = LON_SERIES
    return F.lit(a) + b * F.cos(2 * r) + c * F.cos(4 * r), p * F.cos(r) + q * F.cos(3 * r)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    chord = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return 2 * RADIUS * F.asin(F.sqrt(chord))


def bbox_around(lon: Column, lat: Column, span: Column) -> tuple[Column, Column, Column, Column]:
    """minx, miny, maxx, maxy of a square of projected metres."""
    x, y = to_mercator(lon, lat)
    return x - span / 2, y - span / 2, x + span / 2, y + span / 2


def metres_per_pixel(tile: str = "tile") -> tuple[Column, Column]:
    return F.expr(f"({tile}.maxx - {tile}.minx) / {tile}.width"), F.expr(f"({tile}.maxy - {tile}.miny) / {tile}.height")


def pixel_to_mercator(px: Column, py: Column, tile: str = "tile") -> tuple[Column, Column]:
    sx, sy = metres_per_pixel(tile)
    return F.col(f"{tile}.minx") + px * sx, F.col(f"{tile}.maxy") - py * sy


def mercator_to_pixel(x: Column, y: Column, tile: str = "tile") -> tuple[Column, Column]:
    sx, sy = metres_per_pixel(tile)
    return (x - F.col(f"{tile}.minx")) / sx, (F.col(f"{tile}.maxy") - y) / sy


def to_local(lat: Column, lon: Column, ref_lat: Column, ref_lon: Column) -> tuple[Column, Column]:
    """East and north in metres."""
    m_lat, m_lon = metres_per_degree(ref_lat)
    return (lon - ref_lon) * m_lon, (lat - ref_lat) * m_lat


def from_local(east: Column, north: Column, ref_lat: Column, ref_lon: Column) -> tuple[Column, Column]:
    """(lat, lon) in degrees."""
    m_lat, m_lon = metres_per_degree(ref_lat)
    return ref_lat + north / m_lat, ref_lon + east / m_lon


def zoom_for(span: Column, pixels: Column, max_zoom: int) -> Column:
    """The smallest zoom at least as fine as asked for."""
    return F.greatest(F.lit(0), F.least(F.ceil(F.log2(WORLD * pixels / (TILE_PX * span))), F.lit(max_zoom))).cast("int")


def global_pixel(x: Column, y: Column, zoom: Column) -> tuple[Column, Column]:
    size = TILE_PX * F.pow(F.lit(2.0), zoom)
    return (x + WORLD / 2) / WORLD * size, (WORLD / 2 - y) / WORLD * size


def crop_rect(lon: Column, lat: Column, span: Column, tile: str = "tile") -> list[Column]:
    """x0, y0, x1, y1 of the square's pixels in the tile, rounded half to even and clamped to it."""
    minx, miny, maxx, maxy = bbox_around(lon, lat, span)
    x0, y0 = mercator_to_pixel(minx, maxy, tile)
    x1, y1 = mercator_to_pixel(maxx, miny, tile)
    low = [F.greatest(F.lit(0), F.bround(c).cast("long")) for c in (x0, y0)]
    return [*low, F.least(F.col(f"{tile}.width").cast("long"), F.bround(x1).cast("long")), F.least(F.col(f"{tile}.height").cast("long"), F.bround(y1).cast("long"))]


def human_bytes(n: Column) -> Column:
    """One decimal and a unit, in steps of 1024."""
    units = ("B", "KB", "MB", "GB", "TB")
    out = F.format_string("%.1f PB", F.bround(n / 1024.0 ** len(units), 1))
    for power, unit in reversed(list(enumerate(units))):
        out = F.when(F.abs(n) < 1024.0 ** (power + 1), F.format_string(f"%.1f {unit}", F.bround(n / 1024.0**power, 1))).otherwise(out)
    return out
