"""Tracks as GeoJSON and KML text, by group, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Line colours of estimate and truth (alpha, blue, green, red).
COLOURS = {"estimated": "ff0000ff", "ground_truth": "ff00ff00"}


def _lines(rows: DataFrame, key: str) -> DataFrame:
    """Sorted points of both tracks: an estimate counts whether it is locked or not, a truth unless it is missing or NaN."""
    est = F.when(F.col("est_lat").isNotNull() & F.col("est_lon").isNotNull(), F.struct("frame", F.col("est_lon").alias("lon"), F.col("est_lat").alias("lat")))
    known = F.col("gt_lat").isNotNull() & ~F.isnan("gt_lat") & F.col("gt_lon").isNotNull() & ~F.isnan("gt_lon")
    truth = F.when(known, F.struct("frame", F.col("gt_lon").alias("lon"), F.col("gt_lat").alias("lat")))
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(est)).alias("estimated"), F.sort_array(F.collect_list(truth)).alias("ground_truth"))


#: What the tracks are called, in GeoJSON and in KML.
TRACKS, TITLES = {"estimated": "estimate", "ground_truth": "ground_truth"}, {"estimated": "Estimate", "ground_truth": "Ground truth"}


def _feature(points: str, name: Column) -> Column:
    """A line of two points or more, a point of one, nothing of none; with the track, the group's name and the number of points."""
    coords = F.transform(points, lambda p: F.array(p["lon"], p["lat"]))
    n = F.size(points)
    kind = F.when(n >= 2, "LineString").otherwise("Point")
    told = F.to_json(F.struct(F.lit(TRACKS[points]).alias("track"), name.alias("name"), n.alias("n")))
    shape = F.concat(F.lit('{"type":"Feature","properties":'), told, F.lit(',"geometry":{"type":"'), kind, F.lit('","coordinates":'), F.when(n >= 2, F.to_json(coords)).otherwise(F.to_json(F.get(coords, F.lit(0)))), F.lit("}}"))
    return F.when(n > 0, shape)


def geojson(rows: DataFrame, key: str) -> DataFrame:
    features = F.array_join(F.array_compact(F.array(*[_feature(n, F.col(key).cast("string")) for n in COLOURS])), ",")
    return _lines(rows, key).select(key, F.concat(F.lit('{"type":"FeatureCollection","features":['), features, F.lit("]}")).alias("geojson"))


def geojson_summary(rows: DataFrame, key: str) -> DataFrame:
    lines = _lines(rows, key)
    out = []
    for n in COLOURS:
        first, last = F.get(F.col(n), F.lit(0)), F.get(F.col(n), F.size(n) - 1)
        out += [F.size(n).cast("long").alias(f"n_{n}"), first["lon"].alias(f"first_lon_{n}"), last["lat"].alias(f"last_lat_{n}")]
    return lines.select(key, *out)


def kml_coordinates(points: str) -> Column:
    return F.array_join(F.transform(points, lambda p: F.format_string("%.8f,%.8f,0", p["lon"], p["lat"])), " ")


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def kml(rows: DataFrame, key: str) -> DataFrame:
    def mark(n: str) -> Column:
        text = kml_coordinates(n)
        line = F.concat(F.lit("<LineString><tessellate>1</tessellate><coordinates>"), text, F.lit("</coordinates></LineString>"))
        shape = F.when(F.size(n) >= 2, line).otherwise(F.concat(F.lit("<Point><coordinates>"), text, F.lit("</coordinates></Point>")))
        name = F.concat(F.lit(f"{TITLES[n]} ("), _escaped(F.col(key).cast("string")), F.lit(")"))
        style = f"<Style><LineStyle><color>{COLOURS[n]}</color><width>3</width></LineStyle></Style>"
        return F.when(F.size(n) > 0, F.concat(F.lit("<Placemark><name>"), name, F.lit(f"</name>{style}"), shape, F.lit("</Placemark>")))

    body = F.array_join(F.array_compact(F.array(*[mark(n) for n in COLOURS])), "")
    return _lines(rows, key).select(key, F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>'), body, F.lit("</Document></kml>")).alias("kml"), kml_coordinates("estimated").alias("estimated"), kml_coordinates("ground_truth").alias("ground_truth"))
