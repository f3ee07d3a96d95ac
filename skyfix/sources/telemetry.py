"""Telemetry as metadata tools print it: JSON objects whose keys are tags, grouped by sample or flat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Tags of a sample, matched at the end of a key, and the pattern of a sample's group.
TAGS = ("GPSLatitude", "GPSLongitude", "GPSAltitude", "SampleTime")
GROUP = r"^Doc(\d+):"


def sample_time(text: Column) -> Column:
    """A number, or one followed by ' s'."""
    return F.regexp_replace(F.trim(text), r"\s*s$", "").try_cast("double")


def valid_fix(lat: Column, lon: Column) -> Column:
    inside = (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    return F.coalesce(inside & ~((lat == 0) & (lon == 0)), F.lit(False))


def fixes(objects: DataFrame) -> DataFrame:
    """Fixes (track, frame, t_s, lat, lon, alt_m, valid) of rows (track, json: an array of flat objects).

    Keys 'Doc<N>:…Tag' make frame N - 1 of each group; without any, every object that bears telemetry is a frame, counted
    by position. Frames are numbered before invalid ones are told apart, so dropping them leaves gaps."""
    items = objects.select("track", F.posexplode(F.from_json("json", "array<map<string,string>>")).alias("element", "tags"))
    pairs = items.select("track", "element", F.explode("tags").alias("key", "value"))
    tag = F.coalesce(*[F.when(F.col("key").endswith(t), F.lit(t)) for t in TAGS])
    pairs = pairs.withColumns({"tag": tag, "doc": F.regexp_extract("key", GROUP, 1).try_cast("long")}).where(F.col("tag").isNotNull())
    grouped = pairs.groupBy("track").agg(F.max(F.col("doc").isNotNull()).alias("grouped"))
    rows = pairs.join(grouped, "track").where(~F.col("grouped") | F.col("doc").isNotNull())
    slot = F.when(F.col("grouped"), F.col("doc")).otherwise(F.col("element").cast("long"))
    per = rows.groupBy("track", "grouped", slot.alias("slot")).agg(*[F.max_by(F.when(F.col("tag") == t, F.col("value")), F.when(F.col("tag") == t, F.struct("element", "key"))).alias(t) for t in TAGS])
    place = F.when(F.col("grouped"), F.col("slot") - 1).otherwise(F.row_number().over(Window.partitionBy("track").orderBy("slot")) - 1)
    lat, lon = F.col("GPSLatitude").try_cast("double"), F.col("GPSLongitude").try_cast("double")
    return per.select("track", place.cast("long").alias("frame"), sample_time(F.col("SampleTime")).alias("t_s"), lat.alias("lat"), lon.alias("lon"), F.col("GPSAltitude").try_cast("double").alias("alt_m"), valid_fix(lat, lon).alias("valid"))
