"""Datasets of flights: a video with its track, and benchmark regions of images, truth tables and map extents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyfix.operators.asof import digits, file_stem, first_of
from skyfix.sources.tables import aliased, ranges_by_key, truth_by_stem


#: Suffixes of query images and of maps, and what a map's name begins with.
IMAGE_SUFFIXES, MAP_SUFFIXES, MAP_PREFIX = ("jpg", "jpeg", "png"), ("tif", "tiff", "png", "jpg", "jpeg"), "satellite"
#: Fixed value: the usual name of the table of map extents.
RANGE_FILE = "satellite_coordinates_range.csv"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file under root: path below it and size. Contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    own = "/" + root.rstrip("/").split(":")[-1].strip("/") + "/"  # by length, as a path may hold any sign
    return rows.select(F.substring("path", F.instr("path", own) + len(own), F.length("path")).alias("path"), "length")


def _parts(files: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    return files.select("path", "length", F.size(parts).alias("depth"), parts[0].alias("region"), F.get(parts, F.size(parts) - 2).alias("folder"), F.element_at(parts, -1).alias("name"), F.lower(F.regexp_extract("path", r"[.]([^./]*)$", 1)).alias("suffix"))


def region_images(files: DataFrame) -> DataFrame:
    """(region, path) of the query images of every region: those in its folder `drone`, or without such a folder those directly in it."""
    rows = _parts(files)
    inside = rows.where("depth = 3 and folder = 'drone'").select("region", "path", "suffix")
    beside = rows.where("depth = 2").join(inside.select("region").distinct(), "region", "left_anti").select("region", "path", "suffix")
    return inside.unionByName(beside).where(F.col("suffix").isin(*IMAGE_SUFFIXES)).select("region", "path")


def region_map_files(files: DataFrame) -> DataFrame:
    """(region, map_path): the largest raster directly in a region's folder, of those whose name begins like a map's if there is any."""
    rows = _parts(files).where((F.col("depth") == 2) & F.col("suffix").isin(*MAP_SUFFIXES))
    named = F.lower("name").startswith(MAP_PREFIX)
    return rows.groupBy("region").agg(F.max_by("path", F.struct(named, "length")).alias("map_path"))


def region_truth_files(files: DataFrame) -> DataFrame:
    """(region, truth_path): <region>/<region>.csv, else the first other table in the folder, else <region>.csv at the root."""
    rows = _parts(files).where("suffix = 'csv'")
    own = rows.where((F.col("depth") == 2) & (F.lower("name") != RANGE_FILE)).select("region", "path", F.when(F.col("name") == F.concat("region", F.lit(".csv")), 0).otherwise(1).alias("_rank"))
    top = rows.where("depth = 1").select(F.regexp_replace("name", "[.]csv$", "").alias("region"), "path", F.lit(2).alias("_rank"))
    return own.unionByName(top).groupBy("region").agg(F.min_by("path", F.struct("_rank", "path")).alias("truth_path"))


def range_files(files: DataFrame) -> DataFrame:
    """The table of map extents at the root: by its usual name, else the first whose name speaks of a range of coordinates or satellites."""
    normal = F.regexp_replace(F.regexp_replace(F.lower("name"), " ", ""), "-", "_")
    rows = _parts(files).where("depth = 1 and suffix = 'csv'").withColumn("_exact", F.col("name") == RANGE_FILE)
    rows = rows.where(F.col("_exact") | (normal.contains("range") & (normal.contains("coordinate") | normal.contains("satellite"))))
    return rows.orderBy(F.desc("_exact"), "name").limit(1).select("path")


def region_samples(images: DataFrame, truth: DataFrame, order: str = "_order") -> DataFrame:
    """Images (region, path, readable) by sorted name, numbered before unreadable ones are left out, with their region's truth by file stem.

    truth: rows (region, any headers, and `order`, by which the last of repeated stems counts), as tables.read_headed gives them."""
    w = Window.partitionBy("region").orderBy("path")
    rows = images.withColumn("frame", (F.row_number().over(w) - 1).cast("long")).where("readable").withColumn("stem", file_stem(F.col("path")))
    on = ["region", "stem"] if "region" in truth.columns else ["stem"]  # without a region the truth is that of all
    if order not in truth.columns:
        truth = truth.withColumn(order, F.monotonically_increasing_id())
    known = truth_by_stem(aliased(truth, keep=(*on[:-1], order)), order, *on[:-1])
    return rows.join(known.select(*on, F.col("lat").alias("gt_lat"), F.col("lon").alias("gt_lon"), "alt_m", "yaw_deg"), on, "left")


def region_maps(regions: DataFrame, ranges: DataFrame, order: str) -> DataFrame:
    """Regions (region, map_path) with the extent found under the map's stem, the region's name, or the digits of either; level says which."""
    keys = regions.withColumns({"_name1": file_stem(F.col("map_path")), "_name2": F.lower("region"), "_name3": digits(file_stem(F.col("map_path"))), "_name4": digits(F.col("region"))})
    return first_of(keys, ranges_by_key(ranges, order), ["_name1", "_name2", "_name3", "_name4"], "key", "box").drop("_name1", "_name2", "_name3", "_name4")


def usable_regions(regions: DataFrame, samples: DataFrame, maps: DataFrame) -> DataFrame:
    """Every region (region, map_path, and if known map_readable) with what keeps it from being used, in the order it is looked for; null: usable."""
    n = samples.groupBy("region").agg(F.count(F.lit(1)).alias("_images"), F.count("gt_lat").alias("_truth"))
    rows = regions.join(n, "region", "left").join(maps.select("region", "box"), "region", "left")
    readable = F.coalesce("map_readable", F.lit(True)) if "map_readable" in regions.columns else F.lit(True)
    reason = F.when(F.coalesce("_images", F.lit(0)) == 0, "no images").when(F.coalesce("_truth", F.lit(0)) == 0, "no ground truth").when(F.col("map_path").isNull(), "no map").when(F.col("box").isNull(), "no extent").when(~readable, "undecodable")
    return rows.select("region", reason.alias("skipped"))


def tile_request(lat: float, lon: float, span_m: float, pixels: int, layer: str, crs: str = "EPSG:3857", style: str = "", form: str = "image/png") -> dict[str, str]:
    """Parameters of a WMS 1.3.0 GetMap request for a square of projected metres; fetching itself is the caller's."""
    box = map_request(lat, lon, span_m, pixels)["bbox"]
    return {"SERVICE": "WMS", "VERSION": "1.3.0", "REQUEST": "GetMap", "LAYERS": layer, "STYLES": style, "CRS": crs, "BBOX": box, "WIDTH": str(pixels), "HEIGHT": str(pixels), "FORMAT": form, "TRANSPARENT": "false"}


def map_request(lat: float, lon: float, span_m: float, pixels: int) -> dict[str, str]:
    """Parameters of an imagery export for a square of projected metres; fetching itself is the caller's."""
    import math

    from skyfix.functions.geo import RADIUS

    x, y = math.radians(lon) * RADIUS, RADIUS * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))
    return {"bbox": ",".join(f"{v:.6f}" for v in (x - span_m / 2, y - span_m / 2, x + span_m / 2, y + span_m / 2)), "size": f"{pixels},{pixels}", "srs": "3857", "format": "png"}
