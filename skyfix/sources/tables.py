"""Typed CSV tables: frame scores, tracks, drift rows, manifests; and tables with aliased headers."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCORES = "frame BIGINT, t_s DOUBLE, est_lat DOUBLE, est_lon DOUBLE, gt_lat DOUBLE, gt_lon DOUBLE, err_m DOUBLE, yaw_deg DOUBLE, n_inliers BIGINT, locked INT, runtime_s DOUBLE"
TRACK = "frame BIGINT, t_s DOUBLE, lat DOUBLE, lon DOUBLE, alt_m DOUBLE"
DRIFT = "frame DOUBLE, hops_from_anchor DOUBLE, anchor_frame DOUBLE, err_m DOUBLE, est_lat DOUBLE, est_lon DOUBLE, gt_lat DOUBLE, gt_lon DOUBLE"
#: Header names under which a benchmark's truth columns are found, in normal form.
ALIASES = {
    "lat": ("lat", "latitude", "gps_lat", "drone_lat", "lat_deg"),
    "lon": ("lon", "lng", "long", "longitude", "gps_lon", "drone_lon", "lon_deg"),
    "filename": ("filename", "file", "image", "image_name", "name", "img", "drone"),
    "alt_m": ("height", "alt", "altitude", "h", "rel_alt", "relativealtitude"),
    "yaw_deg": ("heading", "yaw", "course", "drone_heading", "gimbalyaw"),
}
#: The same for tables of map extents (left-top and right-bottom corners, or bounds).
RANGE_ALIASES = {
    "mapname": ("mapname", "map", "filename", "file", "image", "name", "satellite"),
    "lat_a": ("lt_lat_map", "lat_lt", "lt_lat", "tl_lat", "lat_max", "maxlat", "max_lat", "north", "top"),
    "lon_a": ("lt_lon_map", "lon_lt", "lt_lon", "tl_lon", "lon_min", "minlon", "min_lon", "west", "left"),
    "lat_b": ("rb_lat_map", "lat_rb", "rb_lat", "br_lat", "lat_min", "minlat", "min_lat", "south", "bottom"),
    "lon_b": ("rb_lon_map", "lon_rb", "rb_lon", "br_lon", "lon_max", "maxlon", "max_lon", "east", "right"),
}
TEXTS = ("filename", "mapname")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, which the session names in spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}"  # one machine, as in tests


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("nullValue", "").option("emptyValue", "").mode("overwrite").csv(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, SCORES).withColumn("locked", F.col("locked").cast("boolean"))


def write_scores(df: DataFrame, path: str) -> None:
    write_csv(df.withColumn("locked", F.col("locked").cast("int")), path)


def read_track(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, TRACK)


def read_drift(spark: SparkSession, path: str) -> DataFrame:
    rows = _read(spark, path, DRIFT)
    whole = ("frame", "hops_from_anchor", "anchor_frame")
    return rows.select(*[F.col(c).cast("long").alias(c) if c in whole else F.col(c) for c in rows.columns]).orderBy(F.coalesce("frame", F.lit(0)))


def read_posed(spark: SparkSession, path: str) -> DataFrame:
    """Score rows that have both an estimate and a truth, in order of frames."""
    return read_scores(spark, path).where("est_lat is not null and gt_lat is not null").orderBy("frame")


def normal_header(name: str) -> str:
    """Lower case, without a byte order mark and spaces, hyphens as underscores."""
    return name.lstrip("\ufeff").strip().lower().replace(" ", "").replace("-", "_")


def distinct_headers(names: list[str | None]) -> list[str]:
    """Column names for headers as a file has them: of names that differ in case only the later ones get spaces at their end, which normal_header takes off again."""
    out, taken = [], set()
    for i, name in enumerate(names):
        name = f"_c{i}" if not name else name.lstrip("\ufeff")
        while name.lower() in taken:
            name += " "
        taken.add(name.lower())
        out.append(name)
    return out


def read_headed(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table of any header as text columns, and `_order`: file, place of the block and row, which rises in the order of each file.

    The header is read as the file has it, as the reader itself would rename columns that differ in case only."""
    reader = spark.read.option("encoding", "UTF-8")
    first = reader.csv(path).limit(1).collect()
    if first:
        names = distinct_headers(list(first[0]))
        reader = reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in names]))
    rows = reader.option("header", True).csv(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return rows.select("*", place.alias("_order"))


def aliased(df: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns by their canonical names, and those to keep; of several headers for one the first in the table that isn't empty counts."""
    out: list[Column] = [F.col(c) for c in keep]
    for name, known in aliases.items():
        own = [F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in df.columns if c not in keep and normal_header(c) in known]
        value = F.coalesce(*own) if own else F.lit(None).cast("string")
        out.append((value if name in TEXTS else value.try_cast("double")).alias(name))
    return df.select(*out)


def truth_by_stem(df: DataFrame, order: str, *keys: str) -> DataFrame:
    """Truth by file stem (within keys, such as the region); of repeated stems the last row in `order` counts. Rows without a name or a place are left out."""
    from skyfix.operators.asof import file_stem

    rows = df.where("filename is not null and lat is not null and lon is not null").withColumn("stem", file_stem(F.col("filename")))
    values = [c for c in ("lat", "lon", "alt_m", "yaw_deg") if c in df.columns]
    last = F.max_by(F.struct(*values), order).alias("last")  # of one row, nulls included
    return rows.groupBy(*keys, "stem").agg(last).select(*keys, "stem", *[F.col(f"last.{c}").alias(c) for c in values])


def ranges_by_key(df: DataFrame, order: str) -> DataFrame:
    """Map extents with their corners put in order, under the stem (last row counts) and the digits of the name (first row counts). Rows without a name or a corner are left out."""
    from skyfix.operators.asof import digits, file_stem

    whole = df.where("mapname is not null and lon_a is not null and lat_a is not null and lon_b is not null and lat_b is not null")
    box = F.struct(F.least("lon_a", "lon_b").alias("min_lon"), F.least("lat_a", "lat_b").alias("min_lat"), F.greatest("lon_a", "lon_b").alias("max_lon"), F.greatest("lat_a", "lat_b").alias("max_lat"))
    rows = whole.select(F.col(order).alias("_o"), file_stem(F.col("mapname")).alias("stem"), digits(F.col("mapname")).alias("number"), box.alias("box"))
    stems = rows.groupBy(F.col("stem").alias("key")).agg(F.max_by("box", "_o").alias("box"))
    numbers = rows.where("number <> ''").groupBy(F.col("number").alias("key")).agg(F.min_by("box", "_o").alias("box"))
    return stems.unionByName(numbers.join(stems, "key", "left_anti"))


def manifest_frames(spark: SparkSession, path: str) -> DataFrame:
    """The frames of an ingest manifest, in numeric order of shards."""
    schema = "shards MAP<STRING, STRUCT<status: STRING, frames: ARRAY<STRUCT<index: BIGINT, t_ms: BIGINT, blur_score: DOUBLE, filename: STRING, bytes: BIGINT, sha1: STRING>>>>, completed BOOLEAN"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("shards").alias("shard", "s"))
    return rows.select(F.col("shard").cast("int").alias("shard"), F.col("s.status").alias("status"), F.explode("s.frames").alias("f")).select("shard", "status", "f.*").orderBy("shard", "index")


#: The columns of frames.csv.
FRAME_INDEX = ("shard", "index", "t_ms", "blur_score", "filename", "bytes", "sha1")


def manifest_head(spark: SparkSession, path: str) -> DataFrame:
    """What a manifest says of its video and settings: identity fields and settings as text, one row, for frames.mismatches."""
    schema = "video STRUCT<name: STRING, size_bytes: BIGINT, n_frames: BIGINT, fps: DOUBLE, width: BIGINT, height: BIGINT>, settings_hash STRING, settings MAP<STRING, STRING>, completed BOOLEAN"
    return spark.read.schema(schema).option("multiLine", True).json(path).select("video.*", "settings_hash", "settings", F.coalesce("completed", F.lit(False)).alias("completed"))


def frame_index(shards: DataFrame) -> DataFrame:
    """The columns of frames.csv, in numeric order of shards and frames; frames of partial shards are listed too."""
    return shards.select(*FRAME_INDEX).orderBy("shard", "index")


def write_frame_index(shards: DataFrame, path: str) -> None:
    write_csv(frame_index(shards), path)


def missing_from_index(index: DataFrame, shards: DataFrame) -> DataFrame:
    """Frames that an index doesn't list, or lists with another size."""
    want = shards.select("filename", F.col("bytes").cast("long").alias("bytes"))
    rows = want.join(index.select("filename", F.col("bytes").cast("long").alias("_bytes"), F.lit(True).alias("_listed")), "filename", "left")
    problem = F.when(F.col("_listed").isNull(), "not listed").when(~F.col("bytes").eqNullSafe(F.col("_bytes")), "size")
    return rows.select("filename", problem.alias("problem")).where("problem is not null")


def bench_frames(spark: SparkSession, path: str) -> DataFrame:
    schema = "MAP<STRING, STRUCT<frames: MAP<STRING, STRUCT<err_m: DOUBLE, n_inliers: BIGINT, locked: BOOLEAN>>, mean_err_m: DOUBLE>>"
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("m")).select(F.explode("m").alias("config", "c"))
    return text.select("config", F.explode("c.frames").alias("frame_id", "f")).select("config", "frame_id", "f.*")
