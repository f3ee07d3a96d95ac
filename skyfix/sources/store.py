"""A store of reference tiles, kept by quadtree cell, and the tiles that hold a point.

A tile is kept at the level whose cells are at least as wide as it, so it touches four cells of that level at most; a point has one cell a level. Points and tiles meet by equal
cells, level by level, and the boxes are compared after that: work grows with the tiles near a point, not with all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfix.functions.geo import WORLD

#: Levels of the quadtree: cells of level 0 are the whole map.
LEVELS = 24


def level_of(span: Column) -> Column:
    """The deepest level whose cells are at least this wide."""
    return F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.floor(F.log2(F.lit(WORLD) / F.greatest(span, F.lit(1e-3)))))).cast("int")


def _cell(v: Column, level: Column) -> Column:
    return F.floor((v + F.lit(WORLD / 2)) / (F.lit(WORLD) / F.pow(F.lit(2.0), level))).cast("long")


def covered(tiles: DataFrame, box: str = "tile") -> DataFrame:
    """Tiles with the cells they touch: level, cx, cy; a row for each, four at most."""
    b = lambda c: F.col(f"{box}.{c}")
    rows = tiles.withColumn("level", level_of(F.greatest(b("maxx") - b("minx"), b("maxy") - b("miny"))))
    rows = rows.withColumn("cx", F.explode(F.sequence(_cell(b("minx"), F.col("level")), _cell(b("maxx"), F.col("level")))))
    return rows.withColumn("cy", F.explode(F.sequence(_cell(b("miny"), F.col("level")), _cell(b("maxy"), F.col("level")))))


def holding(points: DataFrame, tiles: DataFrame, box: str = "tile") -> DataFrame:
    """Every pair of a point (with mercator x, y) and a tile whose box holds it, edges included. The tiles' columns mustn't clash with the points'."""
    kept = covered(tiles, box)
    levels = sorted(r["level"] for r in kept.select("level").distinct().collect())  # LEVELS + 1 at most
    spread = points.withColumn("level", F.explode(F.lit(levels).cast("array<int>"))).withColumns({"cx": _cell(F.col("x"), F.col("level")), "cy": _cell(F.col("y"), F.col("level"))})
    b = lambda c: F.col(f"{box}.{c}")
    inside = (F.col("x") >= b("minx")) & (F.col("x") <= b("maxx")) & (F.col("y") >= b("miny")) & (F.col("y") <= b("maxy"))
    return spread.join(kept, ["level", "cx", "cy"]).where(inside).drop("level", "cx", "cy")


def save(tiles: DataFrame, path: str, name: str = "name") -> None:
    """Tiles (name, tile, content, ...) as a Parquet table in folders of the level and the coarse cell of their corner; earlier tiles of these folders stay."""
    b = F.col("tile")
    level = level_of(F.greatest(b["maxx"] - b["minx"], b["maxy"] - b["miny"]))
    coarse = F.least(level, F.lit(8))
    rows = tiles.withColumns({"level": level, "area": F.format_string("%d_%d", _cell(b["minx"], coarse), _cell(b["miny"], coarse))})
    rows.repartition("level", "area").sortWithinPartitions(name).write.partitionBy("level", "area").mode("append").parquet(path)


def load(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """All tiles of a store, or those of one name; a name that isn't there is an error."""
    rows = spark.read.parquet(path).drop("level", "area")
    if name is None:
        return rows
    own = rows.where(F.col("name") == name)
    if own.isEmpty():
        raise FileNotFoundError(f"no tile {name!r} in {path}: fetch it first")
    return own
