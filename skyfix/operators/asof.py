"""Nearest-key and cascading joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nearest(probes: DataFrame, fixes: DataFrame, key: str, on: str = "frame", keep: tuple[str, ...] = ("lat", "lon"), ordinal: str | None = None) -> DataFrame:
    """Every probe with the fix of nearest `on` of its key, the lower one of two equally near; null without any fix.

    Of fixes at one place the first by `ordinal` counts, or without it that of least values.
    One sort of probes and fixes together: the last fix before and the first after a probe are the only candidates, so nothing is paired off."""
    what = F.struct(on, *keep)
    fixes = fixes.groupBy(key, on).agg(F.min_by(F.struct(*keep), F.struct(ordinal or F.lit(0), *keep)).alias("_one")).select(key, on, "_one.*")
    both = probes.select(key, on, F.lit(1).alias("_kind"), F.struct(*probes.columns).alias("_probe"), F.lit(None).cast(fixes.select(what.alias("f")).schema["f"].dataType).alias("_fix"))
    marks = fixes.select(key, on, F.lit(0).alias("_kind"), F.lit(None).cast(both.schema["_probe"].dataType).alias("_probe"), what.alias("_fix"))
    up = Window.partitionBy(key).orderBy(on, "_kind")
    down = Window.partitionBy(key).orderBy(F.col(on).desc(), F.col("_kind"))
    rows = both.unionByName(marks).withColumn("_before", F.last("_fix", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_after", F.last("_fix", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))).where("_kind = 1")
    gap = lambda c: F.abs(F.col(f"{c}.{on}") - F.col(on))
    chosen = F.when(F.col("_after").isNull() | (gap("_before") <= gap("_after")), F.col("_before")).otherwise(F.col("_after"))
    return rows.withColumn("fix", F.coalesce(chosen, F.col("_after"))).select("_probe.*", "fix")


def first_of(rows: DataFrame, lookup: DataFrame, keys: list[str], lookup_key: str, value: str) -> DataFrame:
    """The value under the first of several keys that the lookup has. The lookup holds a row for each key."""
    tried = rows
    for i, k in enumerate(keys):
        tried = tried.join(lookup.select(F.col(lookup_key).alias(f"_k{i}"), F.col(value).alias(f"_v{i}")), F.col(k) == F.col(f"_k{i}"), "left")
    out = F.coalesce(*[F.col(f"_v{i}") for i in range(len(keys))])
    level = F.coalesce(*[F.when(F.col(f"_v{i}").isNotNull(), F.lit(i)) for i in range(len(keys))])
    return tried.withColumns({value: out, "level": level}).drop(*[f"_{x}{i}" for i in range(len(keys)) for x in "kv"])


def missing(wanted: DataFrame, found: DataFrame, on: str) -> DataFrame:
    return wanted.select(on).distinct().join(found, on, "left_anti")


def file_stem(path):
    """Lower-case file name without folder and extension."""
    return F.lower(F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", ""))


def digits(text):
    return F.regexp_replace(text, "[^0-9]", "")
