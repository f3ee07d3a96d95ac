"""Connected components of an edge table, by alternating large-star and small-star steps on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfix.llm.common import discard, written


def _stars(edges: DataFrame) -> DataFrame:
    """Every node that isn't the smallest of its component tied to a smaller one; at the end: to the smallest."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    tied = large.join(least, "u")
    return tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _flat(edges: DataFrame) -> bool:
    """Whether every node has one parent at most, and no parent has one."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    return ends.groupBy("x").agg(F.sum("child").alias("child"), F.max("parent").alias("parent")).where("child > 1 or child = 1 and parent = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node of an edge that isn't its component's smallest, and that smallest. Edges (u, v) of unequal longs, in any direction."""
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    while not _flat(now):  # flat: stars around their smallest nodes, as an edge leads to a smaller node
        before, now = now, written(_stars(now), "edges")
        discard(before)
    return now
