"""Batch runs that tell how far they are and go on where they stopped.

Work is done in lots of groups (scenarios, tracks). A lot's rows replace those of its groups alone, and then its groups are noted as done; a run that stops in between does
that lot again, from its start, and no other. Which lot a group is in depends on its key only, so a later run meets the same lots.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


@dataclasses.dataclass(frozen=True)
class Progress:
    """How far a run is: groups done and all of them, and the rows and groups of the lot that was just finished."""

    done: int
    total: int
    rows: int
    groups: int


def finished(spark: SparkSession, path: str, kind: str, key: str) -> DataFrame:
    """The groups of a run's folder that are done."""
    try:
        return spark.read.parquet(f"{path}/done").select(F.col(key).cast(kind).alias(key)).distinct()
    except AnalysisException:  # nothing is done yet
        return spark.createDataFrame([], f"`{key}` {kind}")


def resumed(groups: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], path: str, lots: int = 16, tell: Callable[[Progress], None] = lambda p: None) -> DataFrame:
    """work(groups of a lot) gives rows with the key; all rows, those of runs before among them. Groups without a key are left out, and so are rows of other groups than the lot's.

    tell is called after each lot that had something to do. Groups that gave no rows are done too."""
    spark, kind = groups.sparkSession, dict(groups.dtypes)[key]
    groups = groups.where(F.col(key).isNotNull())
    total = groups.select(key).distinct().count()
    for lot in range(lots):
        own = groups.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(lots)) == lot)
        left = own.join(finished(spark, path, kind, key), key, "left_anti")
        names = left.select(key).distinct()
        n = names.count()
        if not n:
            continue
        seen = Observation()
        rows = work(left).join(names, key, "left_semi").observe(seen, F.count(F.lit(1)).alias("rows"))
        rows.repartition(key).write.partitionBy(key).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{path}/rows")
        names.write.mode("append").parquet(f"{path}/done")
        tell(Progress(finished(spark, path, kind, key).count(), total, seen.get["rows"], n))
    try:
        out = spark.read.parquet(f"{path}/rows")
    except AnalysisException:  # no group gave any
        return work(groups.limit(0))
    return out.withColumn(key, F.col(key).cast(kind)).join(finished(spark, path, kind, key), key, "left_semi")
