"""Scores of localized frames: coverage, recall, error statistics, and the choice of a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyfix.functions import geo

#: Metrics of which more is better; of any other less is.
HIGHER_IS_BETTER = ("recall_1m", "recall_5m", "recall_10m", "lock_rate")
#: Bounds of the bands of hops from an anchor.
HOP_BANDS = (("0-10", 0, 10), ("11-50", 11, 50), ("51+", 51, None))


def scored() -> Column:
    return F.col("locked") & F.col("err_m").isNotNull()


def recall_at(metres: float) -> Column:
    """Frames locked within this distance, of all frames."""
    return F.coalesce(F.count_if(scored() & (F.col("err_m") <= metres)) / F.count(F.lit(1)), F.lit(0.0))


def field_metrics(scores: DataFrame, *keys: str) -> DataFrame:
    err = F.when(scored(), F.col("err_m"))
    return scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count(err).alias("n_locked"), (F.count(err) / F.count(F.lit(1))).alias("lock_rate"),
        F.median(err).alias("median_err_m"), F.avg(err).alias("mean_err_m"), F.max(err).alias("worst_err_m"),
        recall_at(1).alias("recall_1m"), recall_at(5).alias("recall_5m"), recall_at(10).alias("recall_10m"), F.avg("runtime_s").alias("mean_runtime_s"),
    )


def summary(scores: DataFrame, *keys: str) -> DataFrame:
    return field_metrics(scores, *keys).select(*keys, "n", "n_locked", "lock_rate", "median_err_m", "mean_err_m", "worst_err_m")


def select_best(metrics: DataFrame, metric: str, key: str, ordinal: str = "model") -> DataFrame:
    """The best model of each key; null metrics don't compete, the first model wins ties."""
    order = F.col(metric).desc() if metric in HIGHER_IS_BETTER else F.col(metric).asc()
    w = Window.partitionBy(key).orderBy(order, F.col(ordinal))
    return metrics.where(F.col(metric).isNotNull()).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def best_overall(best: DataFrame, key: str, model: str = "model") -> DataFrame:
    """The model that is best most often; of equal ones the one seen first in the order of the keys."""
    votes = best.groupBy(model).agg(F.count(F.lit(1)).alias("votes"), F.min(key).alias("first_key"))
    return votes.orderBy(F.desc("votes"), "first_key").limit(1)


def shaped_metrics(scores: DataFrame, *keys: str, order: str = "frame") -> DataFrame:
    """field_metrics with the shape of the track of locked frames (errors raw and after a rigid fit, lengths); null for fewer than two such frames."""
    from skyfix.operators import trajectory

    track = scores.where(scored() & F.col("est_lat").isNotNull() & F.col("est_lon").isNotNull()).withColumn("_key", F.struct(*keys))
    enough = track.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").select("_key")
    shape = trajectory.score(track.join(enough, "_key", "left_semi"), "_key", order)
    shape = shape.select(*[F.col(f"_key.{k}").alias(k) for k in keys], *[c for c in shape.columns if c not in ("_key", "n")])
    return field_metrics(scores, *keys).join(shape, list(keys), "left")


def method_errors(rows: DataFrame, methods: list[str], method: str, *keys: str) -> DataFrame:
    """By frame: the error of every method (null where it isn't locked), the least one and the method that has it, the first by name of equal ones."""
    own = [F.min(F.when(scored() & (F.col(method) == m), F.col("err_m"))).alias(f"err_{m}") for m in methods]
    lead = F.min(F.when(scored(), F.struct("err_m", method)))
    return rows.groupBy(*keys).agg(*own, lead["err_m"].alias("best_err_m"), lead[method].alias("winner"))


def method_table(rows: DataFrame, methods: list[str], method: str, group: str, *keys: str) -> DataFrame:
    """By group and method: frames, locked ones, frames won, median and least error."""
    won = method_errors(rows, methods, method, group, *keys).where("winner is not null").groupBy(group, F.col("winner").alias(method)).agg(F.count(F.lit(1)).alias("n_won"))
    err = F.when(scored(), F.col("err_m"))
    per = rows.groupBy(group, method).agg(F.count(F.lit(1)).alias("n"), F.count(err).alias("n_locked"), F.median(err).alias("median_err_m"), F.min(err).alias("best_err_m"))
    return per.join(won, [group, method], "left").withColumn("n_won", F.coalesce("n_won", F.lit(0)).cast("long"))


def validated(located: DataFrame, track: DataFrame, key: str) -> DataFrame:
    """Located frames (key, frame, est_lat, est_lon, ...) with the truth of nearest frame (null without any) and their distance from it."""
    from skyfix.operators import asof

    rows = asof.nearest(located, track, key)
    err = geo.haversine(F.col("fix.lat"), F.col("fix.lon"), F.col("est_lat"), F.col("est_lon"))
    return rows.select(*located.columns, F.col("fix.lat").alias("gt_lat"), F.col("fix.lon").alias("gt_lon"), err.alias("err_m"))


def upper_median(c: Column) -> Column:
    """The middle value of a small group, of an even number the upper one."""
    values = F.sort_array(F.collect_list(c))
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def upper_median_of(column: str) -> Column:
    """The same for groups of any size: values are counted before they are shuffled, not gathered in lists."""
    return -F.expr(f"percentile_disc(0.5) within group (order by -{column})")


def error_stats(rows: DataFrame, *keys: str) -> DataFrame:
    e = F.col("err_m")
    return rows.where(e.isNotNull()).groupBy(*keys).agg(F.count(e).alias("n"), upper_median_of("err_m").alias("median_err_m"), F.avg(e).alias("mean_err_m"), F.sqrt(F.avg(e * e)).alias("rmse_m"), F.max(e).alias("worst_err_m"))


def hop_band(hops: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, lo, hi in reversed(HOP_BANDS):
        out = F.when((hops >= lo) & (F.lit(True) if hi is None else hops <= hi), F.lit(name)).otherwise(out)
    return out


def hop_bands(rows: DataFrame, *keys: str) -> DataFrame:
    e = F.col("err_m")
    return rows.where(e.isNotNull()).withColumn("band", hop_band(F.col("hops"))).where(F.col("band").isNotNull()).groupBy(*keys, "band").agg(F.count(e).alias("n"), upper_median_of("err_m").alias("median_err_m"), F.max(e).alias("worst_err_m"))


def binned_median(rows: DataFrame, x: str, y: str, key: str, bins: int = 24) -> DataFrame:
    """Medians of y in equal-width bins of x, by key, at the bins' centres; empty bins are left out."""
    ends = rows.groupBy(key).agg(F.min(x).alias("_lo"), (F.max(x) + 1e-9).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.least(F.greatest(F.floor((F.col(x) - F.col("_lo")) / width), F.lit(0)), F.lit(bins - 1)).cast("long")
    binned = rows.join(ends, key).withColumn("bin", place).withColumn("centre", F.col("_lo") + (place + 0.5) * width)
    return binned.groupBy(key, "bin").agg(F.min("centre").alias("centre"), F.median(y).alias("median_y"))


#: Parts into which a bar chart's configurations are dealt: every frame has a bar for each configuration, and meets them part by part.
PARTS = 16


def comparison_rows(metrics: DataFrame) -> DataFrame:
    return metrics.select("scenario", "model", (100 * F.col("recall_5m")).alias("recall_pct"), (100 * F.col("lock_rate")).alias("coverage_pct"), "median_err_m")


def bench_bars(bench: DataFrame, stub_share: float = 0.04) -> DataFrame:
    """(config, frame_id, err_m, locked) to bars over the union of all configs' frames, in numeric order of the ids."""
    frames = bench.select("frame_id").distinct()
    configs = bench.select("config").distinct().withColumn("_part", F.pmod(F.xxhash64("config"), F.lit(PARTS)).cast("int"))
    frames = frames.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    stub = bench.agg(F.coalesce(F.max("err_m") * stub_share, F.lit(1.0)).alias("stub"))  # one row
    cells = frames.join(configs, "_part").drop("_part").join(bench, ["config", "frame_id"], "left").join(F.broadcast(stub))
    shown = F.col("err_m").isNotNull() & F.coalesce("locked", F.lit(True))
    return cells.select("config", "frame_id", F.expr("try_cast(frame_id as bigint)").alias("frame_order"), (~shown).alias("no_lock"), F.when(shown, F.col("err_m")).otherwise(F.col("stub")).alias("height"))


def track_bounds(track: DataFrame, key: str) -> DataFrame:
    return track.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"), F.min_by("lat", "frame").alias("first_lat"), F.max_by("lat", "frame").alias("last_lat"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))
