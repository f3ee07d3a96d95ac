"""Search grids, candidates, and the gates that make one of them a lock."""

from __future__ import annotations

import decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyfix.functions import geo

#: Scale factors of the fine pass.
FINE_SCALES = (0.85, 0.925, 1.0, 1.075, 1.15)


def grid_centres(priors: DataFrame, radius: Column, step: Column) -> DataFrame:
    """Every prior's grid (centre_idx in scan order: rows from the south, columns from the west), the prior itself exactly."""
    single = (radius <= 0) | (step <= 0) | (step >= 2 * radius)
    n = F.when(single, F.lit(0)).otherwise(F.floor((radius + 1e-9) / F.when(step > 0, step))).cast("int")
    cells = priors.withColumn("_n", n).withColumn("_dy", F.explode(F.sequence(-F.col("_n"), F.col("_n")))).withColumn("_dx", F.explode(F.sequence(-F.col("_n"), F.col("_n"))))
    x, y = geo.to_mercator(F.col("prior_lon"), F.col("prior_lat"))
    lon, lat = geo.from_mercator(x + F.col("_dx") * step, y + F.col("_dy") * step)
    centre = (F.col("_dx") == 0) & (F.col("_dy") == 0)
    index = (F.col("_dy") + F.col("_n")) * (2 * F.col("_n") + 1) + F.col("_dx") + F.col("_n")
    return cells.withColumns({"centre_idx": index.cast("long"), "lat": F.when(centre, F.col("prior_lat")).otherwise(lat), "lon": F.when(centre, F.col("prior_lon")).otherwise(lon)}).drop("_n", "_dx", "_dy")


def candidates(centres: DataFrame, scales: list[float]) -> DataFrame:
    """Centres by scales, scale by scale within a centre."""
    ladder = F.array(*[F.lit(float(s)) for s in scales])
    rows = centres.select("*", F.posexplode(ladder).alias("scale_idx", "span_m"))
    return rows.withColumn("scan_idx", F.col("centre_idx") * len(scales) + F.col("scale_idx")).drop("scale_idx")


def _lead(cands: DataFrame) -> Column:
    """Orders candidates by inliers, and of equal ones the first in scan order highest. Whole numbers stand in one number of 38 digits, which is kept in a hash table where a struct would have all candidates sorted."""
    if all(dict(cands.dtypes)[c] in ("tinyint", "smallint", "int", "bigint") for c in ("n_inliers", "scan_idx")):
        most = F.coalesce(F.col("n_inliers").cast("long"), F.lit(-(1 << 63)))  # none known: below all
        return most.cast("decimal(19,0)") * F.lit(decimal.Decimal(10**18)) * F.lit(10).cast("decimal(2,0)") - F.col("scan_idx").cast("decimal(19,0)")
    return F.struct("n_inliers", -F.col("scan_idx"))


def best_candidate(cands: DataFrame, *keys: str) -> DataFrame:
    """The posed candidate of most inliers, the first in scan order of equal ones."""
    lead = _lead(cands)
    return cands.where("has_pose").groupBy(*keys).agg(*[F.max_by(c, lead).alias(c) for c in cands.columns if c not in keys])


def runner_up(cands: DataFrame, best: DataFrame, separation: Column, *keys: str) -> DataFrame:
    """The strongest posed candidate at least this far (in projected metres) from the best."""
    b = best.select(*keys, F.col("x_m").alias("_bx"), F.col("y_m").alias("_by"), F.col("scan_idx").alias("_bi"))
    far = F.hypot(F.col("x_m") - F.col("_bx"), F.col("y_m") - F.col("_by")) >= separation
    rivals = cands.where("has_pose").join(b, list(keys)).where(far & (F.col("scan_idx") != F.col("_bi")))
    lead = F.struct("n_inliers", -F.col("scan_idx"))
    return rivals.groupBy(*keys).agg(F.max_by("scan_idx", lead).alias("rival_idx"), F.max("n_inliers").alias("rival_inliers"))


def lock_gate(cands: DataFrame, separation: Column, min_inliers: int, ratio: float, *keys: str) -> DataFrame:
    """Best, rival, their ratio (null without a rival, infinite against no inliers) and whether both gates let the best pass; a row for each key.

    One window by key tells every candidate its key's best, so that the rival and the row of the key come out of one aggregation."""
    lead = F.struct("n_inliers", (-F.col("scan_idx")).alias("_first"))
    posed = F.col("has_pose")
    w = Window.partitionBy(*keys)
    rows = cands.withColumn("_best", F.max_by(F.struct("scan_idx", "x_m", "y_m"), F.when(posed, lead)).over(w))
    far = (F.hypot(F.col("x_m") - F.col("_best.x_m"), F.col("y_m") - F.col("_best.y_m")) >= separation) & (F.col("scan_idx") != F.col("_best.scan_idx"))
    rows = rows.withColumns({"_is_best": F.coalesce(posed & (F.col("scan_idx") == F.col("_best.scan_idx")), F.lit(False)), "_is_far": F.coalesce(posed & far, F.lit(False))})
    own = [F.max_by(F.when(F.col("_is_best"), F.col(c)), F.col("_is_best").cast("int")).alias(c) for c in cands.columns if c not in keys]
    rivals = [F.max_by(F.when(F.col("_is_far"), F.col("scan_idx")), F.when(F.col("_is_far"), lead)).alias("rival_idx"), F.max(F.when(F.col("_is_far"), F.col("n_inliers"))).alias("rival_inliers")]
    rows = rows.groupBy(*keys).agg(*own, *rivals)
    margin = F.when(F.col("rival_inliers") > 0, F.col("n_inliers") / F.col("rival_inliers")).when(F.col("rival_inliers") == 0, F.lit(float("inf")))
    beaten = F.coalesce(F.col("n_inliers") < ratio * F.col("rival_inliers"), F.lit(False))
    return rows.withColumns({"margin_ratio": margin, "locked": F.coalesce(F.col("n_inliers") >= min_inliers, F.lit(False)) & ~beaten})


def fine_scales(span: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array(*[F.bround(span * f, 3) for f in FINE_SCALES])))


def fine_cells(coarse: DataFrame, *keys: str) -> DataFrame:
    """The fine pass's cells of locked frames (lat, lon, span_m of the best candidate): a grid of a quarter of the span over half of it to each side, by the fine scales. The best cell itself is among them."""
    scales = fine_scales(F.col("span_m"))  # once a lock, not once a cell
    priors = coarse.where("locked").select(*keys, F.col("lat").alias("prior_lat"), F.col("lon").alias("prior_lon"), F.col("span_m").alias("_span"), scales.alias("_scales"))
    cells = grid_centres(priors, F.col("_span") * 0.5, F.col("_span") * 0.25)
    rows = cells.select(*keys, "centre_idx", "lat", "lon", F.size("_scales").alias("_n"), F.posexplode("_scales").alias("_scale", "span_m"))
    return rows.withColumn("scan_idx", F.col("centre_idx") * F.col("_n") + F.col("_scale")).drop("_n", "_scale")


def both_passes(coarse: DataFrame, fine: DataFrame) -> DataFrame:
    """All candidates of the coarse and the fine pass, with the pass they are of."""
    return coarse.withColumn("pass", F.lit("coarse")).unionByName(fine.withColumn("pass", F.lit("fine")), allowMissingColumns=True)


def cost(radius: Column, step: Column, scales: int) -> Column:
    """How many candidates a search has: cells of its grid by scales."""
    single = (radius <= 0) | (step <= 0) | (step >= 2 * radius)
    side = F.when(single, F.lit(1)).otherwise(2 * F.floor((radius + 1e-9) / F.when(step > 0, step)) + 1)
    return (side * side * scales).cast("long")


def refine_pick(coarse: DataFrame, fine: DataFrame, *keys: str) -> DataFrame:
    """For locked frames the fine pass's best unless it has fewer inliers; others stay as they are."""
    f = best_candidate(fine, *keys).select(*keys, F.col("n_inliers").alias("_n"), F.col("scan_idx").alias("_i"))
    rows = coarse.join(f, list(keys), "left")
    finer = F.col("locked") & F.coalesce(F.col("_n") >= F.col("n_inliers"), F.lit(False))
    return rows.withColumns({"refined": finer, "best_inliers": F.when(finer, F.col("_n")).otherwise(F.col("n_inliers")), "best_idx": F.when(finer, F.col("_i")).otherwise(F.col("scan_idx"))}).drop("_n", "_i")


def tile_keys(cands: DataFrame) -> DataFrame:
    """Distinct tiles to fetch: places rounded to 1e-7 degrees."""
    return cands.select(F.bround("lat", 7).alias("lat"), F.bround("lon", 7).alias("lon"), "span_m", "pixels").distinct()


def winner(rows: DataFrame, order: list[Column], *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def match_winner(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """By key the locked row of most inliers."""
    return winner(rows.where(F.col("locked") & F.col("est_lat").isNotNull()), [F.desc("n_inliers"), F.col(ordinal)], key)


def error_winner(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """By key the locked row of least error; keys without any keep a null."""
    best = winner(rows.where(F.col("locked") & F.col("err_m").isNotNull()), [F.asc("err_m"), F.col(ordinal)], key)
    return rows.select(key).distinct().join(best, key, "left")


def multisource(rows: DataFrame, key: str, source: str) -> DataFrame:
    """By frame the locked source of most inliers (the first by name of equal ones) with its estimate; frames without any stay, unlocked."""
    best = match_winner(rows, key, source)
    return rows.select(key).distinct().join(best, key, "left").withColumn("locked", F.coalesce("locked", F.lit(False)))


def source_summary(chosen: DataFrame, source: str, *keys: str) -> DataFrame:
    """Of chosen sources: frames, locked ones, median and worst error, and how often each source was chosen."""
    counts = chosen.where(F.col(source).isNotNull()).groupBy(*keys, source).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(source, "_n")))).alias("chosen"))  # one entry a source
    out = chosen.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count(source).alias("n_locked"), F.median("err_m").alias("median_err_m"), F.max("err_m").alias("worst_err_m"))
    return out.join(counts, list(keys), "left")


def cascade_plan(frames: DataFrame, cheap: DataFrame, budget: int, group: str) -> DataFrame:
    """refine where the cheap matcher locked, recover for the first `budget` others of a group, skip the rest."""
    locks = cheap.where(F.col("locked") & F.col("est_lat").isNotNull()).select(group, "frame", F.col("est_lat").alias("centre_lat"), F.col("est_lon").alias("centre_lon"))
    rows = frames.join(locks, [group, "frame"], "left")
    order = Window.partitionBy(group, F.col("centre_lat").isNull()).orderBy("frame")
    mode = F.when(F.col("centre_lat").isNotNull(), "refine").when(F.row_number().over(order) <= budget, "recover").otherwise("skip")
    return rows.withColumn("mode", mode)
