"""Queries of frame scores: metrics, winners, bands, comparison rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyfix.operators import fusion, metrics, search
from skyfix.plans.fixtures import ctes, view
from skyfix.plans.registry import query

ROUNDED = {"lock_rate": 9, "median_err_m": 6, "mean_err_m": 6, "worst_err_m": 6, "recall_1m": 9, "recall_5m": 9, "recall_10m": 9, "mean_runtime_s": 6}
HIT = "locked AND err_m IS NOT NULL"
FIELD = f"""count(*) AS n, count(CASE WHEN {HIT} THEN 1 END) AS n_locked, round(count(CASE WHEN {HIT} THEN 1 END) * 1e0 / count(*), 9) AS lock_rate, round(median(CASE WHEN {HIT} THEN err_m END), 6) AS median_err_m,
  round(avg(CASE WHEN {HIT} THEN err_m END), 6) AS mean_err_m, round(max(CASE WHEN {HIT} THEN err_m END), 6) AS worst_err_m, round(count(CASE WHEN {HIT} AND err_m <= 1 THEN 1 END) * 1e0 / count(*), 9) AS recall_1m,
  round(count(CASE WHEN {HIT} AND err_m <= 5 THEN 1 END) * 1e0 / count(*), 9) AS recall_5m, round(count(CASE WHEN {HIT} AND err_m <= 10 THEN 1 END) * 1e0 / count(*), 9) AS recall_10m, round(avg(runtime_s), 6) AS mean_runtime_s"""


def rounded(df, places=ROUNDED):
    return df.select(*[F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in df.columns])


def _metrics(spark, sf_dir):
    return metrics.field_metrics(view(spark, sf_dir, "frame_scores"), "scenario", "model")


FM = ctes("frame_scores") + f", fm AS (SELECT scenario, model, {FIELD} FROM frame_scores GROUP BY scenario, model)"


@query("field_metrics", FM + " SELECT * FROM fm")
def field_metrics(spark, sf_dir):
    return rounded(_metrics(spark, sf_dir))


@query("recall_at", ctes("frame_scores") + f"""SELECT scenario, round(count(CASE WHEN {HIT} AND err_m <= 0.5e0 THEN 1 END) * 1e0 / count(*), 9) AS recall_half, round(count(CASE WHEN {HIT} AND err_m <= 2e0 THEN 1 END) * 1e0 / count(*), 9) AS recall_2m FROM frame_scores GROUP BY scenario""")
def recall_at(spark, sf_dir):
    return view(spark, sf_dir, "frame_scores").groupBy("scenario").agg(F.round(metrics.recall_at(0.5), 9).alias("recall_half"), F.round(metrics.recall_at(2), 9).alias("recall_2m"))


@query("frame_validation", ctes("frame_scores") + f"""SELECT scenario, count(*) AS n, count(CASE WHEN {HIT} THEN 1 END) AS n_locked, round(count(CASE WHEN {HIT} THEN 1 END) * 1e0 / count(*), 9) AS lock_rate, round(median(CASE WHEN {HIT} THEN err_m END), 6) AS median_err_m,
  round(avg(CASE WHEN {HIT} THEN err_m END), 6) AS mean_err_m, round(max(CASE WHEN {HIT} THEN err_m END), 6) AS worst_err_m FROM frame_scores GROUP BY scenario""")
def frame_validation(spark, sf_dir):
    return rounded(metrics.summary(view(spark, sf_dir, "frame_scores"), "scenario"))


BEST = ", best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY recall_1m DESC, model) AS k FROM fm) x WHERE k = 1)"


@query("select_best", FM + BEST + " SELECT scenario, model, recall_1m, n, n_locked FROM best")
def select_best(spark, sf_dir):
    return rounded(metrics.select_best(rounded(_metrics(spark, sf_dir)), "recall_1m", "scenario")).select("scenario", "model", "recall_1m", "n", "n_locked")


@query("best_overall", FM + BEST + " SELECT model, count(*) AS votes, min(scenario) AS first_key FROM best GROUP BY model ORDER BY votes DESC, first_key LIMIT 1")
def best_overall(spark, sf_dir):
    return metrics.best_overall(metrics.select_best(rounded(_metrics(spark, sf_dir)), "recall_1m", "scenario"), "scenario")


@query("comparison_prep", FM + " SELECT scenario, model, round(100 * recall_5m, 6) AS recall_pct, round(100 * lock_rate, 6) AS coverage_pct, median_err_m FROM fm")
def comparison_prep(spark, sf_dir):
    return rounded(metrics.comparison_rows(rounded(_metrics(spark, sf_dir))), {"recall_pct": 6, "coverage_pct": 6})


HOPS = "(frame * 13) % 70"
UPPER = "(array_agg(err_m ORDER BY err_m))[cast(floor(count(*) / 2) AS bigint) + 1]"


@query("hop_bands", ctes("frame_scores") + f"""SELECT scenario, CASE WHEN h <= 10 THEN '0-10' WHEN h <= 50 THEN '11-50' ELSE '51+' END AS band, count(*) AS n, round({UPPER}, 6) AS median_err_m, round(max(err_m), 6) AS worst_err_m
FROM (SELECT *, {HOPS} AS h FROM frame_scores WHERE err_m IS NOT NULL) a GROUP BY 1, 2""")
def hop_bands(spark, sf_dir):
    return rounded(metrics.hop_bands(view(spark, sf_dir, "frame_scores").withColumn("hops", F.expr(HOPS)), "scenario"))


@query("vo_error_stats", ctes("frame_scores") + f"SELECT scenario, count(*) AS n, round({UPPER}, 6) AS median_err_m, round(avg(err_m), 6) AS mean_err_m, round(sqrt(avg(err_m * err_m)), 6) AS rmse_m, round(max(err_m), 6) AS worst_err_m FROM frame_scores WHERE err_m IS NOT NULL GROUP BY scenario")
def vo_error_stats(spark, sf_dir):
    return rounded(metrics.error_stats(view(spark, sf_dir, "frame_scores"), "scenario"), ROUNDED | {"rmse_m": 6})


@query("binned_median", ctes("frame_scores") + """, e AS (SELECT scenario, min(frame) AS lo, max(frame) + 1e-9 AS hi FROM frame_scores WHERE err_m IS NOT NULL GROUP BY scenario),
b AS (SELECT scenario, lo, hi, err_m, cast(least(greatest(floor((frame - lo) / ((hi - lo) / 24)), 0), 23) AS bigint) AS bin FROM frame_scores JOIN e USING (scenario) WHERE err_m IS NOT NULL)
SELECT scenario, bin, round(min(lo + (bin + 0.5e0) * ((hi - lo) / 24)), 6) AS centre, round(median(err_m), 6) AS median_y FROM b GROUP BY scenario, bin""")
def binned_median(spark, sf_dir):
    rows = view(spark, sf_dir, "frame_scores").where("err_m is not null")
    return rounded(metrics.binned_median(rows, "frame", "err_m", "scenario"), {"centre": 6, "median_y": 6})


BENCH = "SELECT model AS config, cast(frame * 10 + scenario AS {}) AS frame_id, err_m, locked FROM {} WHERE frame % 3 <> 0 OR model = 'view'"


@query("bench_bar_prep", ctes("contests") + f""", bench AS ({BENCH.format('varchar', 'contests')}), s AS (SELECT coalesce(max(err_m) * 0.04e0, 1e0) AS stub FROM bench)
SELECT c.config, f.frame_id, cast(f.frame_id AS bigint) AS frame_order, NOT (b.err_m IS NOT NULL AND coalesce(b.locked, true)) AS no_lock, round(CASE WHEN b.err_m IS NOT NULL AND coalesce(b.locked, true) THEN b.err_m ELSE stub END, 6) AS height
FROM (SELECT DISTINCT frame_id FROM bench) f CROSS JOIN (SELECT DISTINCT config FROM bench) c CROSS JOIN s LEFT JOIN bench b ON b.config = c.config AND b.frame_id = f.frame_id""")
def bench_bar_prep(spark, sf_dir):
    bench = spark.sql(BENCH.format("string", "{contests}"), contests=view(spark, sf_dir, "contests"))
    return rounded(metrics.bench_bars(bench), {"height": 6})


@query("track_bbox", ctes("gps_track") + """SELECT track, count(*) AS n, round(min(lat), 9) AS min_lat, round(max(lat), 9) AS max_lat, round(min(lon), 9) AS min_lon, round(max(lon), 9) AS max_lon, round(arg_min(lat, frame), 9) AS first_lat, round(arg_max(lat, frame), 9) AS last_lat,
  min(frame) AS first_frame, max(frame) AS last_frame FROM gps_track GROUP BY track""")
def track_bbox(spark, sf_dir):
    out = metrics.track_bounds(view(spark, sf_dir, "gps_track"), "track")
    return rounded(out, {c: 9 for c in out.columns if c.endswith(("lat", "lon"))})


@query("locked_origin", ctes("frame_scores") + " SELECT scenario, round(avg(est_lat), 9) AS lat, round(avg(est_lon), 9) AS lon FROM frame_scores WHERE locked AND est_lat IS NOT NULL GROUP BY scenario")
def locked_origin(spark, sf_dir):
    return rounded(fusion.locked_origin(view(spark, sf_dir, "frame_scores"), "scenario"), {"lat": 9, "lon": 9})


WIN = ", w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario, frame ORDER BY n_inliers DESC, model) AS k FROM contests WHERE locked AND est_lat IS NOT NULL) x WHERE k = 1)"


def _keyed(spark, sf_dir):
    return view(spark, sf_dir, "contests").withColumn("key", F.struct("scenario", "frame"))


@query("matcher_winner", ctes("contests") + WIN + " SELECT scenario, frame, model, n_inliers, round(err_m, 6) AS err_m FROM w")
def matcher_winner(spark, sf_dir):
    return rounded(search.match_winner(_keyed(spark, sf_dir), "key", "model").select("scenario", "frame", "model", "n_inliers", "err_m"), {"err_m": 6})


@query("provider_choice", ctes("contests") + WIN + """, f AS (SELECT DISTINCT scenario, frame FROM contests)
SELECT f.scenario, count(*) AS n, count(w.model) AS n_locked, round(median(w.err_m), 6) AS median_err_m, round(max(w.err_m), 6) AS worst_err_m, count(CASE WHEN w.model = 'view' THEN 1 END) AS n_view FROM f LEFT JOIN w USING (scenario, frame) GROUP BY f.scenario""")
def provider_choice(spark, sf_dir):
    chosen = search.multisource(_keyed(spark, sf_dir), "key", "model").select("key.scenario", "model", "err_m")
    out = search.source_summary(chosen, "model", "scenario")
    return rounded(out.withColumn("n_view", F.coalesce(F.col("chosen")["view"], F.lit(0))).drop("chosen"))


@query("error_winner", ctes("contests") + """, w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario, frame ORDER BY err_m, model) AS k FROM contests WHERE locked AND err_m IS NOT NULL) x WHERE k = 1)
SELECT f.scenario, f.frame, w.model, round(w.err_m, 6) AS err_m FROM (SELECT DISTINCT scenario, frame FROM contests) f LEFT JOIN w ON w.scenario = f.scenario AND w.frame = f.frame""")
def error_winner(spark, sf_dir):
    out = search.error_winner(_keyed(spark, sf_dir), "key", "model")
    return rounded(out.select("key.scenario", "key.frame", "model", "err_m"), {"err_m": 6})


@query("cascade_plan", ctes("contests") + """, f AS (SELECT DISTINCT scenario, frame FROM contests), c AS (SELECT scenario, frame, est_lat, est_lon FROM contests WHERE model = 'click' AND locked AND est_lat IS NOT NULL),
j AS (SELECT f.scenario, f.frame, c.est_lat, row_number() OVER (PARTITION BY f.scenario, c.est_lat IS NULL ORDER BY f.frame) AS k FROM f LEFT JOIN c USING (scenario, frame))
SELECT scenario, frame, CASE WHEN est_lat IS NOT NULL THEN 'refine' WHEN k <= 20 THEN 'recover' ELSE 'skip' END AS mode, round(est_lat, 11) AS centre_lat FROM j""")
def cascade_plan(spark, sf_dir):
    rows = view(spark, sf_dir, "contests")
    out = search.cascade_plan(rows.select("scenario", "frame").distinct(), rows.where("model = 'click'"), 20, "scenario")
    return rounded(out.select("scenario", "frame", "mode", "centre_lat"), {"centre_lat": 11})


@query("cascade_coverage", ctes("contests") + f""", m AS (SELECT scenario, max(c) AS best_single FROM (SELECT scenario, model, count(CASE WHEN locked THEN 1 END) AS c FROM contests GROUP BY scenario, model) x GROUP BY scenario)
SELECT a.scenario, a.n_frames, a.n_covered, m.best_single, round(a.n_covered * 1e0 / a.n_frames, 9) AS coverage FROM (SELECT scenario, count(DISTINCT frame) AS n_frames, count(DISTINCT CASE WHEN {HIT} THEN frame END) AS n_covered FROM contests GROUP BY scenario) a JOIN m USING (scenario)""")
def cascade_coverage(spark, sf_dir):
    rows = view(spark, sf_dir, "contests")
    frames = rows.groupBy("scenario", "frame").agg(F.max(metrics.scored()).alias("hit")).groupBy("scenario").agg(F.count(F.lit(1)).alias("n_frames"), F.count_if("hit").alias("n_covered"))
    single = rows.groupBy("scenario", "model").agg(F.count_if("locked").alias("c")).groupBy("scenario").agg(F.max("c").alias("best_single"))
    return frames.join(single, "scenario").withColumn("coverage", F.round(F.col("n_covered") / F.col("n_frames"), 9))


@query("method_errors", ctes("contests") + f""", k AS (SELECT scenario, frame, model, err_m, row_number() OVER (PARTITION BY scenario, frame ORDER BY err_m, model) AS r FROM contests WHERE {HIT})
SELECT f.scenario, f.frame, round(f.v, 6) AS err_view, round(f.c, 6) AS err_click, round(k.err_m, 6) AS best_err_m, k.model AS winner
FROM (SELECT scenario, frame, min(CASE WHEN {HIT} AND model = 'view' THEN err_m END) AS v, min(CASE WHEN {HIT} AND model = 'click' THEN err_m END) AS c FROM contests GROUP BY scenario, frame) f LEFT JOIN k ON k.scenario = f.scenario AND k.frame = f.frame AND k.r = 1""")
def method_errors(spark, sf_dir):
    return rounded(metrics.method_errors(view(spark, sf_dir, "contests"), ["view", "click"], "model", "scenario", "frame"), {"err_view": 6, "err_click": 6, "best_err_m": 6})


@query("method_table", ctes("contests") + f""", k AS (SELECT scenario, model, row_number() OVER (PARTITION BY scenario, frame ORDER BY err_m, model) AS r FROM contests WHERE {HIT}),
w AS (SELECT scenario, model, count(*) AS n_won FROM k WHERE r = 1 GROUP BY scenario, model)
SELECT c.scenario, c.model, count(*) AS n, count(CASE WHEN {HIT} THEN 1 END) AS n_locked, round(median(CASE WHEN {HIT} THEN err_m END), 6) AS median_err_m, round(min(CASE WHEN {HIT} THEN err_m END), 6) AS best_err_m, coalesce(max(w.n_won), 0) AS n_won
FROM contests c LEFT JOIN w ON w.scenario = c.scenario AND w.model = c.model GROUP BY c.scenario, c.model""")
def method_table(spark, sf_dir):
    return rounded(metrics.method_table(view(spark, sf_dir, "contests"), [], "model", "scenario", "frame"), {"median_err_m": 6, "best_err_m": 6})
