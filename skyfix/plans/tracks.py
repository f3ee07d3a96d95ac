"""Queries of sampling and ingest, tracks and chains, telemetry, export, fusion and matching."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfix.functions import camera, geo
from skyfix.operators import frames as fr
from skyfix.operators import features, fusion, matchers, metrics, trajectory
from skyfix.plans.fixtures import ctes, view
from skyfix.plans.geometry import hav, lat_of, lon_of, m_lat, m_lon, merc_x, merc_y
from skyfix.plans.registry import query
from skyfix.plans.scoring import rounded
from skyfix.sources import export, store, tables, telemetry
from skyfix.sources.tables import shared_folder


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


TIME = "case event_id % 5 when 0 then cast(value as {s}) when 1 then cast(value as {s}) || ' s' when 2 then ' ' || cast(event_id as {s}) || ' s ' when 3 then 'n/a' end"


@query("sample_time_parse", f"SELECT event_id, try_cast(regexp_replace(trim({TIME.format(s='varchar')}), '\\s*s$', '') AS double) AS t_s FROM events")
def sample_time_parse(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", telemetry.sample_time(F.expr(TIME.format(s="string"))).alias("t_s"))


FIXES = "SELECT user_id AS track, event_id AS frame, CASE WHEN event_id % 17 = 0 THEN 0e0 WHEN event_id % 19 = 0 THEN 91e0 ELSE 43e0 + value / 1000e0 END AS lat, CASE WHEN event_id % 17 = 0 THEN 0e0 WHEN event_id % 23 = 0 THEN NULL ELSE -5e0 - value / 1000e0 END AS lon FROM {events}"


@query("gps_valid_filter", f"SELECT track, count(CASE WHEN ok THEN 1 END) AS n_valid, count(CASE WHEN NOT ok THEN 1 END) AS n_dropped FROM (SELECT track, coalesce(abs(lat) <= 90 AND abs(lon) <= 180 AND NOT (lat = 0 AND lon = 0), false) AS ok FROM ({FIXES.replace('{events}', 'events')}) f) g GROUP BY track")
def gps_valid_filter(spark, sf_dir):
    ok = telemetry.valid_fix(F.col("lat"), F.col("lon"))
    return spark.sql(FIXES, events=_events(spark, sf_dir)).groupBy("track").agg(F.count_if(ok).alias("n_valid"), F.count_if(~ok).alias("n_dropped"))


@query("uniform_sample", ctes("frames") + " SELECT track, idx, t_s FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY idx) AS k FROM frames WHERE idx % 5 = 0) x WHERE k <= 7")
def uniform_sample(spark, sf_dir):
    return fr.uniform(view(spark, sf_dir, "frames"), fr.sample_step(29.97, 1 / 6), 7, "track").select("track", F.col("idx").cast("long").alias("idx"), "t_s")


SPEC = "case when event_id % 3 = 0 then cast(event_id % 40 + 2 as {s}) when event_id % 3 = 1 then cast(event_id % 90 as {s}) || ', ' || cast(event_id % 7 as {s}) || ',' || cast(event_id % 90 as {s}) else '1' end"


@query("frame_spec", f"""WITH s AS (SELECT event_id, {SPEC.format(s='varchar')} AS spec FROM events),
a AS (SELECT event_id, cast(trim(unnest(string_split(spec, ','))) AS bigint) AS f FROM s WHERE contains(spec, ',')
  UNION ALL SELECT event_id, cast(round_even(unnest(range(0, cast(spec AS bigint))) * 100 / (cast(spec AS double) - 1), 0) AS bigint) FROM s WHERE NOT contains(spec, ',') AND spec <> '1' UNION ALL SELECT event_id, 0 FROM s WHERE spec = '1')
SELECT event_id, string_agg(cast(f AS varchar), ',' ORDER BY f) AS frames FROM (SELECT DISTINCT event_id, f FROM a) d GROUP BY event_id""")
def frame_spec(spark, sf_dir):
    listed = fr.parse_frames(F.expr(SPEC.format(s="string")), F.lit(101).cast("long"))
    return _events(spark, sf_dir).select("event_id", F.array_join(listed.cast("array<string>"), ",").alias("frames"))


@query("sharpest_in_window", ctes("frames") + " SELECT track, idx, blur_score FROM (SELECT *, row_number() OVER (PARTITION BY track, floor(idx / 5) ORDER BY blur_score DESC, idx) AS k FROM frames) x WHERE k = 1 AND blur_score >= 120")
def sharpest_in_window(spark, sf_dir):
    return fr.sharpest(view(spark, sf_dir, "frames"), 5, 120, "track").select("track", F.col("idx").cast("long").alias("idx"), "blur_score")


SHARDED = ", f AS (SELECT track, idx, cast(floor(t_s / 30) AS bigint) AS shard FROM frames)"
DONE = "(track + shard) % 3 = 0"


def _sharded(spark, sf_dir):
    return view(spark, sf_dir, "frames").select("track", F.col("idx").cast("long").alias("idx"), fr.shard_of(F.col("t_s"), 30).alias("shard"))


PLAN = SHARDED + f""", a AS (SELECT *, CASE WHEN {DONE} THEN 'skip' ELSE 'write' END AS action FROM f),
p AS (SELECT * FROM (SELECT *, coalesce(sum(CASE WHEN action = 'write' THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a) x WHERE before < 25)"""


def _plan(spark, sf_dir):
    rows = _sharded(spark, sf_dir)
    return rows, fr.ingest_plan(rows, rows.select("track", "shard").distinct().where(DONE), 25, "track")


@query("ingest_plan", ctes("frames") + PLAN + " SELECT track, idx, shard, action FROM p")
def ingest_plan(spark, sf_dir):
    return _plan(spark, sf_dir)[1].select("track", "idx", "shard", "action")


@query("shard_plan", ctes("frames") + PLAN + """, w AS (SELECT track, shard, max(idx) AS last, count(*) AS n_frames FROM f GROUP BY track, shard),
g AS (SELECT track, shard, max(idx) AS reached, count(CASE WHEN action = 'write' THEN 1 END) AS n_written, count(CASE WHEN action = 'skip' THEN 1 END) AS n_skipped FROM p GROUP BY track, shard),
e AS (SELECT track, max(idx) AS fin FROM f GROUP BY track), t AS (SELECT track, max(idx) AS top FROM p GROUP BY track)
SELECT w.track, w.shard, n_frames, n_written, n_skipped, CASE WHEN reached = last AND (top > last OR top = fin OR n_written = 0) THEN 'complete' ELSE 'partial' END AS status FROM w JOIN g USING (track, shard) JOIN e USING (track) JOIN t USING (track)""")
def shard_plan(spark, sf_dir):
    rows, plan = _plan(spark, sf_dir)
    return fr.shard_states(plan, rows, "track")


@query("frame_names", ctes("frames") + """ SELECT track, idx, printf('frame_%06d_t%07dms.jpg', idx, cast(trunc(t_s * 1000) AS bigint)) AS sample_name, printf('frame_%06d_t%08dms.jpg', idx, cast(trunc(t_s * 1000) AS bigint)) AS ingest_name FROM frames""")
def frame_names(spark, sf_dir):
    idx, ms = F.col("idx").cast("long"), fr.milliseconds(F.col("t_s"))
    return view(spark, sf_dir, "frames").select("track", idx.alias("idx"), fr.sample_name(idx, ms).alias("sample_name"), fr.ingest_name(idx, ms).alias("ingest_name"))


LOCAL = f", p AS (SELECT track, frame, (lon - -5.62429e0) * {m_lon('43.521955e0')} AS x, (lat - 43.521955e0) * {m_lat('43.521955e0')} AS y FROM gps_track)"


@query("path_length", ctes("gps_track") + LOCAL + " SELECT track, round(coalesce(sum(d), 0), 6) AS length_m FROM (SELECT track, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d FROM p WINDOW w AS (PARTITION BY track ORDER BY frame)) s GROUP BY track")
def path_length(spark, sf_dir):
    x, y = geo.to_local(F.col("lat"), F.col("lon"), F.lit(43.521955), F.lit(-5.62429))
    points = view(spark, sf_dir, "gps_track").select("track", "frame", x.alias("x"), y.alias("y"))
    return rounded(trajectory.path_length(points, "track", "frame", "x", "y"), {"length_m": 6})


SCORED = "SELECT * FROM frame_scores WHERE est_lat IS NOT NULL"
FITTED = f""", t AS ({SCORED}), ref AS (SELECT scenario, avg(gt_lat) AS rlat, avg(gt_lon) AS rlon FROM t GROUP BY scenario),
pr AS (SELECT t.scenario, frame, (est_lon - rlon) * {m_lon('rlat')} AS sx, (est_lat - rlat) * {m_lat('rlat')} AS sy, (gt_lon - rlon) * {m_lon('rlat')} AS dx, (gt_lat - rlat) * {m_lat('rlat')} AS dy FROM t JOIN ref USING (scenario)),
mu AS (SELECT scenario, avg(sx) AS msx, avg(sy) AS msy, avg(dx) AS mdx, avg(dy) AS mdy, count(*) AS n FROM pr GROUP BY scenario),
su AS (SELECT scenario, n, msx, msy, mdx, mdy, atan2(sum((sx - msx) * (dy - mdy) - (sy - msy) * (dx - mdx)), sum((sx - msx) * (dx - mdx) + (sy - msy) * (dy - mdy))) AS th, sum((sx - msx) * (dx - mdx) + (sy - msy) * (dy - mdy)) AS dot, sum((sx - msx) * (dy - mdy) - (sy - msy) * (dx - mdx)) AS crs, sum(pow(sx - msx, 2) + pow(sy - msy, 2)) AS var FROM pr JOIN mu USING (scenario) GROUP BY scenario, n, msx, msy, mdx, mdy),
fit AS (SELECT *, mdx - (cos(th) * msx - sin(th) * msy) AS tx, mdy - (sin(th) * msx + cos(th) * msy) AS ty FROM su)"""


def _scored(spark, sf_dir):
    return view(spark, sf_dir, "frame_scores").where("est_lat is not null")


def _pairs(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    ref = rows.groupBy("scenario").agg(F.avg("gt_lat").alias("rlat"), F.avg("gt_lon").alias("rlon"))
    e, g = (geo.to_local(F.col(f"{k}_lat"), F.col(f"{k}_lon"), F.col("rlat"), F.col("rlon")) for k in ("est", "gt"))
    return rows.join(ref, "scenario").select("scenario", "frame", e[0].alias("sx"), e[1].alias("sy"), g[0].alias("dx"), g[1].alias("dy"))


@query("se2_align", ctes("frame_scores") + FITTED + " SELECT scenario, n, round(degrees(th), 6) AS rot_deg, round(tx, 6) AS tx, round(ty, 6) AS ty FROM fit")
def se2_align(spark, sf_dir):
    return rounded(trajectory.fit_rigid(_pairs(spark, sf_dir), "scenario").select("scenario", "n", "rot_deg", "tx", "ty"), {"rot_deg": 6, "tx": 6, "ty": 6})


@query("similarity_fit", ctes("frame_scores") + FITTED + """ SELECT scenario, n, round(sqrt(dot * dot + crs * crs) / var, 9) AS scale, round(degrees(th), 6) AS rot_deg, round(mdx - sqrt(dot * dot + crs * crs) / var * (cos(th) * msx - sin(th) * msy), 6) AS tx FROM fit""")
def similarity_fit(spark, sf_dir):
    return rounded(trajectory.fit_similarity(_pairs(spark, sf_dir), "scenario").select("scenario", "n", "scale", "rot_deg", "tx"), {"scale": 9, "rot_deg": 6, "tx": 6})


@query("trajectory_score", ctes("frame_scores") + FITTED + """, er AS (SELECT pr.scenario, frame, sx, sy, dx, dy, sqrt(pow(sx - dx, 2) + pow(sy - dy, 2)) AS raw, sqrt(pow(cos(th) * sx - sin(th) * sy + tx - dx, 2) + pow(sin(th) * sx + cos(th) * sy + ty - dy, 2)) AS al FROM pr JOIN fit USING (scenario)),
ln AS (SELECT scenario, sum(a) AS est, sum(b) AS gt FROM (SELECT scenario, sqrt(pow(sx - lag(sx) OVER w, 2) + pow(sy - lag(sy) OVER w, 2)) AS a, sqrt(pow(dx - lag(dx) OVER w, 2) + pow(dy - lag(dy) OVER w, 2)) AS b FROM pr WINDOW w AS (PARTITION BY scenario ORDER BY frame)) z GROUP BY scenario)
SELECT scenario, count(*) AS n, round(sqrt(avg(raw * raw)), 6) AS ate_raw_m, round(sqrt(avg(al * al)), 6) AS ate_aligned_m, round(avg(al), 6) AS mean_aligned_m, round(median(al), 6) AS median_aligned_m, round(max(al), 6) AS worst_aligned_m, round(max(est), 4) AS est_length_m, round(max(gt), 4) AS gt_length_m, round(max(est) / max(gt), 9) AS length_ratio
FROM er JOIN ln USING (scenario) GROUP BY scenario""")
def trajectory_score(spark, sf_dir):
    out = trajectory.score(_scored(spark, sf_dir), "scenario").drop("rot_deg")
    return rounded(out, {c: 4 if c.endswith("length_m") else 9 if c == "length_ratio" else 6 for c in out.columns if c not in ("scenario", "n")})


TRACK = """, b AS (SELECT *, sum(CASE WHEN is_break THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY idx_from) AS broken FROM vo_links),
h AS (SELECT *, coalesce(sum(theta) OVER (PARTITION BY track ORDER BY idx_from ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hd FROM b WHERE broken = 0),
rel AS (SELECT track, idx_to AS frame, sum(cos(hd) * tx - sin(hd) * ty) OVER w AS x, sum(sin(hd) * tx + cos(hd) * ty) OVER w AS y FROM h WINDOW w AS (PARTITION BY track ORDER BY idx_from) UNION ALL SELECT track, min(idx_from), 0e0, 0e0 FROM vo_links GROUP BY track)"""


def _relative(spark, sf_dir):
    return trajectory.relative_track(view(spark, sf_dir, "vo_links"), "track")


@query("relative_track", ctes("vo_links") + TRACK + " SELECT track, frame, round(x, 6) AS x, round(y, 6) AS y FROM rel")
def relative_track(spark, sf_dir):
    return rounded(_relative(spark, sf_dir).withColumn("frame", F.col("frame").cast("long")), {"x": 6, "y": 6})


CONTROL = "SELECT track, idx_to AS frame, 43.521955e0 + (event_id % 101) * 1e-5 AS lat, -5.62429e0 + (event_id % 89) * 1e-5 AS lon FROM {vo_links} WHERE event_id % 4 = 0"


@query("anchor_trajectory", ctes("vo_links") + TRACK + f""", ct AS ({CONTROL.replace('{vo_links}', 'vo_links')}), u AS (SELECT * FROM rel JOIN ct USING (track, frame)), ref AS (SELECT track, avg(lat) AS rlat, avg(lon) AS rlon FROM u GROUP BY track),
pr AS (SELECT u.track, x AS sx, y AS sy, (lon - rlon) * {m_lon('rlat')} AS dx, (lat - rlat) * {m_lat('rlat')} AS dy FROM u JOIN ref USING (track)),
mu AS (SELECT track, avg(sx) AS msx, avg(sy) AS msy, avg(dx) AS mdx, avg(dy) AS mdy, count(*) AS n FROM pr GROUP BY track),
su AS (SELECT track, msx, msy, mdx, mdy, sum((sx - msx) * (dx - mdx) + (sy - msy) * (dy - mdy)) AS dot, sum((sx - msx) * (dy - mdy) - (sy - msy) * (dx - mdx)) AS crs, sum(pow(sx - msx, 2) + pow(sy - msy, 2)) AS var FROM pr JOIN mu USING (track) WHERE n >= 2 GROUP BY track, msx, msy, mdx, mdy),
ft AS (SELECT *, atan2(crs, dot) AS th, sqrt(dot * dot + crs * crs) / var AS s FROM su)
SELECT track, frame, round(rlat + (s * (sin(th) * x + cos(th) * y) + mdy - s * (sin(th) * msx + cos(th) * msy)) / {m_lat('rlat')}, 9) AS lat, round(rlon + (s * (cos(th) * x - sin(th) * y) + mdx - s * (cos(th) * msx - sin(th) * msy)) / {m_lon('rlat')}, 9) AS lon FROM rel JOIN ft USING (track) JOIN ref USING (track)""")
def anchor_trajectory(spark, sf_dir):
    controls = spark.sql(CONTROL, vo_links=view(spark, sf_dir, "vo_links"))
    out = trajectory.anchor_track(_relative(spark, sf_dir), controls, "track")
    return rounded(out.withColumn("frame", F.col("frame").cast("long")), {"lat": 9, "lon": 9})


@query("consecutive_links", ctes("vo_links") + " SELECT track, idx_to AS frame, nx AS next_frame, CASE WHEN NOT is_break AND n_inliers >= 40 THEN round(theta, 9) END AS theta, n_inliers FROM (SELECT *, lead(idx_to) OVER (PARTITION BY track ORDER BY idx_to) AS nx FROM vo_links) x WHERE nx IS NOT NULL")
def consecutive_links(spark, sf_dir):
    rows = trajectory.consecutive(view(spark, sf_dir, "vo_links").withColumn("frame", F.col("idx_to").cast("long")), "track")
    theta = trajectory.accepted(F.round("theta", 9), ~F.col("is_break"), F.col("n_inliers"), 40)
    return rows.select("track", "frame", "next_frame", theta.alias("theta"), F.col("n_inliers").cast("long").alias("n_inliers"))


NODES = "SELECT track, idx_from AS pos, is_anchor, is_break, n_inliers FROM {vo_links}"
BRUTE = f""", nd AS ({NODES.replace('{vo_links}', 'vo_links')}), isl AS (SELECT *, sum(cut) OVER (PARTITION BY track ORDER BY pos) AS island FROM (SELECT *, CASE WHEN lag(is_break) OVER (PARTITION BY track ORDER BY pos) THEN 1 ELSE 0 END AS cut FROM nd) c),
best AS (SELECT * FROM (SELECT a.track, a.pos, b.pos AS anchor, abs(a.pos - b.pos) AS hops, row_number() OVER (PARTITION BY a.track, a.pos ORDER BY abs(a.pos - b.pos), b.pos) AS k FROM isl a JOIN isl b ON a.track = b.track AND a.island = b.island AND b.is_anchor) x WHERE k = 1)"""


def _chain(spark, sf_dir):
    nodes = spark.sql(NODES, vo_links=view(spark, sf_dir, "vo_links")).withColumn("pos", F.col("pos").cast("long"))
    return trajectory.nearest_anchor(nodes, "track")


@query("nearest_anchor", ctes("vo_links") + BRUTE + " SELECT track, pos, hops, anchor FROM best")
def nearest_anchor(spark, sf_dir):
    return _chain(spark, sf_dir).select("track", "pos", "hops", "anchor")


@query("weakest_link", ctes("vo_links") + BRUTE + " SELECT b.track, b.pos, coalesce(min(l.n_inliers), 0) AS weakest FROM best b LEFT JOIN nd l ON l.track = b.track AND l.pos >= least(b.pos, b.anchor) AND l.pos < greatest(b.pos, b.anchor) GROUP BY b.track, b.pos")
def weakest_link(spark, sf_dir):
    return _chain(spark, sf_dir).select("track", "pos", F.col("weakest").cast("long").alias("weakest"))


@query("drift_curve", ctes("vo_links", "gps_track") + BRUTE + f""", pose AS (SELECT track, pos AS frame, hops, anchor, 43.521955e0 + pos * 1e-6 AS lat, -5.62429e0 + hops * 1e-6 AS lon FROM best),
gt AS (SELECT track, frame % 97 AS frame, avg(lat) AS glat, avg(lon) AS glon FROM gps_track GROUP BY track, frame % 97),
nr AS (SELECT p.*, glat, glon, row_number() OVER (PARTITION BY p.track, p.frame ORDER BY abs(g.frame - p.frame), g.frame) AS k FROM pose p JOIN gt g USING (track))
SELECT track, frame, hops, anchor, round({hav('glat', 'glon', 'lat', 'lon')}, 6) AS err_m FROM nr WHERE k = 1""")
def drift_curve(spark, sf_dir):
    pose = _chain(spark, sf_dir).select("track", "pos", "hops", "anchor", (F.lit(43.521955) + F.col("pos") * 1e-6).alias("lat"), (F.lit(-5.62429) + F.col("hops") * 1e-6).alias("lon"))
    truth = view(spark, sf_dir, "gps_track").groupBy("track", (F.col("frame") % 97).alias("frame")).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return trajectory.drift(pose, truth, "track").select("track", "frame", "hops", "anchor", F.round("err_m", 6).alias("err_m"))


COORDS = "string_agg(CASE WHEN {a} IS NOT NULL THEN printf('%.8f,%.8f,0', {b}, {a}) END, ' ' ORDER BY frame)"


def _kml(rows):
    rows = rows.withColumns({c: F.col(c) + 3e-11 for c in ("est_lat", "est_lon")})  # no value half-way between two last digits
    return export.kml(rows, "scenario").select("scenario", "estimated", "ground_truth")


@query("kml_track", ctes("frame_scores") + f" SELECT scenario, coalesce({COORDS.format(a='(est_lat + 3e-11)', b='(est_lon + 3e-11)')}, '') AS estimated, coalesce({COORDS.format(a='gt_lat', b='gt_lon')}, '') AS ground_truth FROM frame_scores GROUP BY scenario")
def kml_track(spark, sf_dir):
    return _kml(view(spark, sf_dir, "frame_scores"))


@query("kml_track_all")
def kml_track_all(spark, sf_dir):
    """Every frame's points."""
    return _kml(view(spark, sf_dir, "frame_scores"))


@query("geojson_summary", ctes("frame_scores") + """ SELECT scenario, count(est_lat) AS n_estimated, round(arg_min(est_lon, frame) FILTER (WHERE est_lat IS NOT NULL), 10) AS first_lon_estimated, round(arg_max(est_lat, frame) FILTER (WHERE est_lat IS NOT NULL), 10) AS last_lat_estimated,
  count(gt_lat) AS n_ground_truth, round(arg_min(gt_lon, frame), 10) AS first_lon_ground_truth, round(arg_max(gt_lat, frame), 10) AS last_lat_ground_truth FROM frame_scores GROUP BY scenario""")
def geojson_summary(spark, sf_dir):
    out = export.geojson_summary(view(spark, sf_dir, "frame_scores"), "scenario")
    return rounded(out, {c: 10 for c in out.columns if "_lon_" in c or "_lat_" in c})


@query("geojson_track")
def geojson_track(spark, sf_dir):
    return export.geojson(view(spark, sf_dir, "frame_scores"), "scenario")


@query("geojson_features", ctes("frame_scores") + """ SELECT * FROM (SELECT scenario, 'estimate' AS track, count(est_lat) AS n, CASE WHEN count(est_lat) > 1 THEN 'LineString' ELSE 'Point' END AS kind, round(arg_min(est_lon, frame) FILTER (WHERE est_lat IS NOT NULL), 10) AS first_lon FROM frame_scores GROUP BY scenario
  UNION ALL SELECT scenario, 'ground_truth', count(gt_lat), CASE WHEN count(gt_lat) > 1 THEN 'LineString' ELSE 'Point' END, round(arg_min(gt_lon, frame), 10) FROM frame_scores GROUP BY scenario) x WHERE n > 0""")
def geojson_features(spark, sf_dir):
    """What the GeoJSON text says, read back."""
    schema = "features ARRAY<STRUCT<properties: STRUCT<track: STRING, name: STRING, n: BIGINT>, geometry: STRUCT<type: STRING, coordinates: STRING>>>"
    rows = export.geojson(view(spark, sf_dir, "frame_scores"), "scenario").select("scenario", F.explode(F.from_json("geojson", schema)["features"]).alias("f"))
    first = F.regexp_extract("f.geometry.coordinates", r"([-0-9.E]+),", 1).cast("double")
    return rows.select("scenario", "f.properties.track", "f.properties.n", F.col("f.geometry.type").alias("kind"), F.round(first, 10).alias("first_lon"))


@query("ratio_test_knn", """WITH d AS (SELECT q.label, q.vec_id AS query_id, t.vec_id AS train_id, sqrt(list_sum(list_transform(list_zip(q.embedding, t.embedding), lambda x: pow(cast(x[1] AS double) - cast(x[2] AS double), 2)))) AS dist FROM embeddings q JOIN embeddings t ON q.label = t.label AND q.vec_id % 2 = 0 AND t.vec_id % 2 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, train_id) AS k, lead(dist) OVER (PARTITION BY query_id ORDER BY dist, train_id) AS nxt FROM d) SELECT query_id, train_id, round(dist, 6) AS distance FROM r WHERE k = 1 AND dist < 0.95e0 * nxt""")
def ratio_test_knn(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    out = features.ratio_test(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), "label", 0.95)
    return out.select("query_id", "train_id", F.round("distance", 6).alias("distance"))


DOCS = "SELECT user_id AS track, 'Doc' || (event_id % 37 + 1) || ':GPSLatitude' AS tag FROM {events}"


@query("doc_frame_order", f"SELECT track, doc, row_number() OVER (PARTITION BY track ORDER BY doc) - 1 AS slot, doc - 1 AS frame FROM (SELECT DISTINCT track, cast(regexp_extract(tag, '^Doc(\\d+):', 1) AS bigint) AS doc FROM ({DOCS.replace('{events}', 'events')}) t) d")
def doc_frame_order(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = spark.sql(DOCS, events=_events(spark, sf_dir)).select("track", F.regexp_extract("tag", telemetry.GROUP, 1).cast("long").alias("doc")).distinct()
    return rows.select("track", "doc", (F.row_number().over(Window.partitionBy("track").orderBy("doc")) - 1).cast("long").alias("slot"), (F.col("doc") - 1).alias("frame"))


@query("telemetry_pivot", """WITH d AS (SELECT user_id AS track, event_id % 97 AS frame, arg_max(printf('%.6f', 43e0 + value / 1000e0), event_id) AS lat, arg_max(printf('%.6f', -5e0 - value / 1000e0), event_id) AS lon, max(event_id) AS t FROM events GROUP BY 1, 2)
SELECT track, frame, cast(t AS double) AS t_s, cast(lat AS double) AS lat, cast(lon AS double) AS lon, cast(NULL AS double) AS alt_m, true AS valid FROM d WHERE abs(cast(lat AS double)) <= 90 AND abs(cast(lon AS double)) <= 180""")
def telemetry_pivot(spark, sf_dir):
    """One grouped JSON object a track, made of its events, read back as fixes."""
    e = _events(spark, sf_dir)
    n = F.concat(F.lit("Doc"), (F.col("event_id") % 97 + 1).cast("string"), F.lit(":"))
    six = lambda c: F.format_string("%.6f", c)
    tags = [F.struct(F.concat(n, F.lit(t)).alias("key"), v.alias("value")) for t, v in (("GPSLatitude", six(43 + F.col("value") / 1000)), ("GPSLongitude", six(-5 - F.col("value") / 1000)), ("SampleTime", F.concat(F.col("event_id").cast("string"), F.lit(" s"))))]
    pairs = e.select("user_id", "event_id", F.explode(F.array(*tags)).alias("t")).groupBy("user_id", "t.key").agg(F.max_by("t.value", "event_id").alias("value"))
    docs = pairs.groupBy(F.col("user_id").alias("track")).agg(F.to_json(F.array(F.map_from_entries(F.collect_list(F.struct("key", "value"))))).alias("json"))
    return telemetry.fixes(docs).where("valid")


CHAINED = BRUTE + """, lk AS (SELECT track, idx_from AS at, cos(theta) AS c, sin(theta) AS s, tx, ty FROM vo_links WHERE NOT is_break),
st AS (SELECT b.track, b.anchor, b.pos, b.hops, b.pos > b.anchor AS fwd, CASE WHEN b.pos > b.anchor THEN c ELSE c END AS p, CASE WHEN b.pos > b.anchor THEN s ELSE -s END AS q, CASE WHEN b.pos > b.anchor THEN -(c * tx + s * ty) ELSE tx END AS u, CASE WHEN b.pos > b.anchor THEN s * tx - c * ty ELSE ty END AS z
  FROM best b JOIN lk ON lk.track = b.track AND lk.at = CASE WHEN b.pos > b.anchor THEN b.pos - 1 ELSE b.pos END WHERE b.hops > 0),
r AS (SELECT track, anchor, pos, hops, NULL::boolean AS fwd, 1e0 AS a, 0e0 AS b, 1500e0 AS x, 0e0 AS d, 1e0 AS e, 1500e0 AS y FROM best WHERE hops = 0
  UNION ALL SELECT n.track, n.anchor, n.pos, n.hops, n.fwd, r.a * n.p - r.b * n.q, r.a * n.q + r.b * n.p, r.a * n.u + r.b * n.z + r.x, r.d * n.p - r.e * n.q, r.d * n.q + r.e * n.p, r.d * n.u + r.e * n.z + r.y
  FROM r JOIN st n ON n.track = r.track AND n.anchor = r.anchor AND n.hops = r.hops + 1 AND coalesce(r.fwd, n.fwd) = n.fwd)
SELECT track, pos, anchor, hops, round(a, 6) + 0e0 AS h0, round(b, 6) + 0e0 AS h1, round(x, 4) + 0e0 AS h2, round(d, 6) + 0e0 AS h3, round(e, 6) + 0e0 AS h4, round(y, 4) + 0e0 AS h5, 0e0 AS h6, 0e0 AS h7, 1e0 AS h8 FROM r"""


@query("chain_homographies", ctes("vo_links").replace("WITH ", "WITH RECURSIVE ", 1) + CHAINED)
def chain_homographies(spark, sf_dir):
    links = view(spark, sf_dir, "vo_links").withColumn("pos", F.col("idx_from").cast("long"))
    c, s = F.cos("theta"), F.sin("theta")
    zero, one = F.lit(0.0), F.lit(1.0)
    h = F.array(c, -s, F.col("tx"), s, c, F.col("ty"), zero, zero, one)
    anchors = links.where("is_anchor").select("track", F.col("pos").alias("anchor"), F.array(one, zero, F.lit(1500.0), zero, one, F.lit(1500.0), zero, zero, one).alias("h_to_ref"))
    chain = trajectory.chain_homographies(links.where(~F.col("is_break")).select("track", "pos", h.alias("h")), _chain(spark, sf_dir), anchors, "track")
    return chain.select("track", "pos", "anchor", "hops", *[(F.round(F.col("h")[i], 4 if i in (2, 5) else 6) + F.lit(0.0)).alias(f"h{i}") for i in range(9)])


@query("ground_pose_decompose", ctes("homographies") + " SELECT frame, 0e0 AS east_m, 0e0 AS north_m, round(90e0 * sqrt(a * a + b * b), 6) AS altitude_m, 0e0 AS tilt_deg FROM homographies")
def ground_pose_decompose(spark, sf_dir):
    """A camera straight above the frame's centre: its height is the focal length times the metres of a pixel."""
    g = F.expr("array(a / 10, -b / 10, -64 * a + 36 * b, -b / 10, -a / 10, 64 * b + 36 * a, 0e0, 0e0, 1e0)")
    k = camera.intrinsics(F.lit(900.0), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(1280.0), F.lit(720.0))
    rows = view(spark, sf_dir, "homographies").select("frame", g.alias("g"), k.alias("k"))
    found = rows.select("frame", camera.ground_pose(F.col("g"), F.col("k")).alias("p")).select("frame", "p.*")
    return found.select("frame", *[(F.round(c, n) + F.lit(0.0)).alias(c) for c, n in (("east_m", 6), ("north_m", 6), ("altitude_m", 6), ("tilt_deg", 4))])


BOXES = f"SELECT event_id AS tile_id, {merc_x('lon')} AS x, {merc_y('lat')} AS y, span_m FROM "


@query("tiles_holding", ctes("points") + f""", b AS ({BOXES} points) SELECT p.tile_id AS event_id, t.tile_id FROM b p JOIN b t ON p.x >= t.x - t.span_m / 2e0 AND p.x <= t.x + t.span_m / 2e0 AND p.y >= t.y - t.span_m / 2e0 AND p.y <= t.y + t.span_m / 2e0""")
def tiles_holding(spark, sf_dir):
    """Every place with the tiles that hold it: the tiles are squares about the same places."""
    x, y = geo.to_mercator(F.col("lon"), F.col("lat"))
    rows = view(spark, sf_dir, "points").select("event_id", x.alias("x"), y.alias("y"), "span_m")
    half = F.col("span_m") / 2
    box = F.struct((F.col("x") - half).alias("minx"), (F.col("y") - half).alias("miny"), (F.col("x") + half).alias("maxx"), (F.col("y") + half).alias("maxy"))
    return store.holding(rows.select("event_id", "x", "y"), rows.select(F.col("event_id").alias("tile_id"), box.alias("tile"))).select("event_id", "tile_id")


_LINK = CHAINED[: CHAINED.index("SELECT track, pos, anchor, hops, round(a, 6)")]
_PX, _PY = "(r.a * 200e0 + r.b * 200e0 + r.x)", "(r.d * 200e0 + r.e * 200e0 + r.y)"


@query("chain_drift", ctes("vo_links", "gps_track", "tile_row").replace("WITH ", "WITH RECURSIVE ", 1) + _LINK + f""", pose AS (SELECT r.track, r.pos AS frame, r.hops, r.anchor, {lat_of(f'maxy - {_PY} * (maxy - miny) / height')} AS lat, {lon_of(f'minx + {_PX} * (maxx - minx) / width')} AS lon FROM r, tile_row),
gt AS (SELECT track, frame % 97 AS frame, avg(lat) AS glat, avg(lon) AS glon FROM gps_track GROUP BY track, frame % 97),
nr AS (SELECT p.*, glat, glon, row_number() OVER (PARTITION BY p.track, p.frame ORDER BY abs(g.frame - p.frame), g.frame) AS k FROM pose p JOIN gt g USING (track))
SELECT track, frame, hops, anchor, round({hav('glat', 'glon', 'lat', 'lon')}, 4) AS err_m FROM nr WHERE k = 1""")
def chain_drift(spark, sf_dir):
    """Chained poses on their anchors' tile, and how far they are from the truth."""
    links = view(spark, sf_dir, "vo_links").withColumn("pos", F.col("idx_from").cast("long"))
    c, s = F.cos("theta"), F.sin("theta")
    zero, one = F.lit(0.0), F.lit(1.0)
    h = F.array(c, -s, F.col("tx"), s, c, F.col("ty"), zero, zero, one)
    tile = view(spark, sf_dir, "tile_row").select(F.struct("width", "height", "minx", "miny", "maxx", "maxy").alias("tile")).first()["tile"]
    tile = F.struct(*[F.lit(tile[c]).alias(c) for c in ("width", "height", "minx", "miny", "maxx", "maxy")])
    anchors = links.where("is_anchor").select("track", F.col("pos").alias("anchor"), F.array(one, zero, F.lit(1500.0), zero, one, F.lit(1500.0), zero, zero, one).alias("h_to_ref"), tile.alias("tile"))
    poses = trajectory.chain_poses(links.where(~F.col("is_break")).select("track", "pos", h.alias("h")), _chain(spark, sf_dir), anchors, "track", F.lit(400.0), F.lit(400.0))
    truth = view(spark, sf_dir, "gps_track").groupBy("track", (F.col("frame") % 97).alias("frame")).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return trajectory.drift(poses, truth, "track").select("track", "frame", "hops", "anchor", F.round("err_m", 4).alias("err_m"))


TILTED_SQL = """SELECT event_id AS frame, event_id % 13 * 5e0 AS tilt, 60e0 + event_id % 90 AS height, radians(event_id % 360) AS heading FROM {events}"""


#: The frame's centre is at one place; the camera stands off it, against its heading.
FOOT = [f"({PX} - height * tan(radians(tilt)) * {f}(heading) / cos(radians(43.5e0)))" for PX, f in ((merc_x("-5.6e0"), "sin"), (merc_y("43.5e0"), "cos"))]


@query("nadir_pose", "WITH c AS (" + TILTED_SQL.replace("{events}", "events") + f""") SELECT frame, round(tilt, 5) AS tilt_deg, round(height, 5) AS altitude_m, round({lat_of(FOOT[1])}, 8) AS lat, round({lon_of(FOOT[0])}, 8) AS lon FROM c""")
def nadir_pose(spark, sf_dir):
    """Tilted cameras that look at one place from all sides: the homography to a tile is made from the camera, and the place under the camera is found again.

    A camera at this height above the origin whose axis leans by the tilt towards the heading sees the ground point (e, n) at K R (e, n, -height); the inverse maps pixels to ground, and ground to the tile."""
    rows = spark.sql(TILTED_SQL, events=_events(spark, sf_dir)).withColumns({"a": F.radians("tilt"), "f": F.lit(900.0)})
    sa, ca, sh, ch = F.sin("a"), F.cos("a"), F.sin("heading"), F.cos("heading")
    zero, one = F.lit(0.0), F.lit(1.0)
    # rows of the rotation: to the right, down in the picture, along the axis
    right, axis = (ch, -sh, zero), (sa * sh, sa * ch, -ca)
    down = (axis[1] * right[2] - axis[2] * right[1], axis[2] * right[0] - axis[0] * right[2], axis[0] * right[1] - axis[1] * right[0])
    view_ = [r[c] if c < 2 else -F.col("height") * r[2] for r in (right, down, axis) for c in range(3)]
    k = F.array(F.col("f"), zero, F.lit(640.0), zero, F.col("f"), F.lit(360.0), zero, zero, one)
    x, y = geo.to_mercator(F.lit(-5.6), F.lit(43.5))
    tile = F.struct((x - 2000).alias("minx"), (y - 2000).alias("miny"), (x + 2000).alias("maxx"), (y + 2000).alias("maxy"), F.lit(4000).alias("width"), F.lit(4000).alias("height"))
    rows = rows.select("frame", "height", "a", "heading", F.array(*view_).alias("view"), k.alias("k"), tile.alias("tile"))
    rows = rows.select("frame", "height", "a", "heading", "k", "tile", camera.product(F.col("k"), F.col("view")).alias("seen"))
    rows = rows.select("frame", "height", "a", "heading", "k", "tile", camera.inverse(F.col("seen")).alias("ground"))
    stretch = 1 / F.cos(F.radians(F.lit(43.5)))  # metres of the map for one of ground, where the frame's centre is
    east, north = (F.col("height") * F.tan("a") * f("heading") for f in (F.sin, F.cos))
    to_tile = F.array(stretch, zero, F.lit(2000.0) - east * stretch, zero, -stretch, F.lit(2000.0) + north * stretch, zero, zero, one)
    rows = rows.select("frame", "k", "tile", camera.product(to_tile, F.col("ground")).alias("h"))
    seen = camera.nadir_pose(F.col("h"), F.lit(1280.0), F.lit(720.0), F.col("k"))
    found = rows.select("frame", *[c.alias(n) for n, c in seen.items()])
    return found.select("frame", (F.round("tilt_deg", 5) + F.lit(0.0)).alias("tilt_deg"), F.round("altitude_m", 5).alias("altitude_m"), F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"))


#: The filter forwards and the smoother backwards, one step of all tracks a recursion: e, n, ve, vn, the three numbers of the covariance and its determinant; q... before the step's fix.
#: The determinant is carried along: taken from the covariance it would be a difference of nearly equal products where steps lie far apart.
STATES = """, z AS (SELECT track, frame, t_s, pos_e, pos_n, row_number() OVER (PARTITION BY track ORDER BY frame) AS i, coalesce(t_s - lag(t_s) OVER (PARTITION BY track ORDER BY frame), 0e0) AS dt FROM fusion_steps),
b AS (SELECT track, arg_min(pos_e, i) AS e0, arg_min(pos_n, i) AS n0 FROM z WHERE pos_e IS NOT NULL GROUP BY track),
r AS (SELECT track, 0::bigint AS i, 0e0 AS dt, 0e0 AS qe, 0e0 AS qn, e0 AS e, n0 AS n, 0e0 AS ve, 0e0 AS vn, 2500e0 AS p, 0e0 AS c, 100e0 AS v, 250000e0 AS det, false AS used, false AS rejected FROM b
  UNION ALL SELECT track, i, dt, qe, qn, qe + k * (pos_e - qe), qn + k * (pos_n - qn), ve + m * (pos_e - qe), vn + m * (pos_n - qn),
    CASE WHEN hit THEN qp * 64e0 / (qp + 64e0) ELSE qp END, CASE WHEN hit THEN qc * 64e0 / (qp + 64e0) ELSE qc END, CASE WHEN hit THEN (qdet + 64e0 * qv) / (qp + 64e0) ELSE qv END, CASE WHEN hit THEN qdet * 64e0 / (qp + 64e0) ELSE qdet END, hit, fix AND NOT hit
  FROM (SELECT *, CASE WHEN hit THEN qp / (qp + 64e0) ELSE 0e0 END AS k, CASE WHEN hit THEN qc / (qp + 64e0) ELSE 0e0 END AS m
  FROM (SELECT *, fix AND (pow(pos_e - qe, 2) + pow(pos_n - qn, 2)) / (qp + 64e0) <= 13.816e0 AS hit
  FROM (SELECT *, e + dt * ve AS qe, n + dt * vn AS qn, p + 2e0 * dt * c + dt * dt * v + t * t * t * t / 4e0 AS qp, c + dt * v + t * t * t / 2e0 AS qc, v + t * t AS qv, det + (t * (p * t - c * u) - u * (c * t - v * u)) AS qdet
  FROM (SELECT z.track, z.i, z.dt, z.pos_e IS NOT NULL AS fix, coalesce(z.pos_e, 0e0) AS pos_e, coalesce(z.pos_n, 0e0) AS pos_n, r.e, r.n, r.ve, r.vn, r.p, r.c, r.v, r.det,
    greatest(z.dt, 1e-6) AS t, greatest(z.dt, 1e-6) * greatest(z.dt, 1e-6) / 2e0 - z.dt * greatest(z.dt, 1e-6) AS u FROM r JOIN z ON z.track = r.track AND z.i = r.i + 1) y0) w0) w1) w2),
h AS (SELECT *, lead(dt) OVER w AS d, lead(qe) OVER w AS le, lead(qn) OVER w AS ln FROM r WHERE i > 0 WINDOW w AS (PARTITION BY track ORDER BY i)),
g AS (SELECT *, greatest(d, 1e-6) AS t, greatest(d, 1e-6) * greatest(d, 1e-6) / 2e0 - d * greatest(d, 1e-6) AS u FROM h),
g1 AS (SELECT *, p * t - c * u AS x, c * t - v * u AS y, det + (t * (p * t - c * u) - u * (c * t - v * u)) AS den FROM g),
g2 AS (SELECT *, (det + t * x) / den AS a1, -(d * det + t * t / 2e0 * x) / den AS a2, t * y / den AS a3, (det - t * t / 2e0 * y) / den AS a4, det / den AS f FROM g1),
s AS (SELECT track, i, e, n, ve, vn, p, c, v FROM g2 WHERE d IS NULL
  UNION ALL SELECT g2.track, g2.i, g2.e + a1 * (s.e - le) + a2 * (s.ve - g2.ve), g2.n + a1 * (s.n - ln) + a2 * (s.vn - g2.vn), g2.ve + a3 * (s.e - le) + a4 * (s.ve - g2.ve), g2.vn + a3 * (s.n - ln) + a4 * (s.vn - g2.vn),
    f * u * u + (a1 * s.p + a2 * s.c) * a1 + (a1 * s.c + a2 * s.v) * a2, f * u * t + (a1 * s.p + a2 * s.c) * a3 + (a1 * s.c + a2 * s.v) * a4, f * t * t + (a3 * s.p + a4 * s.c) * a3 + (a3 * s.c + a4 * s.v) * a4
  FROM s JOIN g2 ON g2.track = s.track AND g2.i = s.i - 1)"""
FUSED = STATES + """
SELECT track, z.frame, round(z.t_s, 6) AS t_s, round(s.e, 5) + 0e0 AS east, round(s.n, 5) + 0e0 AS north, round(s.ve, 5) + 0e0 AS v_east, round(s.vn, 5) + 0e0 AS v_north, round(sqrt(greatest(2e0 * s.p, 0e0)), 5) AS pos_std_m, r.used AS fix_used, r.rejected AS fix_rejected
FROM s JOIN r USING (track, i) JOIN z USING (track, i)"""


@query("fuse_track", ctes("fusion_steps").replace("WITH ", "WITH RECURSIVE ", 1) + FUSED)
def fuse_track(spark, sf_dir):
    out = fusion.fuse_tracks(view(spark, sf_dir, "fusion_steps"), "track")
    return out.select("track", "frame", F.round("t_s", 6).alias("t_s"), *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("east", "north", "v_east", "v_north", "pos_std_m")], "fix_used", "fix_rejected")


FUSED_SCORES = (
    f""", o AS (SELECT scenario, avg(est_lat) AS rlat, avg(est_lon) AS rlon FROM frame_scores WHERE locked AND est_lat IS NOT NULL GROUP BY scenario),
fusion_steps AS (SELECT scenario AS track, frame, t_s, CASE WHEN locked AND est_lat IS NOT NULL THEN (est_lon - rlon) * {m_lon('rlat')} END AS pos_e, CASE WHEN locked AND est_lat IS NOT NULL THEN (est_lat - rlat) * {m_lat('rlat')} END AS pos_n FROM frame_scores JOIN o USING (scenario))"""
    + STATES
    + f"""
SELECT s.track AS scenario, z.frame, round(z.t_s, 6) AS t_s, round(rlat + s.n / {m_lat('rlat')}, 9) AS lat, round(rlon + s.e / {m_lon('rlat')}, 9) AS lon, round(sqrt(greatest(2e0 * s.p, 0e0)), 5) AS pos_std_m, r.used AS fix_used, r.rejected AS fix_rejected
FROM s JOIN r USING (track, i) JOIN z USING (track, i) JOIN o ON o.scenario = s.track"""
)


@query("fuse_frame_scores", ctes("frame_scores").replace("WITH ", "WITH RECURSIVE ", 1) + FUSED_SCORES)
def fuse_frame_scores(spark, sf_dir):
    out = fusion.fuse_scores(view(spark, sf_dir, "frame_scores"), "scenario")
    return rounded(out, {"t_s": 6, "lat": 9, "lon": 9, "pos_std_m": 5})


@query("verify_ingest", """WITH m AS (SELECT event_id % 40 AS shard, CASE WHEN event_id % 40 < 30 THEN 'complete' ELSE 'partial' END AS status, event_id % 700 = 1 OR event_id % 501 = 0 OR event_id % 613 = 2 AS bad FROM events)
SELECT shard, status, count(CASE WHEN bad THEN 1 END) AS n_problems, CASE WHEN status = 'complete' AND count(CASE WHEN bad THEN 1 END) > 0 THEN 'partial' ELSE status END AS new_status FROM m GROUP BY shard, status""")
def verify_ingest(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "event_type", F.concat(F.unhex(F.lit("FFD8")), F.encode(F.coalesce("props", F.lit("")), "UTF-8"), F.unhex(F.when(F.col("event_id") % 613 == 2, "FF").otherwise("FFD9"))).alias("content"))
    name = F.format_string("frame_%06d.jpg", F.col("event_id"))
    manifest = e.select((F.col("event_id") % 40).alias("shard"), F.when(F.col("event_id") % 40 < 30, "complete").otherwise("partial").alias("status"), name.alias("filename"), (F.length("content") + (F.col("event_id") % 501 == 0).cast("int")).alias("bytes"), F.sha1("content").alias("sha1"))
    files = e.where("event_id % 700 <> 1").select(name.alias("filename"), "content")
    return fr.verified_shards(fr.verify(manifest, files))


#: Places to which the values of a score are compared.
PLACES = {"t_s": 9, "est_lat": 10, "est_lon": 10, "gt_lat": 10, "gt_lon": 10, "err_m": 6, "runtime_s": 9}


@query("csv_roundtrip", ctes("frame_scores") + f" SELECT frame, {', '.join(f'round({c}, {n}) AS {c}' for c, n in PLACES.items())}, cast(NULL AS double) AS yaw_deg, n_inliers, locked FROM frame_scores")
def csv_roundtrip(spark, sf_dir):
    """Scores written as CSV, in the folder that all executors share, and read back; rows and values are the same."""
    path = f"{shared_folder(spark)}/scores-{uuid.uuid4().hex}"
    rows = view(spark, sf_dir, "frame_scores").withColumn("yaw_deg", F.lit(None).cast("double"))
    tables.write_scores(rows.select(*[f.name for f in T._parse_datatype_string(tables.SCORES).fields]), path)
    return rounded(tables.read_scores(spark, path), PLACES)


PLANTED = (1.02, -0.05, 300.0, 0.04, 0.98, 200.0, 1e-5, 2e-5, 1.0)
_U, _V, _W = (f"({PLANTED[3 * i]!r} * sx + {PLANTED[3 * i + 1]!r} * sy + {PLANTED[3 * i + 2]!r})" for i in range(3))


@query("estimate_homography", f"""WITH e AS (SELECT user_id AS frame, event_id AS o, cast(event_id * 37 % 1280 AS double) AS sx, cast(event_id * 53 % 720 AS double) AS sy FROM events),
g AS (SELECT frame, CASE WHEN o % 5 = 0 THEN sqrt(pow({_U} / {_W} - o % 700, 2) + pow({_V} / {_W} - o % 500, 2)) ELSE 0 END AS off FROM e),
c AS (SELECT frame, count(*) AS n_matches, CASE WHEN count(*) < 4 THEN 0 ELSE count(CASE WHEN off < 5 THEN 1 END) END AS n_inliers FROM g GROUP BY frame)
SELECT frame, n_matches, n_inliers, n_inliers >= 12 AS accepted, {', '.join(f'CASE WHEN n_inliers >= 12 THEN {x!r} END AS h{i}' for i, x in enumerate(PLANTED))} FROM c""")
def estimate_homography(spark, sf_dir):
    """A planted homography recovered from correspondences of which a fifth are wrong."""
    e = _events(spark, sf_dir).select(F.col("user_id").alias("frame"), F.col("event_id").alias("ordinal"), (F.col("event_id") * 37 % 1280).cast("double").alias("sx"), (F.col("event_id") * 53 % 720).cast("double").alias("sy"))
    dx, dy = camera.project(F.array(*[F.lit(x) for x in PLANTED]), F.col("sx"), F.col("sy"))
    wrong = F.col("ordinal") % 5 == 0
    pairs = e.select("frame", "ordinal", "sx", "sy", F.when(wrong, F.col("ordinal") % 700).otherwise(dx).alias("dx"), F.when(wrong, F.col("ordinal") % 500).otherwise(dy).alias("dy"))
    out = matchers.homographies(pairs, "frame")
    return out.select("frame", "n_matches", "n_inliers", F.col("h").isNotNull().alias("accepted"), *[F.round(F.col("h")[i], n).alias(f"h{i}") for i, n in enumerate((3, 3, 1, 3, 3, 1, 6, 6, 6))])


SIGNS = "SELECT label, vec_id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings"


@query("binary_two_nearest", f"""WITH s AS ({SIGNS}), d AS (SELECT q.label, q.vec_id AS query_id, t.vec_id AS train_id, len(list_filter(list_zip(q.b, t.b), lambda x: x[1] <> x[2])) AS dist FROM s q JOIN s t ON q.label = t.label AND q.vec_id % 2 = 0 AND t.vec_id % 2 = 1),
r AS (SELECT *, row_number() OVER w AS k, lead(dist) OVER w AS nxt FROM d WINDOW w AS (PARTITION BY query_id ORDER BY dist, train_id)) SELECT query_id, train_id, cast(dist AS double) AS distance, cast(nxt AS double) AS second FROM r WHERE k = 1 AND nxt IS NOT NULL""")
def binary_two_nearest(spark, sf_dir):
    """Signs of the embeddings as binary descriptors, in small blocks: the nearest two by Hamming distance."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    octets = F.transform(F.expr("sequence(0, size(embedding) div 8 - 1)"), lambda i: F.lpad(F.conv(F.array_join(F.transform(F.slice("embedding", (i * 8 + 1).cast("int"), F.lit(8)), lambda x: F.when(x > 0, "1").otherwise("0")), ""), 2, 16), 2, "0"))
    bits = rows.select("label", F.col("vec_id").alias("id"), F.unhex(F.array_join(octets, "")).alias("vector"))
    return features.two_nearest(bits.where("id % 2 = 0"), bits.where("id % 2 = 1"), "label", block=64).select("query_id", "train_id", "distance", "second")


@F.pandas_udf(T.BinaryType())
def _pictures(ids: pd.Series) -> pd.Series:
    """Pictures of 16 x 16 pixels: (i * id + i * i) % 256 of the i-th."""
    i = np.arange(256)
    made = ((i * (ids.to_numpy()[:, None] % 256) + i * i) % 256).astype(np.uint8)
    return pd.Series([row.tobytes() for row in made])


@query("focus_measure")
def focus_measure(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.round(matchers.focus_measure(_pictures("event_id"), F.lit(16), F.lit(16)), 6).alias("focus"))
