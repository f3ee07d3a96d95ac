"""Frame scores, search, sampling, ingest, telemetry and export on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from skyfix.functions import camera, geo
from skyfix.operators import asof, frames, metrics, search
from skyfix.plans import runner
from skyfix.sources import benchmark, export, tables, telemetry

SCORE = "scenario long, model string, frame long, t_s double, est_lat double, est_lon double, gt_lat double, gt_lon double, err_m double, n_inliers long, locked boolean, runtime_s double"


def _scores(spark, rows):
    return spark.createDataFrame([(1, m, f, 0.0, 1.0, 2.0, 1.0, 2.0, e, 30, k, 1.0) for m, f, e, k in rows], SCORE)


def test_metrics(spark):
    df = _scores(spark, [("a", 0, 0.5, True), ("a", 1, 3.0, True), ("a", 2, 8.0, True), ("a", 3, None, False), ("b", 0, None, True), ("b", 1, 1.0, False)])
    got = {r.model: r for r in metrics.field_metrics(df, "scenario", "model").collect()}
    a, b = got["a"], got["b"]
    assert (a.recall_1m, a.recall_5m, a.recall_10m, a.lock_rate, a.median_err_m, a.worst_err_m) == (0.25, 0.5, 0.75, 0.75, 3.0, 8.0)
    assert (b.n_locked, b.lock_rate, b.recall_10m, b.median_err_m) == (0, 0.0, 0.0, None)
    best = lambda m: [r.model for r in metrics.select_best(metrics.field_metrics(df, "scenario", "model"), m, "scenario").collect()]
    assert best("recall_5m") == ["a"] and best("median_err_m") == ["a"] and best("n_locked") == ["b"]
    assert [r.m for r in df.where("model = 'a'").agg(metrics.upper_median(F.col("err_m")).alias("m")).collect()] == [3.0]


def test_geometry(spark):
    df = spark.range(1).select(F.lit(43.5).alias("lat"), F.lit(-5.6).alias("lon"))
    x, y = geo.to_mercator(F.col("lon"), F.col("lat"))
    lon, lat = geo.from_mercator(x, y)
    r = df.select(lon.alias("lon"), lat.alias("lat"), *[geo.human_bytes(F.lit(float(n))).alias(f"b{n}") for n in (0, 1536)]).first()
    assert abs(r.lon + 5.6) < 1e-9 and abs(r.lat - 43.5) < 1e-9 and (r.b0, r.b1536) == ("0.0 B", "1.5 KB")


def test_search_grid_and_gates(spark):
    prior = spark.createDataFrame([(1, 43.5, -5.6)], "scenario long, prior_lat double, prior_lon double")
    count = lambda r, s: search.grid_centres(prior, F.lit(float(r)), F.lit(float(s))).count()
    assert (count(120, 60), count(0, 60), count(60, 120), count(60, 100), count(60, 0)) == (25, 1, 1, 1, 1)
    centre = search.grid_centres(prior, F.lit(120.0), F.lit(60.0)).where("centre_idx = 12").first()
    assert (centre.lat, centre.lon) == (43.5, -5.6)
    cands = [(1, 0, 0.0, 0.0, 200, True), (1, 1, 30.0, 0.0, 190, True), (1, 2, 200.0, 0.0, 170, True), (2, 0, 0.0, 0.0, 19, True), (3, 0, 0.0, 0.0, 90, False), (4, 0, 0.0, 0.0, 50, True), (4, 1, 0.0, 200.0, 50, True), (5, 0, 0.0, 0.0, 30, True), (5, 1, 0.0, 300.0, 0, True)]
    df = spark.createDataFrame(cands, "frame long, scan_idx long, x_m double, y_m double, n_inliers long, has_pose boolean")
    got = {r.frame: r for r in search.lock_gate(df, F.lit(90.0), 20, 1.1, "frame").collect()}
    assert [got[i].locked for i in range(1, 6)] == [True, False, False, False, True]
    assert got[1].rival_inliers == 170 and got[4].scan_idx == 0 and got[5].margin_ratio == float("inf")
    assert search.lock_gate(df, F.lit(90.0), 20, 1.0, "frame").where("frame = 4").first().locked


def test_nearest_fix(spark):
    fixes = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 5, 5.0, 0.0), (1, 9, 9.0, 0.0)], "k long, frame long, lat double, lon double")
    probes = spark.createDataFrame([(1, 7), (1, -3), (1, 100), (1, 5), (2, 1)], "k long, frame long")
    got = {(r.k, r.frame): r.fix and r.fix.frame for r in asof.nearest(probes, fixes, "k").collect()}
    assert got == {(1, 7): 5, (1, -3): 0, (1, 100): 9, (1, 5): 5, (2, 1): None}


def test_frame_specs(spark):
    df = spark.createDataFrame([("3", 101), ("5", 3), ("1", 9), ("9, 2,2", 10), ("12,3", 10), ("x", 10)], "spec string, n long")
    got = [r.f for r in df.select(frames.parse_frames(F.col("spec"), F.col("n")).alias("f")).collect()]
    assert got == [[0, 50, 100], [0, 1, 2], [0], [2, 9], None, None]


def test_ingest(spark):
    rows = spark.createDataFrame([(1, i, i // 5) for i in range(20)], "track long, idx long, shard long")
    none, some = rows.select("track", "shard").distinct().where("false"), rows.select("track", "shard").distinct().where("shard <> 2")
    assert frames.ingest_plan(rows, none, None, "track").groupBy("action").count().collect()[0]["count"] == 20
    again = frames.ingest_plan(rows, some, 0, "track")
    assert {r.action: r["count"] for r in again.groupBy("action").count().collect()} == {"write": 5, "skip": 15}
    capped = frames.shard_states(frames.ingest_plan(rows, none, 7, "track"), rows, "track").collect()
    assert {(r.shard, r.status, r.n_written) for r in capped} == {(0, "complete", 5), (1, "partial", 2)}
    manifest = spark.createDataFrame([(0, "complete", "a", 3, "x"), (0, "complete", "b", 2, "x"), (1, "partial", "c", 2, "x")], "shard long, status string, filename string, bytes long, sha1 string")
    files = spark.createDataFrame([("b", bytearray(b"\xff\xd8"))], "filename string, content binary")
    assert {r.filename: r.problem for r in frames.verify(manifest, files).collect()} == {"a": "missing", "b": "sha1", "c": "missing"}
    assert {r.shard: r.new_status for r in frames.verified_shards(frames.verify(manifest, files)).collect()} == {0: "partial", 1: "partial"}
    m = spark.createDataFrame([(1, "v", 5)], "k long, name string, size long")
    assert frames.mismatches(m, spark.createDataFrame([(1, "v", 6)], "k long, name string, size long"), "k", ["name", "size"]).first().reasons == ["size"]


def test_telemetry(spark):
    grouped = {f"Doc{n}:GPSLatitude": str(40 + n) for n in (10, 2, 1, 4)} | {f"Doc{n}:GPSLongitude": "-5" for n in (10, 2, 1, 4)} | {"Doc3:GPSLatitude": "0", "Doc3:GPSLongitude": "0", "Doc1:SampleTime": "1.234 s", "Other": "x"}
    flat = [{"SourceFile": "v"}, {"GPSLatitude": "1", "GPSLongitude": "1"}, {"GPSLatitude": "1", "GPSLongitude": "1"}, {"GPSLatitude": "0", "GPSLongitude": "0"}, {"GPSLatitude": "1", "GPSLongitude": "2"}]
    df = spark.createDataFrame([(1, json.dumps([grouped])), (2, json.dumps(flat))], "track long, json string")
    rows = telemetry.fixes(df).where("valid").collect()
    assert sorted(r.frame for r in rows if r.track == 1) == [0, 1, 3, 9] and sorted(r.frame for r in rows if r.track == 2) == [0, 1, 3]
    assert next(r for r in rows if r.track == 1 and r.frame == 0).t_s == 1.234


def test_csv_round_trip(spark, tmp_path):
    df = _scores(spark, [("a", 0, 0.1 + 0.2, True), ("a", 1, None, False)]).drop("scenario", "model").withColumn("yaw_deg", F.lit(None).cast("double")).select(*[c.split(" ")[0] for c in tables.SCORES.split(", ")])
    tables.write_scores(df, str(tmp_path / "s"))
    assert sorted(map(tuple, tables.read_scores(spark, str(tmp_path / "s")).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    (tmp_path / "d.csv").write_text("frame,hops_from_anchor,anchor_frame,err_m,est_lat,est_lon,gt_lat,gt_lon\n20,1,0,2.0,1,1,1,1\n0.0,,0,,1,1,1,1\n10,2,0,1,1,1,1,1\n")
    drift = tables.read_drift(spark, str(tmp_path / "d.csv")).collect()
    assert [r.frame for r in drift] == [0, 10, 20] and drift[0].hops_from_anchor is None and drift[0].err_m is None
    manifest = {"video": {}, "shards": {s: {"status": "complete", "frames": [{"index": int(s) * 5, "t_ms": 1, "blur_score": 1.0, "filename": f"f{s}", "bytes": 1, "sha1": "x"}]} for s in ("10", "2", "0")}, "completed": True}
    (tmp_path / "manifest.json").write_text(json.dumps(manifest, indent=1))
    assert [r.shard for r in tables.manifest_frames(spark, str(tmp_path / "manifest.json")).collect()] == [0, 2, 10]
    (tmp_path / "bench.json").write_text(json.dumps({"c": {"frames": {"7": {"err_m": None, "n_inliers": 3, "locked": False}}, "mean_err_m": 1.0}}))
    assert [tuple(r) for r in tables.bench_frames(spark, str(tmp_path / "bench.json")).collect()] == [("c", "7", None, 3, False)]


def test_benchmark_regions(spark):
    images = spark.createDataFrame([("r1", "d/b.JPG", True), ("r1", "d/a.jpg", False), ("r1", "d/c.jpg", True)], "region string, path string, readable boolean")
    truth = spark.createDataFrame([("B.png", "1", "2"), ("b.jpg", "3", "4"), ("c.jpg", "", "4")], "image string, latitude string, longitude string")
    got = {r.path: (r.frame, r.gt_lat) for r in benchmark.region_samples(images, truth.coalesce(1)).collect()}
    assert got == {"d/b.JPG": (1, 3.0), "d/c.jpg": (2, None)}
    ranges = spark.createDataFrame([(0, "satellite03.tif", 2.0, 1.0, 1.0, 2.0), (1, "other03.tif", 9.0, 9.0, 8.0, 8.0)], "o long, mapname string, lat_a double, lon_a double, lat_b double, lon_b double")
    regions = spark.createDataFrame([("03", "m/satellite03.tif"), ("x03", "m/z.tif"), ("none", None)], "region string, map_path string")
    got = {r.region: (r.level, r.box and r.box.min_lat) for r in benchmark.region_maps(regions, ranges, "o").collect()}
    assert got == {"03": (0, 1.0), "x03": (3, 1.0), "none": (None, None)}


def test_export(spark):
    df = spark.createDataFrame([(1, 2, 1.0, 2.0, float("nan"), 2.0), (1, 1, 1.5, -2.25, 3.0, 4.0), (2, 1, None, None, 3.0, 4.0)], "k long, frame long, est_lat double, est_lon double, gt_lat double, gt_lon double")
    got = {r.k: json.loads(r.geojson)["features"] for r in export.geojson(df, "k").collect()}
    assert got[1][0]["geometry"] == {"type": "LineString", "coordinates": [[-2.25, 1.5], [2.0, 1.0]]} and got[1][1]["geometry"] == {"type": "Point", "coordinates": [4.0, 3.0]}
    assert len(got[2]) == 1
    kml = {r.k: r for r in export.kml(df, "k").collect()}
    assert kml[1].estimated == "-2.25000000,1.50000000,0 2.00000000,1.00000000,0" and "estimated" not in kml[2].kml


def test_camera(spark):
    one = spark.range(1)
    tags = lambda **t: {n: F.lit(t.get(n)).cast("string") for n in ("CalibratedFocalLength", "FocalLength", "SensorWidth", "FocalPlaneXResolution", "FocalPlaneResolutionUnit", "FocalLengthIn35mmFormat", "ImageWidth")}
    focal = lambda **t: one.select(camera.focal_px(tags(**t)).alias("f")).first().f
    assert focal(CalibratedFocalLength="3713", FocalLength="1", ImageWidth="9") == 3713
    assert focal(FocalLength="24", SensorWidth="36", ImageWidth="6000") == 4000
    assert focal(FocalLength="12", FocalPlaneXResolution="250", FocalPlaneResolutionUnit="4", ImageWidth="6000") == 3000
    assert focal(FocalLengthIn35mmFormat="24", ImageWidth="5472") == 3648 and focal(FocalLength="24") is None
    r = one.select(*[c.alias(n) for n, c in camera.search_for(F.lit(50.0), F.lit(70.0)).items()]).first()
    assert 50 < r.radius_m < 100 and r.scale_0 < r.scale_3
    assert one.select(camera.search_for(F.lit(0.0), F.lit(70.0))["radius_m"].alias("r")).first().r == 120


def test_runner(spark):
    scenarios = spark.createDataFrame([("s", "field", 43.5, -5.6, None, 70.0)], "scenario string, terrain string, prior_lat double, prior_lon double, altitude_m double, hfov_deg double")
    samples = spark.createDataFrame([("s", 0, None, 43.5, -5.6), ("s", 1, 1.5, None, None)], "scenario string, frame long, t_s double, gt_lat double, gt_lon double")
    good = lambda cells: cells.withColumns({"n_inliers": F.when(F.col("centre_idx") == 12, 80).otherwise(5).cast("long"), "has_pose": F.lit(True), "est_lat": F.col("lat"), "est_lon": F.col("lon")})
    bad = lambda cells: good(cells).withColumn("n_inliers", F.lit(3).cast("long"))
    scores = runner.run(runner.Dataset("d", scenarios, samples), {"bad": bad, "good": good})
    by, best, overall = runner.results(scores)
    assert {r.model: (r.n, r.n_locked) for r in by.collect()} == {"good": (2, 1), "bad": (2, 0)}
    assert best.first().model == "good" and overall.first().model == "good"
    assert {r.frame: r.t_s for r in scores.where("model = 'good'").collect()} == {0: 0.0, 1: 1.5}
    with pytest.raises(ValueError):
        runner.run(runner.Dataset("d", scenarios.withColumn("prior_lat", F.lit(None).cast("double")), samples), {"good": good})
    with pytest.raises(NotImplementedError):
        runner.DATASETS.get("SatLoc")()
    assert runner.Config({"a": {"b": 1}}).get("a.b") == 1 and runner.Config().get("a.b", 2) == 2
