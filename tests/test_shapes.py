"""Poses of tilted cameras, intrinsics, shape of tracks, fine passes and sources."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_tracks import _kalman

from skyfix.functions import camera, geo
from skyfix.operators import fusion, matchers, metrics, search, trajectory

TILE = "named_struct('width', 2000, 'height', 2000, 'minx', -626100e0, 'miny', 5395000e0, 'maxx', -625100e0, 'maxy', 5396000e0)"


def _camera(tilt, yaw, alt):
    a = math.radians(tilt)
    down = np.array([math.sin(a) * math.sin(yaw), math.sin(a) * math.cos(yaw), -math.cos(a)])
    right = np.array([math.cos(yaw), -math.sin(yaw), 0.0])
    rot = np.stack([right, np.cross(down, right), down])
    centre = np.array([-down[0] * alt / math.cos(a), -down[1] * alt / math.cos(a), alt])
    k = np.array([[900.0, 0, 640], [0, 900, 360], [0, 0, 1]])
    return k, np.linalg.inv(k @ np.stack([rot[:, 0], rot[:, 1], -rot @ centre], axis=1)), centre


@pytest.mark.parametrize("tilt", [0, 5, 30, 74, 80])
def test_pose_moves_to_the_foot_point(spark, tilt):
    k, g, centre = _camera(tilt, 0.4, 90.0)
    g = g / g[2, 2]
    near = matchers.decompose_ground(g, k)
    row = spark.sql(f"select {TILE} as tile")
    lat = row.select(geo.from_mercator(*geo.pixel_to_mercator(F.lit(1000.0), F.lit(1000.0)))[1].alias("v")).first().v
    shrink, per = math.cos(math.radians(lat)), 0.5
    to_tile = np.array([[1 / (shrink * per), 0, 1000], [0, -1 / (shrink * per), 1000], [0, 0, 1]])
    h = to_tile @ g
    flat = lambda m: F.array(*[F.lit(float(x)) for x in (m / m[2, 2]).ravel()])
    got = row.select(*[c.alias(n) for n, c in camera.nadir_pose(flat(h), F.lit(1280.0), F.lit(720.0), flat(k)).items()]).first()
    plain = row.select(*[c.alias(n) for n, c in camera.pose(flat(h), F.lit(1280.0), F.lit(720.0)).items()]).first()
    assert got.tilt_corrected == (tilt <= 75) == (near is not None) and abs(got.yaw_deg - plain.yaw_deg) < 1e-9
    if tilt > 75:
        assert (got.lat, got.lon, got.tilt_deg) == (plain.lat, plain.lon, None)
        return
    assert np.allclose(near, (*centre[:2], 90.0, tilt), atol=1e-4) and abs(got.tilt_deg - tilt) < 1e-3 and abs(got.altitude_m - 90) < 1e-3
    north, east = (got.lat - plain.lat) * math.pi / 180 * 6378137, (got.lon - plain.lon) * math.pi / 180 * 6378137 * shrink
    assert np.allclose((east, north), centre[:2], atol=0.02 + 1e-4 * abs(centre[:2]).max())
    none = row.select(camera.nadir_pose(flat(h), F.lit(1280.0), F.lit(720.0), F.lit(None).cast("array<double>"))["tilt_corrected"].alias("t")).first()
    assert none.t is False


def test_singular_matrices_have_no_pose(spark):
    flat = lambda m: F.array(*[F.lit(float(x)) for x in m])
    one = [1, 0, 0, 0, 1, 0, 0, 0, 1]
    assert spark.range(1).select(camera.ground_pose(flat([1, 2, 3, 2, 4, 6, 0, 0, 1]), flat(one)).alias("p"), camera.ground_pose(F.lit(None).cast("array<double>"), flat(one)).alias("q")).first() == (None, None)


def test_intrinsics(spark):
    tags = {t: F.lit(v) for t, v in {"CalibratedFocalLength": "3000", "CalibratedOpticalCenterX": "10", "CalibratedOpticalCenterY": "20.5", "FOV": "83.9 deg (0.50 m)", "FocalLength": None, "SensorWidth": None, "FocalPlaneXResolution": None, "FocalPlaneResolutionUnit": None, "FocalLengthIn35mmFormat": None, "ExifImageWidth": "4000"}.items()}
    got = spark.range(1).select(camera.tag_intrinsics(tags).alias("i"), camera.image_width(tags).alias("w")).first()
    assert (got.i.focal_px, tuple(got.i.principal_point), got.i.hfov_deg, got.w) == (3000.0, (10.0, 20.5), 83.9, 4000.0)
    assert spark.range(1).select(camera.config_intrinsics({"focal_px": 900}).alias("i")).first().i == (900.0, None, None)
    with pytest.raises(ValueError):
        camera.config_intrinsics({})
    sizes = spark.range(1).select(*[c.alias(n) for n, c in zip("whf", camera.long_edge(F.lit(3840), F.lit(2160), 960))]).first()
    assert tuple(sizes) == (960, 540, 0.25)


def test_focus_reduces_to_the_exact_edge():
    grey = np.tile(np.arange(1280, dtype=float) % 4, (8, 1))
    want = np.zeros((8, 960))
    for j in range(960):
        a, b = j * 4 / 3, (j + 1) * 4 / 3
        want[:, j] = sum(grey[0, i] * max(0, min(b, i + 1) - max(a, i)) for i in range(int(a), min(1280, math.ceil(b)))) / (b - a)
    want = np.repeat(want[:1], 6, axis=0)
    p = np.pad(want, 1, mode="reflect")
    assert abs(matchers.focus(grey) - (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * want).var()) < 1e-9


def test_missing_times_and_frames_out_of_order(spark):
    rows = [(1, 3, 3.0, 30.0, 0.0), (1, 0, 0.0, 0.0, 0.0), (1, 2, None, 10.0, 0.0), (1, 1, 1.0, 10.0, 0.0)]
    got = fusion.fuse_tracks(spark.createDataFrame(rows, "k long, frame long, t_s double, pos_e double, pos_n double"), "k").orderBy("frame").collect()
    want, _, _ = _kalman([(t, e, 0.0, None, None) for t, e in ((0.0, 0.0), (1.0, 10.0), (1.0, 10.0), (3.0, 30.0))], fusion.Tuning(), True)
    assert [r.frame for r in got] == [0, 1, 2, 3] and np.allclose([r.east for r in got], want[:, 0]) and got[2].t_s is None
    scores = spark.createDataFrame([(1, f, float(f), 43.5, -5.6 + f * 1e-5, True) for f in range(4)], "k long, frame long, t_s double, est_lat double, est_lon double, locked boolean")
    a, b = (fusion.fuse_scores(scores, "k", ref=r).orderBy("frame").collect() for r in (None, (43.4, -5.5)))
    assert all(abs(x.lat - y.lat) < 1e-6 and abs(x.lon - y.lon) < 1e-6 for x, y in zip(a, b))


def test_shape_of_locked_frames(spark):
    rows = [("s", "m", f, 43.5 + f * 1e-4, -5.6, 43.5 + f * 1e-4 + 1e-5, -5.6, True, 1.0 + f, 1.0) for f in range(5)] + [("s", "n", 0, 43.5, -5.6, 43.5, -5.6, True, 0.0, 1.0), ("s", "o", 0, 43.5, -5.6, None, None, False, None, 1.0)]
    df = spark.createDataFrame(rows, "scenario string, model string, frame long, gt_lat double, gt_lon double, est_lat double, est_lon double, locked boolean, err_m double, runtime_s double")
    got = {r.model: r for r in metrics.shaped_metrics(df, "scenario", "model").collect()}
    assert abs(got["m"].ate_raw_m - 1.11) < 0.02 and got["m"].ate_aligned_m < 1e-3 and abs(got["m"].length_ratio - 1) < 1e-6
    assert got["n"].ate_aligned_m is None and got["o"].n_locked == 0
    assert metrics.select_best(metrics.shaped_metrics(df, "scenario", "model"), "ate_aligned_m", "scenario").first().model == "m"
    track = spark.createDataFrame([("s", 0, 43.5, -5.6), ("s", 9, 43.6, -5.6)], "scenario string, frame long, lat double, lon double")
    near = metrics.validated(df.where("model = 'm'").select("scenario", "frame", "est_lat", "est_lon"), track, "scenario").collect()
    assert all(r.gt_lat == 43.5 for r in near) and abs(min(r.err_m for r in near) - 1.11) < 0.02


def test_fine_pass_and_sources(spark):
    best = spark.createDataFrame([(1, True, 43.5, -5.6, 100.0), (2, False, 43.5, -5.6, 100.0)], "frame long, locked boolean, lat double, lon double, span_m double")
    cells = search.fine_cells(best, "frame").collect()
    assert len(cells) == 25 * 5 and {r.frame for r in cells} == {1} and any((r.lat, r.lon, r.span_m) == (43.5, -5.6, 100.0) for r in cells) and sorted(r.scan_idx for r in cells) == list(range(125))
    cands = spark.createDataFrame([(1, 0, 0.0, 0.0, 30, True), (1, 1, 500.0, 0.0, 0, True), (2, 0, 0.0, 0.0, 5, False)], "frame long, scan_idx long, x_m double, y_m double, n_inliers long, has_pose boolean")
    got = {r.frame: (r.margin_ratio, r.locked, r.n_inliers) for r in search.lock_gate(cands, F.lit(90.0), 20, 1.3, "frame").collect()}
    assert got == {1: (math.inf, True, 30), 2: (None, False, None)}
    rows = spark.createDataFrame([(1, "a", True, 9, 1.0, 2.0), (1, "b", True, 9, 1.0, 1.0), (2, "a", False, 50, 1.0, None)], "frame long, source string, locked boolean, n_inliers long, est_lat double, err_m double")
    chosen = search.multisource(rows, "frame", "source")
    assert {r.frame: (r.source, r.locked) for r in chosen.collect()} == {1: ("a", True), 2: (None, False)}
    s = search.source_summary(chosen.withColumn("all", F.lit(1)), "source", "all").first()
    assert (s.n, s.n_locked, s.chosen) == (2, 1, {"a": 1})


def test_chained_poses(spark):
    h = [1.0, 0.0, 4.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    nodes = spark.createDataFrame([(1, i, i == 2, False, 20 + i) for i in range(5)], "k long, pos long, is_anchor boolean, is_break boolean, n_inliers long")
    links = spark.createDataFrame([(1, i, h) for i in range(4)], "k long, pos long, h array<double>")
    anchors = spark.sql(f"select 1L as k, 2L as anchor, array(0.5e0, 0e0, 900e0, 0e0, 0.5e0, 900e0, 0e0, 0e0, 1e0) as h_to_ref, {TILE} as tile")
    got = trajectory.chain_poses(links, trajectory.nearest_anchor(nodes, "k"), anchors, "k", F.lit(400.0), F.lit(400.0)).orderBy("pos").collect()
    assert [(r.pos, r.hops, r.n_inliers) for r in got] == [(0, 2, 20), (1, 1, 21), (2, 0, 0), (3, 1, 22), (4, 2, 22)]
    step = np.diff([r.lon for r in got])
    assert np.allclose(step, step[0]) and step[0] < 0 and all(abs(r.yaw_deg % 360) < 1e-6 for r in got)
