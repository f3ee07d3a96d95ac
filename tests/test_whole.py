"""Queries over every row of their tables."""

import json

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyfix import plans
from skyfix.operators import matchers, search


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """The folder of a table of 600 events of 60 users."""
    folder = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(i, i % 60, "view", i % 50 / 2) for i in range(600)], "event_id long, user_id long, event_type string, value double").write.parquet(f"{folder}/events.parquet")
    return folder


def test_every_prior_has_its_cells(spark, events):
    want = []
    for i in range(600):
        radius, step = i % 5 * 60, 30 + i % 3 * 30
        cells = (2 * (0 if radius == 0 or step >= 2 * radius else radius // step) + 1) ** 2
        want += [(i, p, 4 * cells, 4 * cells - 1, 380.0 * cells) for p in ("esri", "pnoa")]
    read = lambda name: sorted(map(tuple, plans.QUERIES[name](spark, events).collect()))
    assert read("candidate_grid_all") == want
    assert read("candidate_grid") == want


def test_every_event_is_matched_and_measured(spark, events):
    got = plans.QUERIES["estimate_homography"](spark, events).collect()
    assert sorted((r.frame, r.n_matches) for r in got) == [(u, 10) for u in range(60)]
    assert sorted(r.event_id for r in plans.QUERIES["focus_measure"](spark, events).collect()) == list(range(600))


def test_tracks_have_every_point(spark, events):
    frames = {s: [f for f in range(600) if f % 60 % 10 == s] for s in range(10)}
    truth = {s: [(-5.62429 + f % 997 * 1e-6, 43.521955 + f % 1009 * 1e-6) for f in own] for s, own in frames.items()}
    for r in plans.QUERIES["geojson_track"](spark, events).collect():
        estimated, known = (x["geometry"]["coordinates"] for x in json.loads(r.geojson)["features"])
        assert len(estimated) == sum(f % 11 != 0 for f in frames[r.scenario]) and known == [pytest.approx(p, abs=1e-12) for p in truth[r.scenario]]
        del frames[r.scenario]
    assert not frames
    assert sorted(plans.QUERIES["kml_track"](spark, events).collect()) == sorted(plans.QUERIES["kml_track_all"](spark, events).collect())
    got = {r.scenario: r for r in plans.QUERIES["kml_track_all"](spark, events).collect()}
    assert {s: r.ground_truth for s, r in got.items()} == {s: " ".join(f"{x:.8f},{y:.8f},0" for x, y in points) for s, points in truth.items()}
    assert sum(len(r.estimated.split()) for r in got.values()) == sum(f % 11 != 0 for f in range(600))


def test_sizes_of_ids_whose_cube_is_no_long(spark, tmp_path):
    spark.createDataFrame([(3,), (5_999_999,)], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    assert {r.event_id: r.size for r in plans.QUERIES["human_bytes"](spark, str(tmp_path)).collect()} == {3: "2.6 KB", 5_999_999: "18609104.9 PB"}  # 2.1e22 bytes


def test_ties_of_a_search_are_not_left_to_noise(spark, tmp_path):
    """64.03 m seen at an angle whose tangent makes 95 m: 85 % of it are a tie, 80.75."""
    spark.createDataFrame([(200896, 64.03), (1721296, 64.03)], "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = plans.QUERIES["scene_search"](spark, str(tmp_path)).orderBy("event_id").collect()
    assert [tuple(r) for r in got] == con.execute(plans.ORACLES["scene_search"] + " ORDER BY event_id").fetchall() and got[0].scale_1 == 80.8


def test_cells_are_chosen_without_sorting_them(spark):
    rows = [(1, 5, 3, True), (1, 5, 2, True), (1, (1 << 62) + 1, 9, True), (1, 1 << 62, 1, True), (2, None, 4, True), (3, 0, 7, True), (3, 9, 6, False)]
    best = search.best_candidate(spark.createDataFrame(rows, "k long, n_inliers long, scan_idx long, has_pose boolean"), "k")
    assert sorted((r.k, r.scan_idx) for r in best.collect()) == [(1, 9), (2, 4), (3, 7)]
    assert "Sort" not in best._jdf.queryExecution().executedPlan().toString()


def test_rounding_of_spans_is_done_once_a_lock(spark):
    locks = spark.createDataFrame([(1, True, 43.0, -5.0, 100.0)], "frame long, locked boolean, lat double, lon double, span_m double")
    plan = search.fine_cells(locks, "frame").groupBy("frame").agg(F.sum("span_m"))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first = min(i for i, line in enumerate(plan) if "explode" in line)
    last = max(i for i, line in enumerate(plan) if "explode" in line)
    assert not any("bround" in line for line in plan[first : last + 1]) and any("bround" in line for line in plan[last + 1 :])


def test_pictures_of_one_size_are_measured_together(spark):
    rng = np.random.default_rng(5)
    pictures = [rng.integers(0, 256, s, dtype=np.uint8) for s in ((16, 16), (5, 7), (16, 16), (1, 9), (1100, 20))]
    got = spark.createDataFrame([(i, p.tobytes(), p.shape[1], p.shape[0]) for i, p in enumerate(pictures)], "i int, d binary, w int, h int").coalesce(1)
    got = got.select("i", matchers.focus_measure("d", "w", "h").alias("f")).orderBy("i").collect()
    assert [r.f for r in got] == pytest.approx([matchers.focus(p) for p in pictures], rel=1e-12)
    calls = []
    whole = matchers.focuses
    try:
        matchers.focuses = lambda images: calls.append(len(images)) or whole(images)
        matchers.focus_measure.func(pd.Series([p.tobytes() for p in pictures]), pd.Series([p.shape[1] for p in pictures]), pd.Series([p.shape[0] for p in pictures]))
    finally:
        matchers.focuses = whole
    assert sorted(calls) == [1, 1, 1, 2]


def test_foot_points_are_planned_in_seconds(spark, events):
    """The numbers of expressions in the plan: homographies that are copied into each other had it grow to over 70,000 characters."""
    plan = plans.QUERIES["nadir_pose"](spark, events)._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 60_000
