"""A whole video, and requests for tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_shapes import TILE

from skyfix.operators import features
from skyfix.plans import video
from skyfix.sources import benchmark


def test_whole_video(spark):
    ref = "array(0.5e0, 0e0, 900e0, 0e0, 0.5e0, 900e0, 0e0, 0e0, 1e0)"
    located = spark.sql(f"select 1L as k, pos, pos / 2e0 as t_s, model, locked, n, 43.0e0 as est_lat, -5.0e0 as est_lon, {ref} as h_to_ref, {TILE} as tile from values (2L, 'a', true, 30L), (2L, 'b', true, 50L), (2L, 'c', false, 90L), (9L, 'a', true, 5L) as t(pos, model, locked, n)").withColumnRenamed("n", "n_inliers")
    h = [1.0, 0.0, 4.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    links = spark.createDataFrame([(1, i, h if i != 5 else None, 40 if i != 4 else 3) for i in range(9)], "k long, pos long, h array<double>, n_inliers long")
    truth = spark.createDataFrame([(1, 0, 43.0, -5.0)], "k long, frame long, lat double, lon double")
    flight = video.whole_video(located, links, truth, "k", F.lit(400.0), F.lit(400.0))
    assert [(r.pos, r.model) for r in flight.anchors.collect()] == [(2, "b")]
    assert [(r.pos, r.hops) for r in flight.poses.orderBy("pos").collect()] == [(0, 2), (1, 1), (2, 0), (3, 1), (4, 2)]  # link 4 isn't trusted, and 5 is broken
    assert flight.fused.count() == 5
    told = video.report(flight, "k").first()
    assert (told.n, told.n_anchors, told.winners) == (5, 1, {"b": 1}) and told.median_err_m > 0


def test_requests():
    box = benchmark.map_request(0.0, 0.0, 100.0, 640)["bbox"]
    asked = benchmark.tile_request(0.0, 0.0, 100.0, 640, "layer")
    assert [float(x) for x in box.split(",")] == [-50, -50, 50, 50] and all(len(x.split(".")[1]) == 6 for x in box.split(","))
    assert (asked["BBOX"], asked["CRS"], asked["WIDTH"], asked["REQUEST"], asked["LAYERS"], asked["FORMAT"]) == (box, "EPSG:3857", "640", "GetMap", "layer", "image/png")


@pytest.mark.parametrize("n", [2, 3, 40])
def test_ratio_test_finds_the_nearest(spark, n):
    r = np.random.default_rng(n)
    q, t = r.normal(size=(30, 8)), r.normal(size=(n, 8))
    q[:10] = t[r.integers(0, n, 10)] + r.normal(size=(10, 8)) * 0.01
    df = lambda x: spark.createDataFrame([(i, [float(v) for v in row], 1) for i, row in enumerate(x)], "id long, vector array<double>, label long")
    got = sorted((x.query_id, x.train_id, round(x.distance, 9)) for x in features.ratio_test(df(q), df(t), "label", 0.8, 7).collect())
    want = []
    for i, row in enumerate(q):
        d = np.sqrt(((row - t) ** 2).sum(axis=1))
        a, b = np.argsort(d)[:2]
        if d[a] < 0.8 * d[b]:
            want.append((i, int(a), round(float(d[a]), 9)))
    assert got == want
