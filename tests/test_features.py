"""Corners, descriptors, two nearest and robust homographies."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyfix.operators import features, localize, matchers


def picture(r, n=400):
    """Blobs of many sizes."""
    a = np.zeros((n, n))
    for _ in range(350):
        y, x, s = r.integers(0, n), r.integers(0, n), r.integers(3, 25)
        a[max(0, y - s) : y + s, max(0, x - s * 2) : x + s] += r.normal() * 60
    return np.clip(128 + features.box(a, 1), 0, 255).astype(np.uint8)


def warped(tile, h, width, height):
    """What a camera sees whose pixels h maps into the tile."""
    xy = np.stack(np.meshgrid(np.arange(width), np.arange(height)), -1).reshape(-1, 2).astype(float)
    q = matchers.transfer(h, xy)
    x, y = np.clip(q[:, 0], 0, tile.shape[1] - 2), np.clip(q[:, 1], 0, tile.shape[0] - 2)
    i, j, fx, fy = y.astype(int), x.astype(int), x % 1, y % 1
    v = tile[i, j] * (1 - fx) * (1 - fy) + tile[i, j + 1] * fx * (1 - fy) + tile[i + 1, j] * (1 - fx) * fy + tile[i + 1, j + 1] * fx * fy
    return v.reshape(height, width).astype(np.uint8)


def turn(deg, scale, tx, ty):
    c, s = scale * np.cos(np.radians(deg)), scale * np.sin(np.radians(deg))
    return np.array([[c, -s, tx], [s, c, ty], [0, 0, 1.0]])


@pytest.mark.parametrize(("deg", "scale"), [(0, 1.0), (35, 1.0), (170, 0.8), (-80, 1.4)])
def test_a_planted_warp_is_recovered(deg, scale):
    tile = picture(np.random.default_rng(5))
    w = h = 200
    a = turn(deg, scale, 0, 0)
    a[:2, 2] = 200 - a[:2, :2] @ [w / 2, h / 2]
    m = matchers.get_matcher("classical").match(warped(tile, a, w, h), tile)
    corners = np.array([[20, 20], [w - 20, 20], [w - 20, h - 20], [20, h - 20]], float)
    assert m.n_inliers >= 20 and np.abs(matchers.transfer(m.homography, corners) - matchers.transfer(a, corners)).max() < 2.5


def test_flat_and_small_images_have_no_match():
    m = features.FeatureMatcher().match(np.full((200, 200), 9, np.uint8), picture(np.random.default_rng(1)))
    assert m.homography is None and m.n_inliers == 0
    assert len(features.describe(np.zeros((10, 10), np.uint8))) == 0


def test_pairs_of_images_as_a_job(spark):
    r = np.random.default_rng(6)
    tiles = [picture(r) for _ in range(2)]
    a = turn(25, 1.1, 120, 60)
    frame = warped(tiles[1], a, 180, 180)
    image = lambda x: (bytes(x.tobytes()), x.shape[0], x.shape[1])
    schema = "image string, pixels struct<data: binary, height: int, width: int>"
    images = spark.createDataFrame([("t0", image(tiles[0])), ("t1", image(tiles[1])), ("f", image(frame)), ("bad", (b"123", 40, 40)), ("none", None)], schema)
    table = features.feature_table(images, "image", image="pixels")
    pairs = spark.createDataFrame([(0, "f", "t0"), (1, "f", "t1"), (2, "bad", "t1")], "pair long, frame string, tile string")
    got = {x.pair: x for x in matchers.homographies(features.correspondences(table, pairs, "pair", "image", block=300), "pair").collect()}
    assert set(got) <= {0, 1} and (0 not in got or got[0].h is None)
    ends = np.array([[30, 30], [150, 150], [150, 30]], float)
    assert np.abs(matchers.transfer(np.array(got[1].h).reshape(3, 3), ends) - matchers.transfer(a, ends)).max() < 2.5
    # the same through the interface of a matcher, pair by pair
    row = spark.createDataFrame([(1, image(frame), image(tiles[1]))], "pair long, frame_image struct<data: binary, height: int, width: int>, tile_image struct<data: binary, height: int, width: int>")
    one = localize.match_pairs(row, features.FeatureMatcher).first()
    assert one.error is None and np.allclose(one.h, got[1].h, atol=0.05 * np.abs(got[1].h).max())


@pytest.mark.parametrize("metric", ["hamming", "euclidean"])
def test_two_nearest_over_blocks(spark, metric):
    r = np.random.default_rng(2)
    rows = []
    for pair, (nq, nt) in enumerate([(90, 210), (5, 1), (3, 0), (0, 4), (40, 2)]):
        for side, n in (("q", nq), ("t", nt)):
            for i in range(n):
                v = r.integers(0, 4, 16).astype(np.uint8)
                rows.append((pair, side, int(r.integers(0, 10) * 1000 + i), v))
    df = pd.DataFrame([(p, s, i, v.tobytes() if metric == "hamming" else v.astype(float).tolist()) for p, s, i, v in rows], columns=["pair", "side", "id", "vector"])
    sdf = spark.createDataFrame(df, "pair long, side string, id long, vector " + ("binary" if metric == "hamming" else "array<double>"))
    got = features.two_nearest(sdf.where("side = 'q'"), sdf.where("side = 't'"), "pair", metric, block=25)
    want = []
    for p, s, i, v in rows:
        if s == "q":
            d = sorted((float(np.bitwise_count(v ^ w).sum()) if metric == "hamming" else float(np.sqrt(((v.astype(float) - w) ** 2).sum())), j) for q, t, j, w in rows if (q, t) == (p, "t"))
            if len(d) > 1:
                want.append((p, i, d[0][1], d[0][0], d[1][0]))
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("share", [0.2, 0.4, 0.6, 0.7])
def test_outliers_and_noise(share):
    r = np.random.default_rng(int(share * 100))
    pairs, planted = [], []
    for _ in range(12):
        h = turn(r.uniform(-180, 180), r.uniform(0.5, 2), r.uniform(0, 300), r.uniform(0, 300))
        h[2, :2] = r.normal(size=2) * 1e-5
        n = int(r.integers(100, 300))
        src = r.random((n, 2)) * [1280, 720]
        dst = matchers.transfer(h, src) + r.normal(size=(n, 2)) * 0.5
        bad = r.random(n) < share
        dst[bad] = r.random((int(bad.sum()), 2)) * 1500 - 200
        pairs.append((src, dst))
        planted.append((h, bad))
    for (src, dst), (h, bad), (got, inside) in zip(pairs, planted, matchers.estimate_homographies(pairs)):
        assert got is not None and inside[~bad].mean() > 0.98 and inside[bad].mean() < 0.1
        errors = [np.sqrt(((matchers.transfer(m, src[~bad]) - matchers.transfer(h, src[~bad])) ** 2).sum(axis=1).mean()) for m in (got, matchers.direct_linear(src[~bad], dst[~bad]))]
        assert errors[0] < max(0.3, 1.5 * errors[1])  # about as near as least squares over the right ones


def test_a_pair_gives_the_same_in_any_company(spark):
    r = np.random.default_rng(3)
    rows = []
    for k in range(20):
        h = turn(10 * k, 1, 50, 80)
        for i in range(int(r.integers(2, 80))):
            s = r.random(2) * 500
            d = matchers.transfer(h, s[None])[0] if r.random() < 0.6 else r.random(2) * 500
            rows.append((k, i, *map(float, s), *map(float, d)))
    df = spark.createDataFrame(rows, "k long, ordinal long, sx double, sy double, dx double, dy double")
    a, b = (sorted(map(str, matchers.homographies(df.repartition(n), "k").withColumn("h", F.transform("h", lambda x: F.round(x, 9))).collect())) for n in (1, 7))
    assert a == b and len(a) == 20


def test_degenerate_points():
    line = np.stack([np.arange(30.0), np.arange(30.0)], 1)
    h, inside = matchers.estimate_homography(line, line)
    assert h is None or np.isfinite(h).all()
    assert matchers.estimate_homography(line[:3], line[:3]) == (None, None)
    same = np.ones((20, 2))
    assert matchers.estimate_homography(same, same)[0] is None
    some = np.random.default_rng(1).random((40, 2)) * 100
    gone = some.copy()
    gone[3] = np.nan
    h, inside = matchers.estimate_homography(some, gone)
    assert np.allclose(h, np.eye(3), atol=1e-6) and inside.sum() == 39 and not inside[3]
