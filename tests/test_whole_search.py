"""Pixels to places: frames cut out of a map by a planted camera are searched for and found."""

import math

import numpy as np
from pyspark.sql import functions as F
from test_features import picture, warped

from skyfix.operators import features, localize, matchers

LAT, LON = 43.5, -5.6


def _merc(lat, lon):
    return math.radians(lon) * 6378137, 6378137 * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))


def test_frames_are_found_on_the_map(spark):
    x, y = _merc(LAT, LON)
    whole, metres = picture(np.random.default_rng(11), 700), 0.5
    box = (x - 175, y - 175, x + 175, y + 175)
    tile = "struct<minx: double, miny: double, maxx: double, maxy: double, width: int, height: int>"
    image = "struct<data: binary, height: int, width: int>"
    pixels = lambda a: (bytes(a.tobytes()), a.shape[0], a.shape[1])
    maps = spark.createDataFrame([((*box, 700, 700), pixels(whole))], f"map_tile {tile}, map_image {image}")
    w = h = 160
    rows, truth = [], {}
    for frame, (px, py, deg) in enumerate([(330, 370, 20.0), (410, 300, -50.0)]):
        c, s = math.cos(math.radians(deg)), math.sin(math.radians(deg))
        m = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1.0]])
        m[:2, 2] = [px, py] - m[:2, :2] @ [w / 2, h / 2]
        truth[frame] = (box[0] + px * metres, box[3] - py * metres)
        lat = math.degrees(2 * math.atan(math.exp(truth[frame][1] / 6378137)) - math.pi / 2)
        rows.append(("s", frame, pixels(warped(whole, m, w, h)), LAT, LON, lat, math.degrees(truth[frame][0] / 6378137)))
    rows.append(("s", 2, pixels(np.full((h, w), 90, np.uint8)), LAT, LON, LAT, LON))
    frames = spark.createDataFrame(rows, f"scenario string, frame int, frame_image {image}, prior_lat double, prior_lon double, gt_lat double, gt_lon double")
    how = localize.Search(radius_m=60.0, step_m=60.0, scales_m=(130.0,), least=12)
    got = {r.frame: r for r in localize.validate(frames, ["scenario", "frame"], lambda cells: localize.cropped(cells, maps, 240), lambda: features.FeatureMatcher(most=800), how).collect()}
    assert len(got) == 3 and not got[2].locked and got[2].est_lat is None
    for f in (0, 1):
        assert got[f].locked and got[f].err_m < 3 and got[f].n_inliers >= 12, got[f]
    assert {got[0]["pass"], got[1]["pass"]} <= {"coarse", "fine"}


def test_cells_with_intrinsics_are_moved_under_the_camera(spark):
    class Tilted(matchers.Matcher):
        def match(self, frame, tile):
            src = np.zeros((30, 2))
            return matchers.Match(src, src, np.array([[1.1, 0.05, 3.0], [0.02, 0.9, 5.0], [1e-4, 2e-3, 1.0]]), np.ones(30, bool))

    image = lambda: F.struct(F.lit(bytearray([1] * 64)).alias("data"), F.lit(8).alias("height"), F.lit(8).alias("width"))
    tile = F.struct(F.lit(100).alias("width"), F.lit(100).alias("height"), F.lit(-50.0).alias("minx"), F.lit(-50.0).alias("miny"), F.lit(50.0).alias("maxx"), F.lit(50.0).alias("maxy"))
    cells = spark.range(2).select(F.col("id").alias("scan_idx"), image().alias("frame_image"), image().alias("tile_image"), tile.alias("tile"), F.when(F.col("id") == 0, F.array(*[F.lit(v) for v in (9.0, 0.0, 4.0, 0.0, 9.0, 4.0, 0.0, 0.0, 1.0)])).alias("intrinsics"))
    got = {r.scan_idx: r for r in localize.search_cells(cells, Tilted).collect()}
    assert got[0].tilt_corrected and got[0].tilt_deg > 0.1 and got[0].altitude_m > 0 and not got[1].tilt_corrected and got[1].tilt_deg is None
    assert abs(got[0].est_lat - got[1].est_lat) > 1e-9
    plain = {r.scan_idx: r for r in localize.search_cells(cells.drop("intrinsics"), Tilted).collect()}
    assert plain[1].est_lat == got[1].est_lat and "tilt_deg" not in plain[1]
