import numpy as np
from pyspark.sql import functions as F

from skyfix.operators import localize, metrics
from skyfix.operators.matchers import Match, Matcher
from skyfix.sources import reports


def _planted():
    class Planted(Matcher):
        """Reads the answer from the first pixel: 0 fails, 1 gives too few inliers, else a shift."""

        def match(self, frame, tile):
            v = int(frame[0, 0])
            if v == 0:
                raise ValueError("blank")
            src = np.zeros((40, 2))
            return Match(src, src, None if v == 1 else np.array([[1, 0, v], [0, 1, v], [0, 0, 1.0]]), np.arange(40) < (5 if v == 1 else 30))

    return Planted  # a local class goes to the workers by value


def _image(v):
    return F.struct(F.lit(bytearray([v] * 16)).alias("data"), F.lit(4).alias("height"), F.lit(4).alias("width"))


def test_cells_fail_one_by_one(spark):
    tile = F.struct(F.lit(100).alias("width"), F.lit(100).alias("height"), F.lit(-50.0).alias("minx"), F.lit(-50.0).alias("miny"), F.lit(50.0).alias("maxx"), F.lit(50.0).alias("maxy"))
    rows = [spark.range(1).select(F.lit(i).alias("scan_idx"), _image(v).alias("frame_image"), _image(9).alias("tile_image"), tile.alias("tile")) for i, v in enumerate((0, 1, 48))]
    planted = _planted()
    got = {r.scan_idx: r for r in localize.search_cells(rows[0].unionByName(rows[1]).unionByName(rows[2]), planted).collect()}
    assert (got[0].has_pose, got[0].n_inliers, got[0].error) == (False, 0, "ValueError: blank")
    assert (got[1].has_pose, got[1].n_inliers, got[1].error) == (False, 0, None)
    assert got[2].has_pose and got[2].n_inliers == 30 and abs(got[2].est_lat) < 1e-9 and abs(got[2].yaw_deg) < 1e-9
    links = {r.scan_idx: r for r in localize.pairwise_links(rows[1].unionByName(rows[2]).drop("tile"), planted).collect()}
    assert links[1].h is None and links[1].n_inliers == 5 and links[2].h[2] == 48


def test_reports(spark):
    df = spark.createDataFrame([("a", 1, 2.0, 1.0, True, 30, 0.1), ("a", 2, None, None, False, 3, 0.1)], "model string, frame long, err_m double, est_lat double, locked boolean, n_inliers long, runtime_s double")
    text = reports.markdown(metrics.field_metrics(df, "model"), "a", ["a", "zz"])
    assert "| a | 1/2 | 0.50 | 2.0 m | 2.0 m |" in text and "Without results: zz" in text
    assert [r.s for r in df.orderBy("frame").select(reports.status_line().alias("s")).collect()] == ["frame     1 err 2.00 m (30 inliers)", "frame     2 no pose (3 inliers)"]
    assert reports.settings_hash({"b": 1, "a": 2}) == reports.settings_hash({"a": 2, "b": 1})
