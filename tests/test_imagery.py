"""Requests of imagery against a service that fails in every way, and the store of tiles."""

import random

import pytest
from pyspark.sql import functions as F

from skyfix.sources import imagery, store


def _opener():
    """A service whose answer is decided by the request's size in pixels; errors of the server pass after so many attempts."""
    seen = {}

    def open_(url, params, timeout):
        size = int(params.get("WIDTH") or params["size"].split(",")[0])
        key = (url, params.get("BBOX") or params["bbox"], size)
        seen[key] = seen.get(key, 0) + 1
        if size % 7 == 1 and seen[key] <= size % 4:
            return imagery.Reply(503, "text/html", b"busy")
        if size % 7 == 2:
            return imagery.Reply(404, "text/html", b"none")
        if size % 7 == 3:
            return imagery.Reply(200, "application/json", b'{"error": "bbox"}')
        return imagery.Reply(200, "image/png", f"{url}|{size}".encode())

    return open_


def _loop(requests):
    """The same, one after the other."""
    out = []
    for i, r in enumerate(requests):
        waits = []
        try:
            got = imagery.get_provider(r["provider"]).fetch(r["lat"], r["lon"], r["span_m"], r["pixels"], _opener(), waits.append)
            assert waits == [1.0, 1.5][: got[2] - 1]
            out.append((i, *got, None))
        except (RuntimeError, ValueError) as e:
            out.append((i, None, None, None, f"{type(e).__name__}: {e}"))
    return out


def _requests():
    r = random.Random(4)
    return [{"provider": r.choice(["esri", "pnoa", "ign", "nowhere"]), "lat": 43 + i * 1e-3, "lon": -5.0, "span_m": 100.0, "pixels": 60 + i} for i in range(100)]


def test_a_read_of_requests_equals_a_loop(spark):
    requests = _requests()
    opener = _opener()
    df = imagery.read_imagery(spark, requests, opener, lambda s: None)
    assert df.rdd.getNumPartitions() == 100
    got = sorted((r.request, None if r.content is None else bytes(r.content), r.content_type, r.attempts, r.error) for r in df.collect())
    want = _loop(requests)
    assert got == want and len({w[-1] and w[-1].split(":")[1][:14] for w in want}) > 4
    assert any(w[3] == 3 for w in want) and any(w[4] and "503" in w[4] for w in want)
    table = spark.createDataFrame([(i, *r.values()) for i, r in enumerate(requests)], "request long, provider string, lat double, lon double, span_m double, pixels int")
    again = imagery.fetched(table.repartition(7), _opener(), lambda s: None)
    assert sorted((r.request, None if r.content is None else bytes(r.content), r.content_type, r.attempts, r.error) for r in again.collect()) == want
    first = again.where("request = 0").first()
    assert first.tile.width == 60 and abs(first.tile.maxx - first.tile.minx - 100) < 1e-5


def test_a_read_can_stop_at_an_error(spark):
    bad = [{"provider": "esri", "lat": 43.0, "lon": -5.0, "span_m": 100.0, "pixels": 65}]
    with pytest.raises(Exception, match="404"):
        imagery.read_imagery(spark, bad, _opener(), stop=True).collect()
    with pytest.raises(ValueError, match="unknown provider"):
        imagery.get_provider("nowhere")
    asked = []
    imagery.get_provider("PNOA").fetch(43.0, -5.0, 100, 64, lambda u, p, t: asked.append(p) or imagery.Reply(200, "image/png", b"x"))
    assert asked[0]["LAYERS"] == "OI.OrthoimageCoverage" and asked[0]["WIDTH"] == "64" and asked[0]["VERSION"] == "1.3.0"


def test_tiles_that_hold_a_point(spark):
    r = random.Random(7)
    tiles = [(f"t{i}", x := r.uniform(-2e7, 2e7), y := r.uniform(-2e7, 2e7), x + (s := 10 ** r.uniform(0, 7)), y + s * r.uniform(0.2, 1)) for i in range(150)] + [("all", -2.1e7, -2.1e7, 2.1e7, 2.1e7)]
    points = [(i, t[1 + 2 * r.randint(0, 1)] if i % 3 else r.uniform(t[1], t[3]), t[2] if i % 5 else r.uniform(t[2], t[4])) for i, t in enumerate(r.choices(tiles, k=300))]
    a = spark.createDataFrame(points, "point int, x double, y double")
    b = spark.createDataFrame([(n, (x0, y0, x1, y1)) for n, x0, y0, x1, y1 in tiles], "name string, tile struct<minx: double, miny: double, maxx: double, maxy: double>")
    joined = store.holding(a, b)
    assert sorted((p.point, p.name) for p in joined.collect()) == sorted((i, n) for i, x, y in points for n, x0, y0, x1, y1 in tiles if x0 <= x <= x1 and y0 <= y <= y1)
    assert store.covered(b).groupBy("name").count().agg(F.max("count")).first()[0] <= 9


def test_a_store_is_saved_and_loaded(spark, tmp_path):
    path = str(tmp_path / "tiles")
    rows = [(f"t{i}", (1000.0 * i, 0.0, 1000.0 * i + 500, 500.0), bytearray([i])) for i in range(6)]
    df = spark.createDataFrame(rows, "name string, tile struct<minx: double, miny: double, maxx: double, maxy: double>, content binary")
    store.save(df.where("name < 't3'"), path)
    store.save(df.where("name >= 't3'"), path)
    assert sorted(map(str, store.load(spark, path).select(*df.columns).collect())) == sorted(map(str, df.collect()))
    assert bytes(store.load(spark, path, "t4").first().content) == b"\x04"
    with pytest.raises(FileNotFoundError):
        store.load(spark, path, "t9")
