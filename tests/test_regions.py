"""Region datasets: headers, truth and extents by region, discovery of files, and what keeps a region from being used."""

import pytest
from pyspark.sql import functions as F

from skyfix.operators import asof, frames
from skyfix.sources import benchmark, tables


def test_every_header_is_found(spark):
    df = spark.createDataFrame([("a.jpg", "1.5", " ", "2.5", "7", "90", "3")], "`﻿File ` string, GPS_Lat string, lat string, Long string, `rel-alt` string, GimbalYaw string, other string")
    assert tuple(tables.aliased(df).select("filename", "lat", "lon", "alt_m", "yaw_deg").first()) == ("a.jpg", 1.5, 2.5, 7.0, 90.0)
    assert tables.normal_header(" LT-lat_Map ") == "lt_lat_map"


def test_headers_that_differ_in_case_only(spark, tmp_path):
    (tmp_path / "t.csv").write_text("\ufefffile,lat,Lat,LON,,lon\na.jpg,,1.5,2,x,\nb.jpg,3,4,,y,6\n", encoding="utf-8")
    rows = tables.read_headed(spark, str(tmp_path / "t.csv"))
    assert tables.distinct_headers(["a", "A", None, "a "]) == ["a", "A ", "_c2", "a  "]
    assert [(r.filename, r.lat, r.lon) for r in tables.aliased(rows).orderBy("filename").collect()] == [("a.jpg", 1.5, 2.0), ("b.jpg", 3.0, 6.0)]


def test_a_row_without_a_corner_has_no_extent(spark):
    df = spark.createDataFrame([("m1.tif", 2.0, 1.0, None, 3.0, 0), ("m2.tif", 1.0, 3.0, 2.0, 1.0, 1)], "map string, north double, west double, south double, east double, o int")
    got = {r.key: r.box for r in tables.ranges_by_key(tables.aliased(df, tables.RANGE_ALIASES, ("o",)), "o").collect()}
    assert sorted(got) == ["2", "m2"] and (got["m2"].min_lat, got["m2"].max_lat, got["m2"].min_lon, got["m2"].max_lon) == (1.0, 2.0, 1.0, 3.0)


def test_regions_that_share_stems_keep_their_own_truth(spark):
    images = spark.createDataFrame([("r1", "d1/0001.JPG", True), ("r2", "d2/0001.JPG", True)], "region string, path string, readable boolean")
    truth = spark.createDataFrame([("r1", "0001.jpg", "1", "1", "10", 0), ("r2", "0001.jpg", "2", "2", "", 1), ("r1", "0001.png", "3", "3", "", 2)], "region string, image string, lat string, lon string, height string, _order int")
    got = {r.region: (r.gt_lat, r.alt_m) for r in benchmark.region_samples(images, truth).collect()}
    assert got == {"r1": (3.0, None), "r2": (2.0, None)}  # the last row counts as a whole


def test_rows_of_a_headed_table_are_in_the_order_of_their_file(spark, tmp_path):
    lines = "\n".join(f"f{i % 50}.jpg,{i},0" for i in range(5000))
    (tmp_path / "truth.csv").write_text("﻿name,lat,lon\n" + lines, encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = tables.read_headed(spark, str(tmp_path / "truth.csv"))
        got = tables.truth_by_stem(tables.aliased(rows, keep=("_order",)), "_order").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.stem: r.lat for r in got} == {f"f{i}": 4950.0 + i for i in range(50)}


def test_discovery_and_skips(spark, tmp_path):
    for name, size in {"01/drone/b.JPG": 3, "01/drone/a.png": 3, "01/drone/note.txt": 1, "01/satellite01.tif": 5, "01/other.tif": 9, "01/01.csv": 2, "02/x.jpg": 4, "02/z.csv": 1, "02/y.csv": 1, "03/readme.md": 1, "02.csv": 1, "satellite_ coordinates_range.csv": 1}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    files = benchmark.list_files(spark, str(tmp_path))
    assert sorted(map(tuple, benchmark.region_images(files).collect())) == [("01", "01/drone/a.png"), ("01", "01/drone/b.JPG"), ("02", "02/x.jpg")]
    assert {r.region: r.map_path for r in benchmark.region_map_files(files).collect()} == {"01": "01/satellite01.tif", "02": "02/x.jpg"}
    assert {r.region: r.truth_path for r in benchmark.region_truth_files(files).where("region in ('01', '02')").collect()} == {"01": "01/01.csv", "02": "02/y.csv"}
    assert [r.path for r in benchmark.range_files(files).collect()] == ["satellite_ coordinates_range.csv"]
    regions = spark.createDataFrame([("a", "m", True), ("b", None, True), ("c", "m", True), ("d", "m", False), ("e", "m", True)], "region string, map_path string, map_readable boolean")
    samples = spark.createDataFrame([("a", None), ("b", 1.0), ("c", 1.0), ("d", 1.0), ("e", 1.0)], "region string, gt_lat double")
    maps = regions.select("region", F.when(F.col("region") != "c", F.struct(F.lit(1.0).alias("min_lon"))).alias("box"))
    got = {r.region: r.skipped for r in benchmark.usable_regions(regions, samples, maps).collect()}
    assert got == {"a": "no ground truth", "b": "no map", "c": "no extent", "d": "undecodable", "e": None}


def test_a_root_of_any_signs(spark, tmp_path):
    plain = tmp_path / "a+b (1)"
    (plain / "02").mkdir(parents=True)
    (plain / "02" / "q.jpg").write_bytes(b"x")
    assert [tuple(r) for r in benchmark.list_files(spark, str(plain)).collect()] == [("02/q.jpg", 1)]


def test_many_configurations_of_a_chart(spark):
    from skyfix.operators import metrics

    rows = [(f"c{i}", str(f), float(i), True) for i in range(300) for f in range(3) if (i + f) % 2]
    got = metrics.bench_bars(spark.createDataFrame(rows, "config string, frame_id string, err_m double, locked boolean")).collect()
    assert len(got) == 900 and sum(r.no_lock for r in got) == 450 and {r.height for r in got if r.no_lock} == {299 * 0.04}


def test_of_repeated_fixes_the_first_counts(spark):
    fixes = spark.createDataFrame([(1, 5, 9.0, 1.0, 0), (1, 5, 2.0, 1.0, 1)], "k long, frame long, lat double, lon double, o int")
    probes = spark.createDataFrame([(1, 4)], "k long, frame long")
    assert asof.nearest(probes, fixes, "k", ordinal="o").first().fix.lat == 9.0 and asof.nearest(probes, fixes, "k").first().fix.lat == 2.0


def test_frame_index_and_mismatches(spark, tmp_path):
    shards = spark.createDataFrame([(0, "complete", 1, 10, 2.0, "a.jpg", 5, "x"), (0, "complete", 0, 0, 2.0, "b.jpg", 6, "y"), (1, "partial", 9, 90, 1.0, "c.jpg", 7, "z")], "shard int, status string, index long, t_ms long, blur_score double, filename string, bytes long, sha1 string")
    tables.write_frame_index(shards, str(tmp_path / "frames"))
    back = spark.read.option("header", True).csv(str(tmp_path / "frames"))
    assert tuple(back.columns) == ("shard", "index", "t_ms", "blur_score", "filename", "bytes", "sha1")
    assert [tuple(r) for r in back.orderBy(F.col("shard").cast("int"), F.col("index").cast("int")).collect()] == [("0", "0", "0", "2.0", "b.jpg", "6", "y"), ("0", "1", "10", "2.0", "a.jpg", "5", "x"), ("1", "9", "90", "1.0", "c.jpg", "7", "z")]
    assert tables.missing_from_index(back, shards).collect() == []
    assert [tuple(r) for r in tables.missing_from_index(back.where("filename <> 'a.jpg'").withColumn("bytes", F.lit(1)), shards).orderBy("filename").collect()] == [("a.jpg", "not listed"), ("b.jpg", "size"), ("c.jpg", "size")]
    (tmp_path / "m.json").write_text('{"video": {"name": "v", "size_bytes": 5, "n_frames": 90, "fps": 29.97, "width": 4, "height": 3}, "settings_hash": "h", "settings": {"step": 5}, "completed": false}')
    head = tables.manifest_head(spark, str(tmp_path / "m.json")).withColumn("k", F.lit(1))
    assert head.first().settings == {"step": "5"}
    video = spark.createDataFrame([(1, "v", 5, 90, "h")], "k int, name string, size_bytes long, n_frames long, settings_hash string")
    identity = ["name", "size_bytes", "n_frames", "settings_hash"]
    frames.require_match(head, video, "k", identity)
    with pytest.raises(frames.IngestMismatchError, match="n_frames"):
        frames.require_match(head, video.withColumn("n_frames", F.lit(91)), "k", identity)
    with pytest.raises(frames.IngestMismatchError, match="size_bytes, settings_hash"):
        frames.require_match(head, head.withColumns({"size_bytes": F.lit(6), "settings_hash": F.lit("g")}), "k", ["name", "size_bytes", "settings_hash"])
