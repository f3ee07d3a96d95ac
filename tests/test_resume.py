"""Runs that stop and go on, frames that must be there, and readers of single tables."""

import pytest
from pyspark.sql import functions as F

from skyfix.operators import frames, search
from skyfix.plans import resume, runner
from skyfix.sources import tables


def test_a_stopped_run_does_only_what_is_missing(spark, tmp_path):
    groups = spark.createDataFrame([(f"s{i}", i) for i in range(40)] + [(None, 99)], "scenario string, n int")
    asked, told, fail = [], [], [True]

    def work(own):
        names = sorted(r.scenario for r in own.select("scenario").distinct().collect())
        asked.extend(names)
        rows = own.where("n % 10 <> 3").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("n") % 5)))
        if fail[0] and len(told) == 3:
            rows = rows.withColumn("x", F.raise_error(F.lit("stopped")).cast("int"))
        return rows

    path = str(tmp_path / "run")
    with pytest.raises(Exception, match="stopped"):
        resume.resumed(groups, "scenario", work, path, 8, told.append)
    done = told[-1].done
    assert len(told) == 3 and 0 < done < 40 and told[-1].total == 40
    fail[0], before = False, len(asked)
    rows = resume.resumed(groups, "scenario", work, path, 8, told.append)
    again = asked[before:]
    assert len(again) == len(set(again)) == 40 - done and told[-1].done == 40
    want = sorted((r.scenario, r.n, r.x) for r in work(groups.where("scenario is not null")).collect())
    assert sorted((r.scenario, r.n, r.x) for r in rows.collect()) == want and sum(p.rows for p in told) == len(want)
    count = len(told)
    assert resume.resumed(groups, "scenario", work, path, 8, told.append).count() == len(want) and len(told) == count
    more = groups.unionByName(spark.createDataFrame([("new", 4)], groups.schema))
    assert resume.resumed(more, "scenario", work, path, 8, told.append).where("scenario = 'new'").count() == 5 and told[-1] == resume.Progress(41, 41, 5, 1)


def test_a_run_of_search_scenarios_goes_on(spark, tmp_path):
    scenarios = spark.createDataFrame([(f"s{i}", "field", 43.5, -5.6, None, 70.0) for i in range(3)], "scenario string, terrain string, prior_lat double, prior_lon double, altitude_m double, hfov_deg double")
    samples = spark.createDataFrame([(f"s{i}", f, None, 43.5, -5.6) for i in range(3) for f in range(2)], "scenario string, frame long, t_s double, gt_lat double, gt_lon double")
    good = lambda cells: cells.withColumns({"n_inliers": F.when(F.col("centre_idx") == 12, 80).otherwise(5).cast("long"), "has_pose": F.lit(True), "est_lat": F.col("lat"), "est_lon": F.col("lon")})
    work = lambda own: runner.run(runner.Dataset("d", own, samples), {"good": good})
    rows = resume.resumed(scenarios, "scenario", work, str(tmp_path / "r"), 2)
    assert sorted((r.scenario, r.frame, r.locked) for r in rows.collect()) == [(f"s{i}", f, True) for i in range(3) for f in range(2)]


def test_frames_that_must_be_there(spark):
    have = spark.createDataFrame([(1, i, i * 2) for i in range(5)], "k long, frame long, v long")
    want = spark.createDataFrame([(1, 3), (1, 0), (1, 3)], "k long, frame long")
    assert sorted(r.v for r in frames.grabbed(have, want, "k", "frame").collect()) == [0, 6]
    with pytest.raises(LookupError, match=r"\(1, 7\)"):
        frames.grabbed(have, want.unionByName(spark.createDataFrame([(1, 7)], want.schema)), "k", "frame")
    assert (frames.require_frames("3", 101), frames.require_frames("9, 2,2", 10), frames.require_frames("1", 9)) == ([0, 50, 100], [2, 9], [0])
    for spec, n in (("x", 10), ("12,3", 10), ("0", 5), (",", 5), ("3", 0), ("-1,2", 5)):
        with pytest.raises(ValueError):
            frames.require_frames(spec, n)


def test_readers_of_tracks_and_scores(spark, tmp_path):
    (tmp_path / "track.csv").write_text("frame,t_s,lat,lon,alt_m\n3,0.1,43.5,-5.6,\n1,,43.0,-5.0,7\n")
    track = tables.read_track(spark, str(tmp_path / "track.csv"))
    assert sorted(map(tuple, track.collect()), key=str) == [(1, None, 43.0, -5.0, 7.0), (3, 0.1, 43.5, -5.6, None)]
    head = ",".join(c.split(" ")[0] for c in tables.SCORES.split(", "))
    (tmp_path / "scores.csv").write_text(f"{head}\n5,,1,2,1,2,0.5,,30,1,1.0\n2,,1,2,3,4,9.5,,30,0,1.0\n4,,,,1,2,,,3,0,1.0\n")
    assert [(r.frame, r.locked) for r in tables.read_posed(spark, str(tmp_path / "scores.csv")).collect()] == [(2, False), (5, True)]
    samples = spark.createDataFrame([(1, 2), (1, 9), (2, 0)], "k long, frame long")
    got = runner.with_truth(samples, track.withColumn("k", F.lit(1).cast("long")), "k")
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 2, 43.0, -5.0), (1, 9, 43.5, -5.6), (2, 0, None, None)]


def test_samples_and_passes(spark):
    rows = spark.createDataFrame([("a", i) for i in (5, 1, 3)] + [("b", 9)], "scenario string, frame long")
    assert sorted(map(tuple, runner.first_samples(rows, 2).collect())) == [("a", 1), ("a", 3), ("b", 9)]
    assert runner.first_samples(rows, None).count() == runner.first_samples(rows, 0).count() == 4
    both = search.both_passes(rows.withColumn("x", F.lit(1)), rows)
    assert both.groupBy("pass").count().count() == 2 and both.where("pass = 'fine' and x is null").count() == 4
