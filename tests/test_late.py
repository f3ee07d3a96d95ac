"""Steps that come late and out of order, against the same as a batch."""

import datetime
import random

import numpy as np

from skyfix.operators import fusion
from skyfix.streaming.late import filter_late

SCHEMA = "track long, frame long, t_s double, at timestamp, pos_e double, pos_n double"
ZERO = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def _row(k, i, r):
    fix = i % 3 != 0
    return (k, i, float(i), ZERO + datetime.timedelta(seconds=i), float(3 * i + r.normal()) if fix else None, float(r.normal()) if fix else None)


def test_late_steps_equal_the_batch_rule(spark, tmp_path):
    r, p = np.random.default_rng(5), random.Random(5)
    rows = [_row(k, i, r) for k in range(3) for i in range(60) if i % 7 != 5]
    order = sorted(rows, key=lambda x: x[1] + p.uniform(0, 8))  # up to eight seconds late
    too_late = [_row(1, 2, r)]
    batches = [order[i : i + 40] for i in range(0, len(order), 40)] + [too_late, [_row(9, 1000, r)], [_row(9, 1100, r)]]
    stream = None
    for i, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if stream is None:
            source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
            stream = filter_late(source, "track", "at", "10 seconds", idle_ms=50_000).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
        stream.processAllAvailable()
    sizes = [x["numRowsTotal"] for progress in stream.recentProgress for x in progress["stateOperators"]]
    stream.stop()
    got = {(x.track, x.frame): x for x in spark.table("late").collect()}
    want = fusion.fuse_tracks(spark.createDataFrame(rows, SCHEMA), "track", smooth=False).collect()
    assert set(got) - {(9, 1000), (9, 1100)} == {(x.track, x.frame) for x in want}
    for w in want:
        g = got[w.track, w.frame]
        assert np.allclose([g.east, g.north, g.v_east, g.v_north], [w.east, w.north, w.v_east, w.v_north], atol=1e-6) and g.fix_used == w.fix_used
    assert max(sizes) > sizes[-1]  # state of the tracks that ended has gone
