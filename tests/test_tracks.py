"""Trajectories, chains, fusion and matching against plain NumPy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyfix.operators import fusion, matchers, trajectory
from skyfix.streaming.fusion import filter_stream


def _kalman(steps, cfg, smooth):
    """The textbook filter on four states, and its smoother."""
    first = next(s for s in steps if s[1] is not None)
    x, p = np.array([first[1], first[2], 0, 0.0]), np.diag([cfg.init_pos_std**2] * 2 + [cfg.init_vel_std**2] * 2)
    prior, post, moves, flags, last = [], [], [], [], steps[0][0]
    for i, (t, e, n, ve, vn) in enumerate(steps):
        dt = max(t - last, 0.0)
        last = t
        f = np.eye(4)
        f[0, 2] = f[1, 3] = 0 if i == 0 else dt
        d = max(dt, 1e-6)
        g = np.array([[d * d / 2, 0], [0, d * d / 2], [d, 0], [0, d]])
        x, p = f @ x, f @ p @ f.T + cfg.accel_std**2 * g @ g.T
        prior.append((x, p))
        used = None
        for z, h, r, gate in ((None if e is None else (e, n), np.eye(4)[:2], cfg.fix_std_m, cfg.gate_chi2), (None if ve is None else (ve, vn), np.eye(4)[2:], cfg.velocity_std, 0)):
            if z is None:
                continue
            y, s = np.array(z) - h @ x, h @ p @ h.T + np.eye(2) * r * r
            ok = not (gate > 0 and y @ np.linalg.solve(s, y) > gate)
            if gate:
                used = ok
            if ok:
                k = p @ h.T @ np.linalg.inv(s)
                x, p = x + k @ y, (np.eye(4) - k @ h) @ p
        post.append((x, p))
        moves.append(f)
        flags.append(used)
    out = list(post)
    if smooth:
        for i in range(len(steps) - 2, -1, -1):
            c = post[i][1] @ moves[i + 1].T @ np.linalg.inv(prior[i + 1][1])
            out[i] = (post[i][0] + c @ (out[i + 1][0] - prior[i + 1][0]), post[i][1] + c @ (out[i + 1][1] - prior[i + 1][1]) @ c.T)
    return np.array([x for x, _ in out]), np.array([math.sqrt(q[0, 0] + q[1, 1]) for _, q in out]), flags


@pytest.mark.parametrize("smooth", [True, False])
def test_fusion_equals_the_four_state_filter(smooth):
    r = np.random.default_rng(3)
    cfg = fusion.Tuning()
    for _ in range(25):
        n = int(r.integers(2, 30))
        t = np.cumsum(r.random(n) * r.integers(0, 2, n))
        steps = []
        for i in range(n):
            fix = i == n - 1 or r.random() < 0.7
            steps.append((t[i], 3 * t[i] + r.normal() * 5 + (300 if r.random() < 0.1 else 0) if fix else None, r.normal() if fix else None, *((3 + r.normal() * 0.1, 0.1) if r.random() < 0.3 else (None, None))))
        got = fusion.fuse_steps(pd.DataFrame(steps, columns=["t_s", "pos_e", "pos_n", "vel_e", "vel_n"], dtype=float), cfg, smooth)
        want, std, flags = _kalman(steps, cfg, smooth)
        assert np.allclose(got[["east", "north", "v_east", "v_north"]], want, atol=1e-7) and np.allclose(got["pos_std_m"], std, atol=1e-7)
        assert got["fix_used"].tolist() == [bool(f) for f in flags] and got["fix_rejected"].tolist() == [f is False for f in flags]


def test_gate_and_missing_fixes():
    steps = pd.DataFrame({"t_s": [0.0, 1, 2, 3], "pos_e": [0.0, 0, 200, 0], "pos_n": [0.0, 0, 0, 0]})
    calm = pd.concat([steps] * 1)
    assert fusion.fuse_steps(calm, fusion.Tuning(init_pos_std=1, init_vel_std=1))["fix_rejected"].tolist() == [False, False, True, False]
    assert not fusion.fuse_steps(calm, fusion.Tuning(init_pos_std=1, init_vel_std=1, gate_chi2=0))["fix_rejected"].any()
    with pytest.raises(ValueError):
        fusion.fuse_steps(pd.DataFrame({"t_s": [0.0], "pos_e": [np.nan], "pos_n": [np.nan]}))


def test_stream_equals_the_causal_batch(spark, tmp_path):
    r = np.random.default_rng(5)
    rows = [(k, i, float(i) / 2, None if i % 3 == 0 else float(i + r.normal()), None if i % 3 == 0 else float(r.normal())) for k in range(3) for i in range(12)]
    df = spark.createDataFrame(rows, "track long, frame long, t_s double, pos_e double, pos_n double")
    for part in range(3):
        df.where(F.floor(F.col("frame") / 4) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    # files arrive in any order of their names, so only in-order arrival is compared
    query = filter_stream(stream, "track").writeStream.format("memory").queryName("fused").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    got = {(x.track, x.frame): x for x in spark.table("fused").collect()}
    want = fusion.fuse_tracks(df, "track", smooth=False).collect()
    assert len(got) == len(want) == len(rows)
    assert all(abs(got[w.track, w.frame].east - w.east) < 1e-6 and got[w.track, w.frame].fix_used == w.fix_used for w in want)


def test_relative_track_turns_and_stops_at_a_break(spark):
    q = math.pi / 2
    links = [(1, 0, 1, 0.0, 10.0, 0.0, False), (1, 1, 2, q, 10.0, 0.0, False), (1, 2, 3, 0.0, 10.0, 0.0, False), (2, 0, 1, 0.0, 5.0, 0.0, False), (2, 1, 2, 0.0, 5.0, 0.0, True), (2, 2, 3, 0.0, 5.0, 0.0, False)]
    df = spark.createDataFrame(links, "track long, idx_from long, idx_to long, theta double, tx double, ty double, is_break boolean")
    got = {(r.track, r.frame): (round(r.x, 9), round(r.y, 9)) for r in trajectory.relative_track(df, "track").collect()}
    assert got == {(1, 0): (0, 0), (1, 1): (10, 0), (1, 2): (20, 0), (1, 3): (20, 10), (2, 0): (0, 0), (2, 1): (5, 0)}


def test_fits_recover_planted_motions(spark):
    r = np.random.default_rng(1)
    p = r.normal(size=(40, 2)) * 30
    c, s = math.cos(0.35), math.sin(0.35)
    q = 2 * p @ np.array([[c, s], [-s, c]]) + [5, -7]
    df = spark.createDataFrame([(1, *map(float, (*a, *b))) for a, b in zip(p, q)], "k long, sx double, sy double, dx double, dy double")
    fit = trajectory.fit_similarity(df, "k").first()
    assert abs(fit.scale - 2) < 1e-9 and abs(fit.rot_deg - math.degrees(0.35)) < 1e-9 and abs(fit.tx - 5) < 1e-9 and abs(fit.ty + 7) < 1e-9
    assert abs(trajectory.fit_rigid(df, "k").first().rot_deg - math.degrees(0.35)) < 1e-9


def test_chains_and_hops(spark):
    r = np.random.default_rng(2)
    n, breaks, anchors = 14, {6}, {0, 3, 11}
    h = [np.eye(3) + r.normal(size=(3, 3)) * 0.05 for _ in range(n - 1)]
    ref = {a: np.eye(3) + r.normal(size=(3, 3)) * 0.1 for a in anchors}
    inl = [int(x) for x in r.integers(12, 90, n)]
    nodes = spark.createDataFrame([(1, i, i in anchors, i in breaks or i == n - 1, inl[i]) for i in range(n)], "track long, pos long, is_anchor boolean, is_break boolean, n_inliers long")
    chain = trajectory.nearest_anchor(nodes, "track")
    links = spark.createDataFrame([(1, i, h[i].ravel().tolist()) for i in range(n - 1) if i not in breaks], "track long, pos long, h array<double>")
    marks = spark.createDataFrame([(1, a, ref[a].ravel().tolist()) for a in anchors], "track long, anchor long, h_to_ref array<double>")
    got = {x.pos: x for x in trajectory.chain_homographies(links, chain, marks, "track").collect()}
    hops = {x.pos: x for x in chain.collect()}
    for i in range(n):
        best = None
        for a in sorted(anchors):
            lo, hi = min(a, i), max(a, i)
            if not any(b in range(lo, hi) for b in breaks) and (best is None or hi - lo < best[0]):
                best = (hi - lo, a)
        assert (hops[i].hops, hops[i].anchor) == best
        a, m = best[1], ref[best[1]] / ref[best[1]][2, 2]
        for k in range(a, i) if i > a else range(a - 1, i - 1, -1):
            m = m @ (np.linalg.inv(h[k]) if i > a else h[k])
            m /= m[2, 2]
        assert np.allclose(np.array(got[i].h).reshape(3, 3), m, atol=1e-9)
        assert hops[i].weakest == (0 if i == a else min(inl[min(a, i) : max(a, i)]))


@pytest.mark.parametrize("tilt", [0, 5, 15, 30, 85])
def test_ground_pose(tilt):
    a, yaw, alt = math.radians(tilt), 0.4, 90.0
    down = np.array([math.sin(a) * math.sin(yaw), math.sin(a) * math.cos(yaw), -math.cos(a)])
    right = np.array([math.cos(yaw), -math.sin(yaw), 0.0])
    rot = np.stack([right, np.cross(down, right), down])
    centre = -down / -down[2] * alt * np.array([1, 1, 1])
    centre = np.array([-down[0] * alt / math.cos(a), -down[1] * alt / math.cos(a), alt])
    k = np.array([[900.0, 0, 640], [0, 900, 360], [0, 0, 1]])
    p = k @ np.stack([rot[:, 0], rot[:, 1], -rot @ centre], axis=1)
    got = matchers.decompose_ground(np.linalg.inv(p) * 3.7, k)
    if tilt > matchers.MAX_TILT:
        assert got is None
    else:
        assert np.allclose(got, (centre[0], centre[1], alt, tilt), atol=1e-5)


def test_homography_from_correspondences():
    r = np.random.default_rng(4)
    h = np.array([[1.1, 0.05, 20], [-0.04, 0.95, 9], [1e-5, -2e-5, 1]])
    src = r.random((60, 2)) * 900
    dst = matchers.transfer(h, src)
    dst[:15] += r.random((15, 2)) * 300 + 40
    got, inside = matchers.estimate_homography(src, dst)
    assert inside.sum() == 45 and np.allclose(got, h, rtol=1e-4, atol=1e-4)
    assert matchers.estimate_homography(src[:3], dst[:3]) == (None, None)
    none, few = matchers.estimate_homography(src[15:22], dst[15:22])
    assert none is None and few.sum() == 7
    with pytest.raises(ImportError):
        matchers.get_matcher("learned")
    sharp = (np.indices((64, 64)).sum(axis=0) % 2 * 255).astype(np.uint8)
    assert matchers.focus(sharp) > matchers.focus(np.full((64, 64), 7, np.uint8)) == 0
