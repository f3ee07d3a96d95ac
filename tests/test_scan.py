"""Filters, smoothers and chains as scans over blocks, against the same step by step."""

import math

import numpy as np
import pandas as pd
import pytest

from skyfix.operators import fusion, scan

NUMBERS = ["east", "north", "v_east", "v_north", "pos_std_m"]


def _track(r, n, jumps=0.1):
    t = np.cumsum(r.random(n) * r.integers(0, 3, n)) + 100
    fix = r.random(n) < 0.6
    fix[r.integers(0, n)] = True
    out = pd.DataFrame({"frame": np.arange(n) * 3, "t_s": t})
    out["pos_e"] = np.where(fix, 3 * t + r.normal(size=n) * 5 + np.where(r.random(n) < jumps, 300, 0), np.nan)
    out["pos_n"] = np.where(fix, r.normal(size=n) * 5 - t, np.nan)
    out["pos_std"] = np.where(r.random(n) < 0.3, 4.0, np.nan)
    timed = r.random(n) < 0.3
    out["vel_e"], out["vel_n"] = np.where(timed, 3 + r.normal(size=n) * 0.3, np.nan), np.where(timed, -1.0, np.nan)
    out["vel_std"] = np.where(r.random(n) < 0.5, 0.8, np.nan)
    out.loc[r.random(n) < 0.1, "t_s"] = np.nan
    return out


def test_scans_of_segments():
    r = np.random.default_rng(0)
    sizes = np.array([1, 7, 64, 3, 100])
    place, back = scan.places(sizes)
    m = r.normal(size=(3, 3, int(sizes.sum())))
    whole, = scan.inclusive(lambda a, b: (scan.mul(a[0], b[0]),), (m,), place)
    ends, = scan.suffix(lambda a, b: (scan.mul(a[0], b[0]),), (m,), back)
    at = 0
    for n in sizes:
        for i in range(n):
            assert np.allclose(whole[..., at + i], np.linalg.multi_dot([np.eye(3), np.eye(3), *np.moveaxis(m[..., at : at + i + 1], -1, 0)]))
            assert np.allclose(ends[..., at + i], np.linalg.multi_dot([np.eye(3), np.eye(3), *np.moveaxis(m[..., at + i : at + n], -1, 0)]))
        at += n


@pytest.mark.parametrize("gate", [0.0, 13.816, 0.5])
@pytest.mark.parametrize("smooth", [True, False])
def test_blocks_equal_the_filter_step_by_step(spark, gate, smooth):
    r = np.random.default_rng(int(gate * 10) + smooth)
    cfg = fusion.Tuning(gate_chi2=gate)
    tracks = {k: _track(r, n) for k, n in enumerate([1, 2, 10, 333, 2000])}
    tracks[7] = tracks[2].assign(pos_e=np.nan)  # no fix at all: no rows
    tracks[8] = tracks[3].assign(t_s=np.nan)
    df = spark.createDataFrame(pd.concat([t.assign(track=k) for k, t in tracks.items()])).repartition(5)
    got = fusion.fuse_tracks(df, "track", cfg, smooth, block=50).toPandas()
    assert sorted(got["track"].unique()) == [0, 1, 2, 3, 4, 8]
    for k, own in got.groupby("track"):
        want = fusion.fuse_steps(tracks[k], cfg, smooth)
        own = own.sort_values("frame")
        assert own["frame"].tolist() == tracks[k]["frame"].tolist()
        assert own["fix_used"].tolist() == want["fix_used"].tolist() and own["fix_rejected"].tolist() == want["fix_rejected"].tolist()
        assert np.allclose(own[NUMBERS], want[NUMBERS], atol=1e-6, rtol=1e-9)


def test_a_long_track_in_whole_blocks(spark):
    r = np.random.default_rng(4)
    track = _track(r, 10_000, 0.02)
    df = spark.createDataFrame(track.assign(track="one"))
    for cfg in (fusion.Tuning(gate_chi2=0), fusion.Tuning()):
        got = fusion.fuse_tracks(df, "track", cfg, block=512).toPandas().sort_values("frame")
        want = fusion.fuse_steps(track, cfg)
        assert np.allclose(got[NUMBERS], want[NUMBERS], atol=1e-6, rtol=1e-9) and got["fix_used"].tolist() == want["fix_used"].tolist()


def test_a_gate_that_rounds_do_not_settle(monkeypatch):
    r = np.random.default_rng(6)
    cfg = fusion.Tuning(gate_chi2=2.0)
    track = _track(r, 400, 0.5)
    want = fusion.fuse_steps(track, cfg, smooth=False)
    monkeypatch.setattr(fusion, "GATE_ROUNDS", 1)
    import pyarrow as pa

    lists = {c: pa.array([[None if math.isnan(x) else x for x in track[c]]], pa.list_(pa.float64())) for c in ("t_s", *fusion.MEASURED)}
    first = track.dropna(subset=["pos_e"]).iloc[0]
    t0 = track["t_s"].dropna().iloc[0]
    batch = pa.RecordBatch.from_pydict(lists | {"time_before": [t0], "opening": [True], "first_e": [first["pos_e"]], "first_n": [first["pos_n"]]})
    s = fusion._steps_of(batch, cfg)
    _, _, post, cov, used = s.filtered(*fusion._starts(batch, cfg), s.fixed, cfg.gate_chi2)
    assert used.tolist() == want["fix_used"].tolist() and np.allclose(post[0, 0], want["east"]) and np.allclose(np.sqrt(2 * cov[0, 0]), want["pos_std_m"])


def test_a_long_chain_in_blocks(spark):
    """One anchor on a track of 50,000 links, both ways."""
    from skyfix.operators import trajectory

    r = np.random.default_rng(9)
    n, at = 50_000, 20_000
    th, t = r.normal(size=n) * 0.02, r.normal(size=(n, 2)) * 3
    links = pd.DataFrame({"track": 1, "pos": np.arange(n), "h": [[math.cos(a), -math.sin(a), x, math.sin(a), math.cos(a), y, 0.0, 0.0, 1.0] for a, (x, y) in zip(th.tolist(), t.tolist())]})
    nodes = pd.DataFrame({"track": 1, "pos": np.arange(n + 1), "anchor": at, "hops": np.abs(np.arange(n + 1) - at)})
    anchors = spark.createDataFrame([(1, at, [2.0, 0.0, 500.0, 0.0, 2.0, 700.0, 0.0, 0.0, 2.0])], "track long, anchor long, h_to_ref array<double>")
    out = trajectory.chain_homographies(spark.createDataFrame(links), spark.createDataFrame(nodes), anchors, "track", block=1000)
    got = out.toPandas().sort_values("pos")
    assert got["pos"].tolist() == list(range(n + 1))
    have = np.array(got["h"].tolist()).reshape(-1, 3, 3)
    start = np.array([[1, 0, 250.0], [0, 1, 350.0], [0, 0, 1]])
    step = np.array(links["h"].tolist()).reshape(-1, 3, 3)
    m = start
    for i in range(at, n):
        m = m @ np.linalg.inv(step[i])
        if i % 997 == 0 or i == n - 1:
            assert np.allclose(have[i + 1], m, atol=1e-6)
    m = start
    for i in range(at - 1, -1, -1):
        m = m @ step[i]
        if i % 997 == 0:
            assert np.allclose(have[i], m, atol=1e-6)


def test_a_link_without_an_inverse(spark):
    from skyfix.operators import trajectory

    unit, flat = [1.0, 0, 0, 0, 1, 0, 0, 0, 1], [0.0] * 8 + [1.0]
    links = spark.createDataFrame([(1, 0, [float(x) for x in unit]), (1, 1, [float(x) for x in flat]), (1, 2, [float(x) for x in unit])], "track long, pos long, h array<double>")
    chain = spark.createDataFrame([(1, p, 0, p) for p in range(4)], "track long, pos long, anchor long, hops long")
    anchors = spark.createDataFrame([(1, 0, [float(x) for x in unit])], "track long, anchor long, h_to_ref array<double>")
    got = {r.pos: r.h for r in trajectory.chain_homographies(links, chain, anchors, "track").collect()}
    assert got[1] == [float(x) for x in unit] and got[2] == got[3] == [None] * 9


def test_products_of_segments_are_reduced():
    rng = np.random.default_rng(3)
    sizes = np.array([1, 7, 64, 2, 33])
    matrices = np.eye(2)[:, :, None] + 0.1 * rng.normal(size=(2, 2, int(sizes.sum())))
    counted = []
    product = lambda a, b: counted.append(a[0].shape[-1]) or (scan.mul(a[0], b[0]),)
    (got,) = scan.reduced(product, (matrices,), sizes)
    for k, end in enumerate(np.cumsum(sizes)):
        want = np.eye(2)
        for i in range(end - sizes[k], end):
            want = want @ matrices[..., i]
        assert np.allclose(got[..., k], want, rtol=1e-12)
    assert sum(counted) == sizes.sum() - len(sizes)


def test_a_gate_takes_no_scans_within_blocks(monkeypatch):
    """Fixes of which the gate lets few in took a dozen scans over all steps before they were gone through one by one."""
    n = 500
    rng = np.random.default_rng(4)
    s = fusion.Steps(np.array([n]), np.full(n, 1.0), np.repeat(np.array([[0.25, 0.5], [0.5, 1.0]])[:, :, None], n, axis=2), rng.normal(size=(2, n)) * 60, np.full(n, 64.0), np.full((2, n), np.nan), np.full(n, 1.0))
    monkeypatch.setattr(scan, "inclusive", lambda *a: pytest.fail("a scan over steps"))
    *_, use = s.filtered(np.zeros((2, 2, 1)), np.diag([2500.0, 100.0])[:, :, None], s.fixed, 13.816)
    assert 0 < use.sum() < n


@pytest.mark.parametrize("accel", [1.0, 3.0])
def test_long_gaps_leave_the_deviation_exact(spark, accel):
    """Steps 1 to 3000 s apart, against the same filter and smoother in 80 digits."""
    import decimal

    D = decimal.Decimal

    r = np.random.default_rng(12)
    gaps = [0] + [int(x) for x in r.choice([1, 40, 900, 3000], 30)]
    fixed = [i % 3 != 2 for i in range(len(gaps))]
    steps = [(1, i, float(t), 0.0 if f else None, 0.0 if f else None) for i, (t, f) in enumerate(zip(np.cumsum(gaps), fixed))]
    got = [x.pos_std_m for x in fusion.fuse_tracks(spark.createDataFrame(steps, "track long, frame long, t_s double, pos_e double, pos_n double"), "track", fusion.Tuning(accel_std=accel)).orderBy("frame").collect()]
    p, c, v, q = D(2500), D(0), D(100), D(accel) ** 2
    prior, post = [], []
    decimal.getcontext().prec = 80
    for d, f in zip(gaps, fixed):
        t = max(D(d), D(1e-6))
        p, c, v = p + 2 * d * c + d * d * v + q * t**4 / 4, c + d * v + q * t**3 / 2, v + q * t * t
        prior.append((p, c, v))
        if f:
            p, c, v = p - p * p / (p + 64), c - p * c / (p + 64), v - c * c / (p + 64)
        post.append((p, c, v))
    want = [post[-1]]
    for (p, c, v), (pp, pc, pv), d in zip(post[-2::-1], prior[:0:-1], gaps[:0:-1]):
        det, a, b = pp * pv - pc * pc, p + d * c, c + d * v
        g = (a * pv - c * pc) / det, (c * pp - a * pc) / det, (b * pv - v * pc) / det, (v * pp - b * pc) / det
        x, y, z = (i - j for i, j in zip(want[-1], (pp, pc, pv)))
        h = g[0] * x + g[1] * y, g[0] * y + g[1] * z, g[2] * x + g[3] * y, g[2] * y + g[3] * z
        want.append((p + h[0] * g[0] + h[1] * g[1], c + h[0] * g[2] + h[1] * g[3], v + h[2] * g[2] + h[3] * g[3]))
    assert np.allclose(got, [math.sqrt(2 * float(x[0])) for x in want[::-1]], rtol=1e-11, atol=0)
