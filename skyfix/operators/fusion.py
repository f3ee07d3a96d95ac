"""Fusion of fixes and velocities into one track: a constant-velocity filter and its smoother.

East and north share one covariance of three numbers (position, cross, velocity), as noise acts alike on both axes; only the
gate looks at both. `Axis state` is (e, n, ve, vn, p, c, v)."""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyfix.functions import geo
from skyfix.operators import scan


@dataclasses.dataclass(frozen=True)
class Tuning:
    accel_std: float = 1.0
    fix_std_m: float = 8.0
    velocity_std: float = 0.5
    gate_chi2: float = 13.816
    init_pos_std: float = 50.0
    init_vel_std: float = 10.0


State = tuple[float, float, float, float, float, float, float]


def start(east: float, north: float, cfg: Tuning) -> State:
    return east, north, 0.0, 0.0, cfg.init_pos_std**2, 0.0, cfg.init_vel_std**2


def predict(s: State, dt: float, first: bool, cfg: Tuning) -> State:
    """The state dt later; on the first step nothing moves but noise is added (for 1e-6 s at least)."""
    move, q, t = (0.0 if first else dt), cfg.accel_std**2, max(dt, 1e-6)
    e, n, ve, vn, p, c, v = s
    return e + move * ve, n + move * vn, ve, vn, p + 2 * move * c + move * move * v + q * t**4 / 4, c + move * v + q * t**3 / 2, v + q * t * t


def update(s: State, zx: float, zy: float, std: float, place: bool, gate: float) -> tuple[State, bool]:
    """A measurement of position (or of velocity); whether the gate let it in."""
    e, n, ve, vn, p, c, v = s
    var = (p if place else v) + std * std
    yx, yy = (zx - e, zy - n) if place else (zx - ve, zy - vn)
    if gate > 0 and (yx * yx + yy * yy) / var > gate:
        return s, False
    kp, kv = (p / var, c / var) if place else (c / var, v / var)
    w = c if place else v
    cov = (p - kp * (p if place else c), c - kp * w, v - kv * w)
    return (e + kp * yx, n + kp * yy, ve + kv * yx, vn + kv * yy, *cov), True


def _smooth(prior: list[State], post: list[State], moves: list[float]) -> list[State]:
    """Backward sweep with the 2x2 gain of one axis, applied to both."""
    out = list(post)
    later = post[-1]
    for i in range(len(post) - 2, -1, -1):
        dt = moves[i + 1]
        e, n, ve, vn, p, c, v = post[i]
        qe, qn, qve, qvn, pp, pc, pv = prior[i + 1]
        det = pp * pv - pc * pc
        m00, m01, m11 = p + dt * c, c, v
        m10 = c + dt * v
        g00, g01 = (m00 * pv - m01 * pc) / det, (m01 * pp - m00 * pc) / det
        g10, g11 = (m10 * pv - m11 * pc) / det, (m11 * pp - m10 * pc) / det
        de, dn, dve, dvn, dp, dc, dv = later[0] - qe, later[1] - qn, later[2] - qve, later[3] - qvn, later[4] - pp, later[5] - pc, later[6] - pv
        h00, h01, h10, h11 = g00 * dp + g01 * dc, g00 * dc + g01 * dv, g10 * dp + g11 * dc, g10 * dc + g11 * dv
        cov = p + h00 * g00 + h01 * g01, c + (h00 * g10 + h01 * g11 + h10 * g00 + h11 * g01) / 2, v + h10 * g10 + h11 * g11
        later = out[i] = (e + g00 * de + g01 * dve, n + g00 * dn + g01 * dvn, ve + g10 * de + g11 * dve, vn + g10 * dn + g11 * dvn, *cov)
    return out


def known_times(t: np.ndarray) -> np.ndarray:
    """Missing times filled with the one before (the first known one at the start): such a step is simultaneous with it."""
    return pd.Series(t, dtype=float).ffill().bfill().fillna(0.0).to_numpy()


def fuse_steps(steps: pd.DataFrame, cfg: Tuning = Tuning(), smooth: bool = True) -> pd.DataFrame:
    """Steps in order (t_s, pos_e, pos_n, and if known pos_std, vel_e, vel_n, vel_std) to states. Steps before the first fix start from it."""
    known = steps["pos_e"].notna() & steps["pos_n"].notna()
    if not known.any():
        raise ValueError("a track needs at least one position fix")
    first = steps.loc[known].iloc[0]
    s, n = start(float(first["pos_e"]), float(first["pos_n"]), cfg), len(steps)
    col = lambda name: steps[name].to_numpy(float).tolist() if name in steps else [math.nan] * n
    t = known_times(steps["t_s"].to_numpy(float)).tolist()
    prior, post, moves, used, rejected, last = [], [], [], [False] * n, [False] * n, t[0]
    for i, (now, pe, pn, ps, ve, vn, vs) in enumerate(zip(t, *(col(c) for c in ("pos_e", "pos_n", "pos_std", "vel_e", "vel_n", "vel_std")))):
        dt, last = max(now - last, 0.0), now
        moves.append(dt)
        s = predict(s, dt, i == 0, cfg)
        prior.append(s)
        if pe == pe and pn == pn:
            s, used[i] = update(s, pe, pn, ps if ps == ps else cfg.fix_std_m, True, cfg.gate_chi2)
            rejected[i] = not used[i]
        if ve == ve and vn == vn:
            s, _ = update(s, ve, vn, vs if vs == vs else cfg.velocity_std, False, 0.0)
        post.append(s)
    out = np.array(_smooth(prior, post, moves) if smooth and n > 1 else post)
    return pd.DataFrame({"east": out[:, 0], "north": out[:, 1], "v_east": out[:, 2], "v_north": out[:, 3], "pos_std_m": np.sqrt(np.maximum(2 * out[:, 4], 0)), "fix_used": used, "fix_rejected": rejected})


STATE = "frame long, t_s double, east double, north double, v_east double, v_north double, pos_std_m double, fix_used boolean, fix_rejected boolean"


#: What a step may measure, besides its time.
MEASURED = ("pos_e", "pos_n", "pos_std", "vel_e", "vel_n", "vel_std")
#: The filter over a run of steps, as in Sarkka and Garcia-Fernandez (2021): the state after it is normal with mean A x + b and covariance C, given the state x before it, and
#: eta and J are what its measurements say of x. b and eta have a column for each axis, which share A, C and J.
FILTER = [(2, 2)] * 5
#: The smoother over a run of steps: mean E x + g and covariance E P E' + L of its first step, given the state (x, P) of the step after it.
SMOOTHER = [(2, 2)] * 3
#: Blocks of tracks that have others: a track of one block needs no scan.
SEVERAL = "not (opening and closing)"
#: Rounds in which the gate of a block is tried by scans; what is left is done step by step.
GATE_ROUNDS = 0


def _eye(n: int) -> np.ndarray:
    return np.repeat(np.eye(2)[:, :, None], n, axis=2)


def compose(a: scan.Element, b: scan.Element) -> scan.Element:
    """The filter over a run of steps a and then b."""
    (a1, b1, c1, e1, j1), (a2, b2, c2, e2, j2) = a, b
    eye = _eye(a1.shape[-1])
    left = scan.mul(a2, scan.inverse2(eye + scan.mul(c1, j2)))
    right = scan.mul(scan.transposed(a1), scan.inverse2(eye + scan.mul(j2, c1)))
    return scan.mul(left, a1), scan.mul(left, b1 + scan.mul(c1, e2)) + b2, scan.mul(scan.mul(left, c1), scan.transposed(a2)) + c2, scan.mul(right, e2 - scan.mul(j2, b1)) + e1, scan.mul(scan.mul(right, j2), a1) + j1


def compose_back(a: scan.Element, b: scan.Element) -> scan.Element:
    """The smoother over a run of steps a and then b."""
    (e1, g1, l1), (e2, g2, l2) = a, b
    return scan.mul(e1, e2), scan.mul(e1, g2) + g1, scan.mul(scan.mul(e1, l2), scan.transposed(e1)) + l1


def after(mean: np.ndarray, cov: np.ndarray, run: scan.Element) -> tuple[np.ndarray, np.ndarray]:
    """States after runs of steps, from the states before them."""
    a, b, c, eta, j = run
    left = scan.mul(a, scan.inverse2(_eye(a.shape[-1]) + scan.mul(cov, j)))
    return scan.mul(left, mean + scan.mul(cov, eta)) + b, scan.mul(scan.mul(left, cov), scan.transposed(a)) + c


@dataclasses.dataclass
class Steps:
    """The steps of many blocks, one after the other: moves and noise, fixes, velocities; and where each block starts."""

    sizes: np.ndarray
    move: np.ndarray
    noise: np.ndarray
    fix: np.ndarray
    fix_var: np.ndarray
    speed: np.ndarray
    speed_var: np.ndarray

    def __post_init__(self):
        self.place, self.back = scan.places(self.sizes)
        self.fixed, self.timed = ~np.isnan(self.fix).any(axis=0), ~np.isnan(self.speed).any(axis=0)
        n = len(self.move)
        self.f = _eye(n)
        self.f[0, 1] = self.move
        self.det = None

    def elements(self, use: np.ndarray) -> scan.Element:
        """One step each: the motion, the fix where it is used, the velocity."""
        n = len(self.move)
        zero = np.zeros((2, 2, n))
        a, b, c, eta, j = self.f.copy(), zero.copy(), self.noise.copy(), zero.copy(), zero.copy()
        at = np.flatnonzero(use)
        if len(at):
            f, q, z = self.f[..., at], self.noise[..., at], self.fix[:, at]
            s = q[0, 0] + self.fix_var[at]
            gain = q[:, 0] / s
            keep = _eye(len(at))
            keep[:, 0] -= gain
            a[..., at], b[..., at], c[..., at] = scan.mul(keep, f), gain[:, None] * z[None], scan.mul(keep, q)
            row = f[0]  # of the fix's first row, as seen from the state before
            eta[..., at], j[..., at] = row[:, None] * z[None] / s, row[:, None] * row[None] / s
        step, at = (a, b, c, eta, j), np.flatnonzero(self.timed)
        if len(at):
            m = len(at)
            none = np.zeros((2, 2, m))
            e2, j2 = none.copy(), none.copy()
            e2[1], j2[1, 1] = self.speed[:, at] / self.speed_var[at], 1 / self.speed_var[at]
            got = compose(tuple(x[..., at] for x in step), (_eye(m), none, none, e2, j2))
            for x, g in zip(step, got):
                x[..., at] = g
        return step

    def prior(self, mean: np.ndarray, cov: np.ndarray, post: np.ndarray, post_cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States before the measurements of each step; mean and cov are those of the step before each block."""
        m, p = np.empty_like(post), np.empty_like(post_cov)
        first = self.place == 0
        at = np.flatnonzero(~first)
        m[..., at], p[..., at] = post[..., at - 1], post_cov[..., at - 1]
        m[..., first], p[..., first] = mean, cov
        return scan.mul(self.f, m), scan.mul(scan.mul(self.f, p), scan.transposed(self.f)) + self.noise

    def filtered(self, mean: np.ndarray, cov: np.ndarray, use: np.ndarray, gate: float):
        """(prior, its covariance, posterior, its covariance, fixes used) of each step from the states before each block.

        The gate of a step depends on those before it: with the fixes that one round lets in the next is computed; a round settles at least the first step of each block that it changes. All blocks abreast, step by step, is cheaper than several rounds."""
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        use = use & self.fixed
        for _ in range(GATE_ROUNDS if gate > 0 else 1):
            post, post_cov = after(mean[..., owner], cov[..., owner], scan.inclusive(compose, self.elements(use), self.place))
            m, p = self.prior(mean, cov, post, post_cov)
            if gate <= 0:
                return m, p, post, post_cov, use
            now = self._inside(m, p, gate)
            if np.array_equal(now, use):
                return m, p, post, post_cov, use
            use = now
        return self._in_turn(mean, cov, gate)

    def determinants(self, post_cov: np.ndarray) -> np.ndarray:
        """Determinants of the covariances after each step: carried along by _in_turn, else taken from these."""
        return np.maximum(_det(post_cov), 0) if self.det is None else self.det

    def _inside(self, m: np.ndarray, p: np.ndarray, gate: float) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            return self.fixed & ~(((self.fix - m[0]) ** 2).sum(axis=0) / (p[0, 0] + self.fix_var) > gate)

    def _in_turn(self, mean: np.ndarray, cov: np.ndarray, gate: float):
        """The same step by step, all blocks abreast.

        The determinant of the covariance is a state of its own: as a difference of products it would be lost where steps lie far apart, and what the measurement leaves with it. All terms are sums of positive ones."""
        n = len(self.move)
        self.det = np.empty(n)
        m, p, post, post_cov, use = np.empty((2, 2, n)), np.empty((2, 2, n)), np.empty((2, 2, n)), np.empty((2, 2, n)), np.zeros(n, bool)
        start = np.cumsum(self.sizes) - self.sizes
        for i in range(int(self.sizes.max(initial=0))):
            lane = np.flatnonzero(self.sizes > i)
            at = start[lane] + i
            x, v, det = (mean[..., lane], cov[..., lane], np.maximum(_det(cov[..., lane]), 0)) if i == 0 else (post[..., at - 1], post_cov[..., at - 1], self.det[at - 1])
            d, q = self.move[at], self.noise[..., at]
            t = np.maximum(d, 1e-6)
            det = _spread(v, det, d, t, q[1, 1] / (t * t))[-1]
            x = np.stack([x[0] + d * x[1], x[1]])
            v = np.stack([v[0, 0] + 2 * d * v[0, 1] + d * d * v[1, 1] + q[0, 0], v[0, 1] + d * v[1, 1] + q[0, 1], v[1, 1] + q[1, 1]])
            v = v[[0, 1, 1, 2]].reshape(2, 2, -1)
            m[..., at], p[..., at] = x, v
            with np.errstate(invalid="ignore"):
                use[at] = self.fixed[at] & ~(((self.fix[:, at] - x[0]) ** 2).sum(axis=0) / (v[0, 0] + self.fix_var[at]) > gate)
            for k, own, z, var in ((0, use[at], self.fix[:, at], self.fix_var[at]), (1, self.timed[at], self.speed[:, at], self.speed_var[at])):
                total = v[k, k] + var
                gain = np.where(own, v[:, k] / total, 0.0)
                x = x + gain[:, None] * np.where(own, z - x[k], 0.0)[None]
                left = v * var / total
                left[1 - k, 1 - k] = (det + var * v[1 - k, 1 - k]) / total
                v, det = np.where(own, left, v), np.where(own, det * var / total, det)
            post[..., at], post_cov[..., at], self.det[at] = x, v, det
        return m, p, post, post_cov, use


def _det(cov: np.ndarray) -> np.ndarray:
    return cov[0, 0] * cov[1, 1] - cov[0, 1] * cov[1, 0]


def _spread(cov: np.ndarray, det: np.ndarray, move: np.ndarray, t: np.ndarray, q: np.ndarray | float) -> tuple[np.ndarray, ...]:
    """(u, x, y, determinant after the motion) of covariances with this determinant. Noise of a motion is one direction, (t t / 2, t), of variance q, which is (u, t) as seen from before it."""
    u = t * t / 2 - move * t
    x, y = q * (cov[0, 0] * t - cov[0, 1] * u), q * (cov[0, 1] * t - cov[1, 1] * u)
    return u, x, y, det + (t * x - u * y)


def _gains(cov: np.ndarray, det: np.ndarray, move: np.ndarray, t: np.ndarray, q: float) -> tuple[np.ndarray, np.ndarray]:
    """The smoother's gain over a motion, and the covariance that stays whatever is known after it; without differences of large products."""
    u, x, y, den = _spread(cov, det, move, t, q)
    gain = np.array([[(det + t * x) / den, -(move * det + t * t / 2 * x) / den], [t * y / den, (det - t * t / 2 * y) / den]])
    rest = q * (det / den)
    return gain, np.array([[rest * u * u, rest * u * t], [rest * u * t, rest * t * t]])


def _steps_of(batch: pa.RecordBatch, cfg: Tuning) -> Steps:
    """The steps of a batch of blocks; times are filled with the one before."""
    t, sizes = scan.flat(batch.column("t_s"))
    value = {c: scan.flat(batch.column(c))[0] for c in MEASURED}
    before = batch.column("time_before").fill_null(0.0).to_numpy(zero_copy_only=False)
    owner, (place, _) = np.repeat(np.arange(len(sizes)), sizes), scan.places(sizes)
    known = np.where(np.isnan(t), -1, np.arange(len(t)))
    last = np.maximum.accumulate(known) if len(t) else known
    own = last >= np.arange(len(t)) - place  # the last known time stands in this block
    filled = np.where(own, t[np.maximum(last, 0)], before[owner])
    earlier = np.where(place == 0, before[owner], np.roll(filled, 1))
    dt = np.maximum(filled - earlier, 0.0)
    opening = (place == 0) & batch.column("opening").to_numpy(zero_copy_only=False)[owner]
    d, q = np.maximum(np.where(opening, 0.0, dt), 1e-6), cfg.accel_std**2
    noise = np.array([[q * (d * d * d * d / 4), q * (d * d * d / 2)], [q * (d * d * d / 2), q * (d * d)]])
    std = lambda name, default: np.where(np.isnan(value[name]), default, value[name]) ** 2
    return Steps(sizes, np.where(opening, 0.0, dt), noise, np.stack([value["pos_e"], value["pos_n"]]), std("pos_std", cfg.fix_std_m), np.stack([value["vel_e"], value["vel_n"]]), std("vel_std", cfg.velocity_std))


def _starts(batch: pa.RecordBatch, cfg: Tuning) -> tuple[np.ndarray, np.ndarray]:
    """The state before the first step of each block's track."""
    n = batch.num_rows
    mean, cov = np.zeros((2, 2, n)), np.zeros((2, 2, n))
    mean[0] = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("first_e", "first_n")]
    cov[0, 0], cov[1, 1] = cfg.init_pos_std**2, cfg.init_vel_std**2
    return mean, cov


def _before(batch: pa.RecordBatch, cfg: Tuning) -> tuple[np.ndarray, np.ndarray]:
    """The state before each block: what the blocks before it make of the track's start."""
    mean, cov = _starts(batch, cfg)
    at = np.flatnonzero(batch.column("before").is_valid().to_numpy(zero_copy_only=False))
    if len(at):
        run = scan.unpacked(np.stack([np.array(batch.column("before")[int(i)].as_py()) for i in at]), FILTER)
        mean[..., at], cov[..., at] = after(mean[..., at], cov[..., at], run)
    return mean, cov


def _headed(blocks: DataFrame, key: str) -> DataFrame:
    """Blocks of tracks that have a fix, with what they need of their track: the time before them, whether they open it, its first fix, the move that follows them."""
    fix = F.filter(F.arrays_zip("pos_e", "pos_n"), lambda x: x["pos_e"].isNotNull() & x["pos_n"].isNotNull())
    known = F.filter("t_s", lambda t: t.isNotNull())
    heads = blocks.select("block", key, F.get(fix, F.lit(0)).alias("fix"), F.get(known, F.lit(0)).alias("first_t"), F.get(known, F.size(known) - 1).alias("last_t"), F.col("t_s")[0].alias("own_t"))
    w = Window.partitionBy(key).orderBy("block")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.last("last_t", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.first("first_t", ignorenulls=True).over(every), F.lit(0.0))
    heads = heads.withColumns({"time_before": before, "opening": F.row_number().over(w) == 1, "first_fix": F.first("fix", ignorenulls=True).over(every), "next_t": F.lead("own_t").over(w), "closing": F.lead("block").over(w).isNull()})
    at_end = F.coalesce("last_t", "time_before")
    heads = heads.where("first_fix is not null").select("block", "time_before", "opening", "closing", F.col("first_fix.pos_e").alias("first_e"), F.col("first_fix.pos_n").alias("first_n"), F.greatest(F.coalesce(F.col("next_t") - at_end, F.lit(0.0)), F.lit(0.0)).alias("next_move"))
    return scan.written(blocks.join(heads, "block"), "fusion-blocks")


def fuse_tracks(steps: DataFrame, key: str, cfg: Tuning = Tuning(), smooth: bool = True, block: int = scan.BLOCK, rounds: int = 1 << 30) -> DataFrame:
    """Every track of `key` fused in the order of its frames. Tracks without any fix give no rows.

    Filter and smoother are scans over blocks (operators.scan): no task holds a track. With a gate, blocks first count every fix in; a replay from the state before a block tells which fixes the gate
    takes, and the scan is repeated while that changes a block that others follow. What a block takes is settled once all before it are, so there are at most as many repeats as a track has blocks;
    the filter forgets where it started, so that few are needed."""
    kinds = dict(steps.dtypes)
    plain = steps.select(key, F.col("frame").cast("long").alias("frame"), *[(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) if c in kinds else F.lit(None).cast("double")).alias(c) for c in ("t_s", *MEASURED)])
    blocks = _headed(scan.blocked(plain, [key], [F.col("frame").asc(), F.col("t_s").asc_nulls_last()], ["frame", "t_s", *MEASURED], block), key)
    kind, gate = kinds[key], cfg.gate_chi2
    taken = blocks.withColumn("used", F.lit(None).cast("array<boolean>"))
    for _ in range(rounds):
        held = taken

        def summary(batches):
            for batch in batches:
                s = _steps_of(batch, cfg)
                use = _used(batch, s)
                whole = scan.reduced(compose, s.elements(use), s.sizes)
                yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column(key), scan.packed(whole)], names=["block", key, "element"])

        def replay(batches):
            for batch in batches:
                s, (mean, cov) = _steps_of(batch, cfg), _before(batch, cfg)
                use = _used(batch, s)
                _, _, post, post_cov, now = s.filtered(mean, cov, use, gate)
                changed = np.logical_or.reduceat(now != use, np.cumsum(s.sizes) - s.sizes)
                rows = [scan.lists(np.ascontiguousarray(np.concatenate([post.reshape(4, -1), post_cov.reshape(4, -1), s.determinants(post_cov)[None]]).T).ravel(), s.sizes * 9), scan.lists(now, s.sizes), pa.array(changed)]
                yield pa.RecordBatch.from_arrays([batch.column("block"), *rows], names=["block", "states", "now", "changed"])

        summaries = held.where(SEVERAL).mapInArrow(summary, f"block long, `{key}` {kind}, element array<double>")
        ready = held.join(scan.carried(summaries, [key], compose, FILTER), "block", "left")
        names = held.columns
        states = scan.written(ready.select(*names, "before").mapInArrow(replay, "block long, states array<double>, now array<boolean>, changed boolean"), "fusion-states")
        if gate <= 0 or states.join(blocks.select("block", "closing"), "block").where("changed and not closing").isEmpty():
            break
        taken = scan.written(blocks.join(states.select("block", F.col("now").alias("used")), "block"), "fusion-blocks")
    return _told(blocks, states, key, kind, cfg, smooth)


def _used(batch: pa.RecordBatch, s: Steps) -> np.ndarray:
    """The fixes that the round before let in; all in the first."""
    column = batch.column("used")
    if column.null_count == len(column):
        return s.fixed.copy()
    return column.flatten().to_numpy(zero_copy_only=False).astype(bool)


def _held(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States after each step, their covariances and determinants."""
    rows = scan.flat(batch.column("states"))[0].reshape(n, 9)
    return (*scan.unpacked(rows[:, :8], [(2, 2)] * 2), rows[:, 8])


def _back_in_turn(s: Steps, post: np.ndarray, ahead: np.ndarray, gain: np.ndarray, rest: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed states, step by step from the end of each block on, all blocks abreast; mean and cov are those after each block."""
    m, p = post.copy(), rest.copy()
    end = np.cumsum(s.sizes) - 1
    for i in range(int(s.sizes.max(initial=0))):
        lane = np.flatnonzero(s.sizes > i)
        at = end[lane] - i
        x, v = (mean[..., lane], cov[..., lane]) if i == 0 else (m[..., at + 1], p[..., at + 1])
        (a, b), (c, d) = gain[..., at]
        for k, (g, h) in enumerate(((a, b), (c, d))):
            m[k][:, at] = post[k][:, at] + g * (x[0] - ahead[0][:, at]) + h * (x[1] - ahead[1][:, at])
        h00, h01, h10, h11 = a * v[0, 0] + b * v[0, 1], a * v[0, 1] + b * v[1, 1], c * v[0, 0] + d * v[0, 1], c * v[0, 1] + d * v[1, 1]
        p[0, 0, at] = rest[0, 0, at] + h00 * a + h01 * b
        p[0, 1, at] = p[1, 0, at] = rest[0, 1, at] + h00 * c + h01 * d
        p[1, 1, at] = rest[1, 1, at] + h10 * c + h11 * d
    return m, p


def _told(blocks: DataFrame, states: DataFrame, key: str, kind: str, cfg: Tuning, smooth: bool) -> DataFrame:
    """A row for each step, from the states of its block; smoothed from the end of the track on."""
    rows = blocks.join(states, "block")

    def back(batch: pa.RecordBatch) -> tuple:
        s = _steps_of(batch, cfg)
        n = len(s.move)
        post, post_cov, det = _held(batch, n)
        # the gain of a step is over the motion of the next one, which for the last of a block comes with its head
        last = s.back == 0
        move = np.where(last, batch.column("next_move").to_numpy(zero_copy_only=False)[np.repeat(np.arange(len(s.sizes)), s.sizes)], np.roll(s.move, -1))
        end = last & batch.column("closing").to_numpy(zero_copy_only=False)[np.repeat(np.arange(len(s.sizes)), s.sizes)]
        gain, rest = _gains(post_cov, det, move, np.maximum(move, 1e-6), cfg.accel_std**2)
        gain[..., end], rest[..., end] = 0, post_cov[..., end]
        ahead = np.stack([post[0] + move * post[1], post[1]])
        return s, post, ahead, (gain, post - scan.mul(gain, ahead), rest)

    def summary(batches):
        for batch in batches:
            s, _, _, steps = back(batch)
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column(key), scan.packed(scan.reduced(compose_back, steps, s.sizes))], names=["block", key, "element"])

    def tell(batches):
        for batch in batches:
            if smooth:
                s, post, ahead, (gain, _, rest) = back(batch)
                owner = np.repeat(np.arange(len(s.sizes)), s.sizes)
                m, p = np.zeros((2, 2, len(s.sizes))), np.zeros((2, 2, len(s.sizes)))  # the smoothed state after each block; the end of a track needs none
                at = np.flatnonzero(batch.column("before").is_valid().to_numpy(zero_copy_only=False))
                if len(at):
                    _, m[..., at], p[..., at] = scan.unpacked(np.stack([np.array(batch.column("before")[int(i)].as_py()) for i in at]), SMOOTHER)
                mean, cov = _back_in_turn(s, post, ahead, gain, rest, m, p)
            else:
                s = _steps_of(batch, cfg)
                owner = np.repeat(np.arange(len(s.sizes)), s.sizes)
                mean, cov, _ = _held(batch, len(owner))
            used = batch.column("now").flatten()
            missed = pa.array(s.fixed & ~used.to_numpy(zero_copy_only=False).astype(bool))
            numbers = [mean[0, 0], mean[0, 1], mean[1, 0], mean[1, 1], np.sqrt(np.maximum(2 * cov[0, 0], 0))]
            made = [batch.column(key).take(pa.array(owner)), batch.column("frame").flatten(), batch.column("t_s").flatten(), *map(pa.array, numbers), used, missed]
            yield pa.RecordBatch.from_arrays(made, names=[key, *(c.split(" ")[0] for c in STATE.split(", "))])

    if smooth:
        rows = rows.join(scan.carried(rows.where(SEVERAL).mapInArrow(summary, f"block long, `{key}` {kind}, element array<double>"), [key], compose_back, SMOOTHER, from_end=True), "block", "left")
    return rows.mapInArrow(tell, f"`{key}` {kind}, {STATE}")


def locked_origin(scores: DataFrame, key: str) -> DataFrame:
    """(key, lat, lon): the mean of the locked estimates."""
    return scores.where(F.col("locked") & F.col("est_lat").isNotNull()).groupBy(key).agg(F.avg("est_lat").alias("lat"), F.avg("est_lon").alias("lon"))


def fuse_scores(scores: DataFrame, key: str, cfg: Tuning = Tuning(), smooth: bool = True, ref: tuple[float, float] | None = None) -> DataFrame:
    """Scores to fused places: locked estimates are fixes in the plane at ref (lat, lon), or at their mean; all frames come back. Groups without a lock give no rows."""
    lock = F.col("locked") & F.col("est_lat").isNotNull()
    origin = locked_origin(scores, key).withColumnsRenamed({"lat": "_rlat", "lon": "_rlon"})
    if ref:
        origin = origin.withColumns({"_rlat": F.lit(float(ref[0])), "_rlon": F.lit(float(ref[1]))})
    e, n = geo.to_local(F.col("est_lat"), F.col("est_lon"), F.col("_rlat"), F.col("_rlon"))
    rows = scores.join(origin, key)
    steps = rows.select(key, "frame", "t_s", F.when(lock, e).alias("pos_e"), F.when(lock, n).alias("pos_n"))
    fused = fuse_tracks(steps, key, cfg, smooth).join(origin, key)
    lat, lon = geo.from_local(F.col("east"), F.col("north"), F.col("_rlat"), F.col("_rlon"))
    return fused.select(key, "frame", "t_s", lat.alias("lat"), lon.alias("lon"), "pos_std_m", "fix_used", "fix_rejected")
