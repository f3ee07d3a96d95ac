"""Tracks: path length, rigid and similarity fits, relative tracks, anchoring, chains of links."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyfix.functions import camera, geo
from skyfix.operators import scan


def path_length(points: DataFrame, key: str, order: str, x: str, y: str, name: str = "length_m") -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    step = F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))
    return points.select(key, step.alias("_step")).groupBy(key).agg(F.coalesce(F.sum("_step"), F.lit(0.0)).alias(name))


def _sums(pairs: DataFrame, key: str) -> DataFrame:
    """Centred sums of (sx, sy) against (dx, dy)."""
    means = pairs.groupBy(key).agg(*[F.avg(c).alias(f"m_{c}") for c in ("sx", "sy", "dx", "dy")], F.count(F.lit(1)).alias("n"))
    c = {k: F.col(k) - F.col(f"m_{k}") for k in ("sx", "sy", "dx", "dy")}
    rows = pairs.join(means, key).select(key, "n", *[f"m_{k}" for k in c], (c["sx"] * c["dx"] + c["sy"] * c["dy"]).alias("_dot"), (c["sx"] * c["dy"] - c["sy"] * c["dx"]).alias("_cross"), (c["sx"] * c["sx"] + c["sy"] * c["sy"]).alias("_var"))
    return rows.groupBy(key, "n", *[f"m_{k}" for k in c]).agg(F.sum("_dot").alias("dot"), F.sum("_cross").alias("cross"), F.sum("_var").alias("var"))


def fit_rigid(pairs: DataFrame, key: str) -> DataFrame:
    """Proper rotation and translation of (sx, sy) onto (dx, dy) in least squares, from sums: cos, sin, tx, ty, rot_deg."""
    theta = F.atan2(F.col("cross"), F.col("dot"))
    rows = _sums(pairs, key).withColumns({"c": F.cos(theta), "s": F.sin(theta), "rot_deg": F.degrees(theta)})
    return rows.select(key, "n", "c", "s", "rot_deg", (F.col("m_dx") - (F.col("c") * F.col("m_sx") - F.col("s") * F.col("m_sy"))).alias("tx"), (F.col("m_dy") - (F.col("s") * F.col("m_sx") + F.col("c") * F.col("m_sy"))).alias("ty"))


def fit_similarity(pairs: DataFrame, key: str, least: int = 2) -> DataFrame:
    """The same with a scale (1 where the source has no spread); keys of fewer points than `least` are left out."""
    theta = F.atan2(F.col("cross"), F.col("dot"))
    scale = F.when(F.col("var") / F.col("n") > 1e-12, F.hypot(F.col("dot"), F.col("cross")) / F.col("var")).otherwise(F.lit(1.0))
    rows = _sums(pairs, key).where(F.col("n") >= least).withColumns({"scale": scale, "c": F.cos(theta), "s": F.sin(theta), "rot_deg": F.degrees(theta)})
    place = lambda a, b: F.col("scale") * (a * F.col("m_sx") + b * F.col("m_sy"))
    return rows.select(key, "n", "scale", "c", "s", "rot_deg", (F.col("m_dx") - place(F.col("c"), -F.col("s"))).alias("tx"), (F.col("m_dy") - place(F.col("s"), F.col("c"))).alias("ty"))


def score(track: DataFrame, key: str, order: str = "frame") -> DataFrame:
    """Estimates against truth: errors raw and after a rigid fit, path lengths and their ratio (null for a truth of no length)."""
    ref = track.groupBy(key).agg(F.avg("gt_lat").alias("_rlat"), F.avg("gt_lon").alias("_rlon"))
    e = geo.to_local(F.col("est_lat"), F.col("est_lon"), F.col("_rlat"), F.col("_rlon"))
    g = geo.to_local(F.col("gt_lat"), F.col("gt_lon"), F.col("_rlat"), F.col("_rlon"))
    pairs = track.join(ref, key).select(key, order, e[0].alias("sx"), e[1].alias("sy"), g[0].alias("dx"), g[1].alias("dy"))
    fit = fit_rigid(pairs, key)
    raw = F.hypot(F.col("sx") - F.col("dx"), F.col("sy") - F.col("dy"))
    px, py = F.col("c") * F.col("sx") - F.col("s") * F.col("sy") + F.col("tx"), F.col("s") * F.col("sx") + F.col("c") * F.col("sy") + F.col("ty")
    left = F.hypot(px - F.col("dx"), py - F.col("dy"))
    errors = pairs.join(fit.drop("n"), key).select(key, "rot_deg", raw.alias("_raw"), left.alias("_left")).groupBy(key, "rot_deg").agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("_raw") * F.col("_raw"))).alias("ate_raw_m"), F.sqrt(F.avg(F.col("_left") * F.col("_left"))).alias("ate_aligned_m"), F.avg("_left").alias("mean_aligned_m"), F.median("_left").alias("median_aligned_m"), F.max("_left").alias("worst_aligned_m")
    )
    lengths = path_length(pairs, key, order, "sx", "sy", "est_length_m").join(path_length(pairs, key, order, "dx", "dy", "gt_length_m"), key)
    return errors.join(lengths, key).withColumn("length_ratio", F.when(F.col("gt_length_m") > 0, F.col("est_length_m") / F.col("gt_length_m")))


def relative_track(links: DataFrame, key: str) -> DataFrame:
    """Links (idx_from, idx_to, theta, tx, ty, is_break) to positions from the first frame on, up to the first break: prefix sums only."""
    w = Window.partitionBy(key).orderBy("idx_from")
    whole = w.rowsBetween(Window.unboundedPreceding, 0)
    alive = links.withColumn("_broken", F.sum(F.col("is_break").cast("int")).over(whole)).where("_broken = 0")
    turned = alive.withColumn("_heading", F.coalesce(F.sum("theta").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    c, s = F.cos("_heading"), F.sin("_heading")
    steps = turned.withColumns({"_sx": c * F.col("tx") - s * F.col("ty"), "_sy": s * F.col("tx") + c * F.col("ty")})
    placed = steps.select(key, F.col("idx_to").alias("frame"), F.sum("_sx").over(whole).alias("x"), F.sum("_sy").over(whole).alias("y"))
    first = links.groupBy(key).agg(F.min("idx_from").alias("frame")).select(key, "frame", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return placed.unionByName(first)


def anchor_track(relative: DataFrame, controls: DataFrame, key: str) -> DataFrame:
    """A relative track placed by at least two control points (frame, lat, lon) on it; tracks with fewer are left out."""
    used = relative.join(controls, [key, "frame"])
    ref = used.groupBy(key).agg(F.avg("lat").alias("_rlat"), F.avg("lon").alias("_rlon"))
    e, n = geo.to_local(F.col("lat"), F.col("lon"), F.col("_rlat"), F.col("_rlon"))
    fit = fit_similarity(used.join(ref, key).select(key, F.col("x").alias("sx"), F.col("y").alias("sy"), e.alias("dx"), n.alias("dy")), key)
    rows = relative.join(fit.join(ref, key), key)
    east = F.col("scale") * (F.col("c") * F.col("x") - F.col("s") * F.col("y")) + F.col("tx")
    north = F.col("scale") * (F.col("s") * F.col("x") + F.col("c") * F.col("y")) + F.col("ty")
    lat, lon = geo.from_local(east, north, F.col("_rlat"), F.col("_rlon"))
    return rows.select(key, "frame", lat.alias("lat"), lon.alias("lon"))


def accepted(h: Column, ok: Column, n_inliers: Column, least: int = 12) -> Column:
    """A link's motion, null where it isn't trusted; the link itself stays."""
    return F.when(ok & (n_inliers >= least), h)


def consecutive(frames: DataFrame, key: str, order: str = "frame") -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return frames.withColumn("next_frame", F.lead(order).over(w)).where("next_frame is not null")


def nearest_anchor(nodes: DataFrame, key: str) -> DataFrame:
    """Nodes (pos, is_anchor, and of the link to the next node: is_break, n_inliers) with hops, anchor and weakest link to it.

    Breaks part a track into islands; the last anchor before and the first after a node are found by windows within its island, and
    the weakest link to either by running minima from anchor to anchor. Fewer hops win, then the earlier anchor; nodes without any are left out."""
    w = Window.partitionBy(key).orderBy("pos")
    rows = nodes.withColumn("_cut", F.coalesce(F.lag(F.col("is_break").cast("int")).over(w), F.lit(0)))
    rows = rows.withColumn("_in", F.lag("n_inliers").over(w)).withColumn("_island", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    up = Window.partitionBy(key, "_island").orderBy("pos")
    anchor = F.when(F.col("is_anchor"), F.col("pos"))
    rows = rows.withColumn("_prev", F.last(anchor, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_next", F.first(anchor, ignorenulls=True).over(up.rowsBetween(0, Window.unboundedFollowing)))
    ahead = Window.partitionBy(key, "_island", "_prev").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(key, "_island", "_next").orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("_weak_prev", F.min(F.when(~F.col("is_anchor"), F.col("_in"))).over(ahead))
    rows = rows.withColumn("_weak_next", F.min(F.when(~F.col("is_anchor"), F.col("n_inliers"))).over(behind))
    left, right = F.col("pos") - F.col("_prev"), F.col("_next") - F.col("pos")
    use_left = F.col("_prev").isNotNull() & (F.col("_next").isNull() | (left <= right))
    pick = lambda a, b: F.when(use_left, a).otherwise(b)
    hops = pick(left, right)
    out = rows.where(F.col("_prev").isNotNull() | F.col("_next").isNotNull())
    return out.select(key, "pos", hops.alias("hops"), pick(F.col("_prev"), F.col("_next")).alias("anchor"), F.when(hops == 0, F.lit(0)).otherwise(pick(F.col("_weak_prev"), F.col("_weak_next"))).alias("weakest"))


def _chain(a: scan.Element, b: scan.Element) -> scan.Element:
    """Motions a and then b; scaled, as a homography has no scale, so that long products stay in range."""
    m = scan.mul(a[0], b[0])
    return (m / np.abs(m).max(axis=(0, 1)),)


def chain_homographies(links: DataFrame, chain: DataFrame, anchors: DataFrame, key: str, block: int = scan.BLOCK) -> DataFrame:
    """The homography of every chained node to its anchor's reference: the links between them multiplied in order and normalised;
    forward in time by inverse links. Links (pos: from pos to pos + 1, h), anchors (pos as `anchor`, h_to_ref).

    Each node brings the one link that leads on from its neighbour nearer to the anchor; an anchor's side is a scan of products over blocks (operators.scan), so a side of any length
    costs each task its blocks. From a link without an inverse on, a side's homographies hold nulls."""
    forward = F.col("pos") > F.col("anchor")
    nodes = chain.where("hops > 0").select(key, "pos", "anchor", "hops", F.when(forward, F.col("pos") - 1).otherwise(F.col("pos")).alias("_at"))
    step = nodes.join(links.select(key, F.col("pos").alias("_at"), "h"), [key, "_at"])
    on = F.when(forward, camera.inverse(F.col("h"))).otherwise(F.col("h"))
    names = [f"h{i}" for i in range(9)]
    rows = step.select(key, "anchor", forward.alias("forward"), "pos", "hops", on.alias("h")).select(key, "anchor", "forward", "pos", "hops", *[F.col("h")[i].alias(n) for i, n in enumerate(names)])
    side, kinds = [key, "anchor", "forward"], dict(rows.dtypes)
    blocks = scan.blocked(rows, side, [F.col("hops")], ["pos", "hops", *names], block)

    def products(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        h = [scan.flat(batch.column(n)) for n in names]
        sizes = h[0][1]
        return scan.inclusive(_chain, (np.stack([v for v, _ in h]).reshape(3, 3, -1),), scan.places(sizes)[0])[0], sizes

    def summary(batches):
        for batch in batches:
            m, sizes = products(batch)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("block", *side)] + [scan.packed((m[..., np.cumsum(sizes) - 1],))], names=["block", *side, "element"])

    def replay(batches):
        for batch in batches:
            m, sizes = products(batch)
            start = np.array([np.eye(3).ravel() if x is None else x for x in batch.column("before").to_pylist()]).reshape(-1, 9)
            ref = np.array([x if x is not None else [math.nan] * 9 for x in batch.column("h_to_ref").to_pylist()], float).reshape(-1, 9)
            first = scan.mul(ref.T.reshape(3, 3, -1), start.T.reshape(3, 3, -1))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            whole = scan.mul(first[..., owner], m)
            with np.errstate(divide="ignore", invalid="ignore"):
                whole = (whole / whole[2, 2]).reshape(9, -1).T
            h = pa.array(np.ascontiguousarray(whole).ravel(), mask=~np.isfinite(whole).ravel())
            at = pa.array(owner)
            made = [batch.column(key).take(at), batch.column("pos").flatten(), batch.column("anchor").take(at), batch.column("hops").flatten(), pa.ListArray.from_arrays(pa.array(np.arange(0, len(whole) * 9 + 1, 9), pa.int32()), h)]
            yield pa.RecordBatch.from_arrays(made, names=[key, "pos", "anchor", "hops", "h"])

    several = blocks.join(blocks.groupBy(*side).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), side, "left_semi")  # a side of one block needs no scan
    before = scan.carried(several.mapInArrow(summary, "block long, " + ", ".join(f"`{c}` {kinds[c]}" for c in side) + ", element array<double>"), side, _chain, [(3, 3)])
    ready = blocks.join(before, "block", "left").join(anchors.select(key, "anchor", "h_to_ref"), [key, "anchor"])
    chained = ready.mapInArrow(replay, f"`{key}` {kinds[key]}, pos {kinds['pos']}, anchor {kinds['anchor']}, hops {kinds['hops']}, h array<double>")
    own = chain.where("hops = 0").join(anchors.select(key, "anchor", "h_to_ref"), [key, "anchor"]).select(key, "pos", "anchor", "hops", camera.normalised(F.col("h_to_ref")).alias("h"))
    return own.unionByName(chained)


def chain_poses(links: DataFrame, chain: DataFrame, anchors: DataFrame, key: str, width: Column, height: Column) -> DataFrame:
    """Chained nodes with their pose on their anchor's tile: lat, lon, yaw_deg, ground_m_per_px, and as n_inliers the weakest link (0 at an anchor).

    Anchors also bring `tile` (see functions.geo); chain also has `weakest`, as nearest_anchor gives it."""
    h = chain_homographies(links, chain, anchors, key).join(chain.select(key, "pos", "weakest"), [key, "pos"]).join(anchors.select(key, "anchor", "tile"), [key, "anchor"])
    seen = camera.pose(F.col("h"), width, height)
    return h.select(key, "pos", "anchor", "hops", "h", *[c.alias(n) for n, c in seen.items()], F.col("weakest").alias("n_inliers"))


def drift(poses: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Distance of chained poses (pos, lat, lon) from the truth of nearest frame, by hops from their anchor."""
    from skyfix.operators import asof

    rows = asof.nearest(poses.withColumnRenamed("pos", "frame"), truth, key).where("fix is not null")
    return rows.withColumn("err_m", geo.haversine(F.col("fix.lat"), F.col("fix.lon"), F.col("lat"), F.col("lon")))
