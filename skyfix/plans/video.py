"""A whole video: anchors by the best of several matchers, the frames between by chained links, errors against the truth track, a fused track."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfix.operators import fusion, metrics, search, trajectory


@dataclasses.dataclass(frozen=True)
class Flight:
    """anchors: locked frames with the matcher that won; poses: every frame that reaches an anchor; drift: their distance from the truth; fused: all of them smoothed."""

    anchors: DataFrame
    poses: DataFrame
    drift: DataFrame
    fused: DataFrame


def whole_video(located: DataFrame, links: DataFrame, truth: DataFrame, key: str, width: Column, height: Column, method: str = "model", least: int = 12, tuning: fusion.Tuning = fusion.Tuning()) -> Flight:
    """located: search results (key, pos, t_s, method, locked, n_inliers, est_lat, est_lon, h_to_ref, tile), some for a frame; links: (key, pos, h, n_inliers) from pos to pos + 1,
    null h where the match isn't trusted; truth: fixes (key, frame, lat, lon). pos is a frame's number in the sampled video, and truth's frames are counted alike."""
    frame = F.struct(key, "pos")
    tried = located.withColumn("_frame", frame)
    won = search.match_winner(tried.where((F.col("n_inliers") >= least) & F.col("h_to_ref").isNotNull()), "_frame", method).drop("_frame")
    anchors = won.select(key, F.col("pos").alias("anchor"), "h_to_ref", "tile")
    trusted = links.withColumn("h", trajectory.accepted(F.col("h"), F.col("h").isNotNull(), F.col("n_inliers"), least))
    ends = links.groupBy(key).agg((F.max("pos") + 1).alias("pos"))
    nodes = trusted.select(key, "pos", F.col("h").isNull().alias("is_break"), "n_inliers").unionByName(ends.select(key, "pos", F.lit(True).alias("is_break"), F.lit(0).cast(links.schema["n_inliers"].dataType).alias("n_inliers")))
    nodes = nodes.join(won.select(key, "pos", F.lit(True).alias("_won")), [key, "pos"], "left").withColumn("is_anchor", F.coalesce("_won", F.lit(False))).drop("_won")
    chain = trajectory.nearest_anchor(nodes, key)
    poses = trajectory.chain_poses(trusted.where("h is not null").select(key, "pos", "h"), chain, anchors, key, width, height)
    drift = trajectory.drift(poses, truth, key)
    times = located.groupBy(key, "pos").agg(F.min("t_s").alias("t_s"))
    scores = poses.join(times, [key, "pos"], "left").select(key, F.col("pos").alias("frame"), "t_s", F.col("lat").alias("est_lat"), F.col("lon").alias("est_lon"), F.lit(True).alias("locked"))
    return Flight(won, poses, drift, fusion.fuse_scores(scores, key, tuning))


def report(flight: Flight, key: str, method: str = "model") -> DataFrame:
    """By video: frames with a pose, anchors, how often each matcher won, error statistics."""
    wins = flight.anchors.groupBy(key, method).agg(F.count(F.lit(1)).alias("_n")).groupBy(key).agg(F.sum("_n").alias("n_anchors"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(method, "_n")))).alias("winners"))
    return metrics.error_stats(flight.drift, key).join(wins, key, "left")
