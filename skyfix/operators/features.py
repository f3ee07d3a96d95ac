"""Corners with oriented binary descriptors, and their two nearest neighbours, over tables of images.

An image is described once, whatever number of pairs it stands in. Pairs of images are matched through blocks of descriptors, so a pair with many is several tasks.
Descriptors are 256 comparisons of a smoothed patch, turned by the direction of its centre of mass; sizes come from a pyramid of reduced images.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyfix.operators.matchers import LEAST_INLIERS, THRESHOLD, Match, Matcher, area_shares, estimate_homography, grey, register

#: Pyramid: each level is smaller by this factor; comparisons of a descriptor, radius of its patch, and of the mass that gives its direction.
LEVELS, SHRINK, TESTS, REACH, DISC = 7, 1.25, 256, 13, 15
#: Cells of an edge of the grid over which corners are spread; share of the strongest response below which there is no corner.
CELLS, LEAST_RESPONSE = 8, 1e-3
#: Corners of an image, and the share of the second distance that the first must stay below.
MOST, RATIO = 2000, 0.8
SCHEMA = "feature long, x double, y double, size double, angle double, response double, bits binary"


@functools.lru_cache(maxsize=1)
def pattern() -> np.ndarray:
    """The pairs of places that are compared, by rule: normal around the centre, the same for ever."""
    points = np.random.default_rng(20).normal(0, REACH / 2, size=(8 * TESTS, 4))
    inside = np.hypot(points[:, ::2], points[:, 1::2]).max(axis=1) <= REACH
    return points[inside][:TESTS]


def box(a: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of radius r, edges repeated."""
    for axis in (0, 1):
        width = [(0, 0), (0, 0)]
        width[axis] = (r + 1, r)
        c = np.cumsum(np.pad(a, width, mode="edge"), axis=axis)
        n = a.shape[axis]
        a = (np.take(c, np.arange(2 * r + 1, 2 * r + 1 + n), axis) - np.take(c, np.arange(n), axis)) / (2 * r + 1)
    return a


def responses(g: np.ndarray) -> np.ndarray:
    """The smaller eigenvalue of the gradients' second moments about each pixel."""
    dy, dx = np.gradient(g)
    a, b, c = box(dx * dx, 2), box(dx * dy, 2), box(dy * dy, 2)
    return (a + c) / 2 - np.hypot((a - c) / 2, b)


def corners(g: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, response) of local maxima, the strongest of each grid cell."""
    margin = int(np.ceil(REACH)) + 5
    r = responses(g)
    if min(r.shape) <= 2 * margin:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    top = r.copy()
    for axis in (0, 1):  # the maximum over 5 x 5
        for s in (-2, -1, 1, 2):
            top = np.maximum(top, np.roll(r if axis == 0 else rows, s, axis))
        rows = top.copy()
    y, x = np.nonzero((r >= top) & (r > LEAST_RESPONSE * max(float(r.max()), 1e-9)))
    ok = (x >= margin) & (y >= margin) & (x < r.shape[1] - margin) & (y < r.shape[0] - margin)
    x, y = x[ok], y[ok]
    strength = r[y, x]
    cell = y * CELLS // r.shape[0] * CELLS + x * CELLS // r.shape[1]
    order = np.lexsort((x, y, -strength, cell))
    rank = np.arange(len(order)) - np.searchsorted(cell[order], cell[order])
    keep = order[rank < max(1, -(-most // CELLS**2))]
    return x[keep], y[keep], strength[keep]


def _described(g: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(direction, bits) of patches."""
    disc = np.stack(np.meshgrid(np.arange(-DISC, DISC + 1), np.arange(-DISC, DISC + 1)), -1).reshape(-1, 2)
    disc = disc[(disc**2).sum(axis=1) <= DISC**2]
    mass = g[y[:, None] + disc[None, :, 1], x[:, None] + disc[None, :, 0]]
    angle = np.arctan2(mass @ disc[:, 1], mass @ disc[:, 0])
    c, s, p = np.cos(angle)[:, None], np.sin(angle)[:, None], pattern()
    smooth = box(box(g, 2), 1)
    at = lambda u, v: smooth[y[:, None] + np.rint(s * u + c * v).astype(int), x[:, None] + np.rint(c * u - s * v).astype(int)]
    return angle, np.packbits(at(p[:, 0], p[:, 1]) < at(p[:, 2], p[:, 3]), axis=1)


@dataclasses.dataclass
class Features:
    x: np.ndarray
    y: np.ndarray
    size: np.ndarray
    angle: np.ndarray
    response: np.ndarray
    bits: np.ndarray

    def __len__(self) -> int:
        return len(self.x)


def describe(image: np.ndarray, most: int = MOST) -> Features:
    """Corners of an image over all levels, the strongest first, `most` at most."""
    g = grey(image)
    parts, height, width, level = [], *g.shape, g
    for k in range(LEVELS):
        if k:
            h, w = (max(1, round(n / SHRINK**k)) for n in (height, width))
            level = area_shares(height, h) @ g @ area_shares(width, w).T
        x, y, r = corners(level, max(1, round(most / SHRINK ** (2 * k))))
        if not len(x):
            continue
        angle, bits = _described(level, x, y)
        fx, fy = width / level.shape[1], height / level.shape[0]
        parts.append(Features((x + 0.5) * fx - 0.5, (y + 0.5) * fy - 0.5, np.full(len(x), (fx + fy) / 2), angle, r, bits))
    if not parts:
        return Features(*(np.zeros(0) for _ in range(5)), np.zeros((0, TESTS // 8), np.uint8))
    f = Features(*(np.concatenate([getattr(p, n) for p in parts]) for n in ("x", "y", "size", "angle", "response", "bits")))
    keep = np.lexsort((f.x, f.y, f.size, -f.response))[:most]
    return Features(*(getattr(f, n)[keep] for n in ("x", "y", "size", "angle", "response", "bits")))


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows of bytes (a multiple of eight of them)."""
    u, v = (np.ascontiguousarray(m).view(np.uint64) for m in (a, b))
    out = np.zeros((len(u), len(v)), np.int64)
    for k in range(u.shape[1]):
        out += np.bitwise_count(u[:, k, None] ^ v[None, :, k])
    return out


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows of numbers; those that can be a row's two nearest are exact sums of squares."""
    near = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)
    out = np.sqrt(np.maximum(near, 0))
    if b.shape[0]:
        best = np.argpartition(near, min(3, b.shape[0] - 1), axis=1)[:, :4]
        np.put_along_axis(out, best, np.sqrt(((a[:, None, :] - b[best]) ** 2).sum(axis=2)), axis=1)
    return out


def nearest_two(d: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance, id) of the two nearest of each row of distances, of equal ones the smallest ids; ids rise. One column gives one."""
    order = np.argsort(d, axis=1, kind="stable")[:, :2]
    return np.take_along_axis(d, order, axis=1), ids[order]


def two_nearest(queries: DataFrame, train: DataFrame, key: str, metric: str = "hamming", block: int = 1024) -> DataFrame:
    """(key, query_id, train_id, distance, second): the nearest descriptor of the train side for each query (id, vector), and the distance of the second; ties go to the smaller id.

    Both sides are dealt to blocks within their key; each pair of blocks is a task's unit and gives two candidates a query, of which the two nearest count. Keys with fewer than two train descriptors give nothing."""
    kind, idk = dict(queries.dtypes)[key], dict(train.dtypes)["id"]
    parts = lambda df, name: df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    deals = parts(queries, "q_parts").join(parts(train, "t_parts"), key)
    spread = lambda c, n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(c)
    own = lambda c, n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int").alias(c)
    q = queries.select(key, "id", "vector").join(deals, key).select(key, own("_q", "q_parts"), spread("_t", "t_parts"), "id", "vector")
    t = train.select(key, "id", "vector").join(deals, key).select(F.col(key).alias("_key"), spread("_q2", "q_parts"), own("_t2", "t_parts"), F.col("id").alias("_id"), F.col("vector").alias("_vector"))

    def matrix(column) -> np.ndarray:
        rows = column.to_pylist()
        return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1) if metric == "hamming" else np.array(rows, float)

    def run(a, b):
        if not a.num_rows or not b.num_rows:
            return pa.table({key: a.column(key).slice(0, 0), "query_id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64()), "train_id": pa.array([], pa.int64())})
        ids = b.column("_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        m, made = matrix(b.column("_vector"))[order], []
        u = matrix(a.column("vector"))
        for i in range(0, len(u), 256):
            d, near = nearest_two((hamming if metric == "hamming" else euclidean)(u[i : i + 256], m), ids[order])
            made.append((np.repeat(np.arange(i, i + len(d)), d.shape[1]), d.ravel(), near.ravel()))
        at, d, near = (np.concatenate(x) for x in zip(*made))
        return pa.table({key: a.column(key).take(pa.array(at)), "query_id": a.column("id").take(pa.array(at)), "distance": d.astype(float), "train_id": near})

    q, t = q.repartition(key, "_q", "_t"), t.repartition("_key", "_q2", "_t2")
    found = q.groupBy(key, "_q", "_t").cogroup(t.groupBy("_key", "_q2", "_t2")).applyInArrow(run, f"`{key}` {kind}, query_id {dict(queries.dtypes)['id']}, distance double, train_id {idk}")
    w = Window.partitionBy(key, "query_id").orderBy("distance", "train_id")
    ranked = found.withColumns({"second": F.lead("distance").over(w), "_rank": F.row_number().over(w)})
    return ranked.where("_rank = 1 and second is not null").select(key, "query_id", "train_id", "distance", "second")


def ratio_test(queries: DataFrame, train: DataFrame, key: str, ratio: float = 0.75, block: int = 1024, metric: str = "euclidean") -> DataFrame:
    """By image pair, query descriptors (id, vector) whose nearest train descriptor is clearly nearer than the second: query_id, train_id, distance."""
    near = two_nearest(queries, train, key, metric, block)
    return near.where(F.col("distance") < ratio * F.col("second")).select(key, "query_id", "train_id", "distance")


def feature_table(images: DataFrame, key: str, most: int = MOST, image: str = "image") -> DataFrame:
    """(key, feature, x, y, size, angle, response, bits) of every image (key, image struct<data, height, width>); an image that can't be read has none."""
    from skyfix.operators.localize import image_of

    kind = dict(images.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, a in zip(pdf[key], pdf[image]):
                try:
                    f = describe(image_of(a["data"], a["height"], a["width"]), most)
                except (TypeError, ValueError):
                    continue
                if len(f):
                    yield pd.DataFrame({key: [k] * len(f), "feature": np.arange(len(f)), "x": f.x, "y": f.y, "size": f.size, "angle": f.angle, "response": f.response, "bits": [b.tobytes() for b in f.bits]})

    return images.select(key, image).mapInPandas(run, f"`{key}` {kind}, {SCHEMA}")


def correspondences(features: DataFrame, pairs: DataFrame, key: str, image: str, ratio: float = RATIO, block: int = 1024) -> DataFrame:
    """(key, ordinal, sx, sy, dx, dy) of image pairs (key, frame, tile: keys of images in `features`), for matchers.homographies."""
    side = lambda c: pairs.select(key, F.col(c).alias(image)).join(features, image)
    frame, tile = (side(c).select(key, F.col("feature").alias("id"), F.col("bits").alias("vector"), "x", "y") for c in ("frame", "tile"))
    near = ratio_test(frame.select(key, "id", "vector"), tile.select(key, "id", "vector"), key, ratio, block, "hamming")
    place: list[Column] = [F.col("x"), F.col("y")]
    out = near.join(frame.select(key, F.col("id").alias("query_id"), *[c.alias(n) for c, n in zip(place, ("sx", "sy"))]), [key, "query_id"])
    out = out.join(tile.select(key, F.col("id").alias("train_id"), *[c.alias(n) for c, n in zip(place, ("dx", "dy"))]), [key, "train_id"])
    return out.select(key, F.col("query_id").alias("ordinal"), "sx", "sy", "dx", "dy")


class FeatureMatcher(Matcher):
    """Corners, ratio test and robust homography of one pair of images, in the worker."""

    def __init__(self, most: int = MOST, ratio: float = RATIO, threshold: float = THRESHOLD, confidence: float = 0.999, least: int = LEAST_INLIERS):
        self.most, self.ratio, self.threshold, self.confidence, self.least = most, ratio, threshold, confidence, least

    def match(self, frame: np.ndarray, tile: np.ndarray) -> Match:
        a, b = describe(frame, self.most), describe(tile, self.most)
        if len(a) < 4 or len(b) < 4:
            return Match(np.zeros((0, 2)), np.zeros((0, 2)))
        good = []
        for i in range(0, len(a), 512):
            d, near = nearest_two(hamming(a.bits[i : i + 512], b.bits), np.arange(len(b)))
            ok = np.flatnonzero(d[:, 0] < self.ratio * d[:, 1])
            good.append(np.stack([ok + i, near[ok, 0]]))
        i, j = np.concatenate(good, axis=1)
        src, dst = np.stack([a.x[i], a.y[i]], 1), np.stack([b.x[j], b.y[j]], 1)
        h, inside = estimate_homography(src, dst, self.threshold, self.confidence, self.least)
        return Match(src, dst, h, inside)


register("classical", FeatureMatcher)
