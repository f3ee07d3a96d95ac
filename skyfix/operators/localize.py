"""Matching as a Spark operator: cells of a search, pairs of frames. A matcher runs in the Python worker, where it is made once."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfix.functions import camera, geo
from skyfix.operators import scan, search
from skyfix.operators.matchers import LEAST_INLIERS, Matcher
from skyfix.sources import store


def image_of(data: bytes, height: int, width: int) -> np.ndarray:
    """Raw 8-bit samples as an image, grey or of three channels."""
    a = np.frombuffer(data, np.uint8)
    return a.reshape(height, width) if len(a) == height * width else a.reshape(height, width, 3)


def match_pairs(pairs: DataFrame, make: Callable[[], Matcher]) -> DataFrame:
    """Rows with frame_image and tile_image (struct<data, height, width>) get h, n_matches, n_inliers and the error, if matching raised one.

    An image that can't be matched leaves its row without a homography; a missing back-end (ImportError) ends the job."""
    kept = [c for c in pairs.columns if c not in ("frame_image", "tile_image")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = make()
        for pdf in batches:
            out = []
            for a, b in zip(pdf["frame_image"], pdf["tile_image"]):
                try:
                    m = matcher.match(image_of(a["data"], a["height"], a["width"]), image_of(b["data"], b["height"], b["width"]))
                    out.append((None if m.homography is None else np.asarray(m.homography, float).ravel().tolist(), len(m.src), m.n_inliers, None))
                except ImportError:
                    raise
                except Exception as e:
                    out.append((None, 0, 0, f"{type(e).__name__}: {e}"[:200]))
            yield pd.concat([pdf[kept].reset_index(drop=True), pd.DataFrame(out, columns=["h", "n_matches", "n_inliers", "error"])], axis=1)

    schema = ", ".join(f"`{c}` {t}" for c, t in pairs.select(*kept).dtypes)
    return pairs.mapInPandas(run, f"{schema}, h array<double>, n_matches long, n_inliers long, error string")


#: What a pose tells of a cell.
POSED = {"est_lat": "lat", "est_lon": "lon", "yaw_deg": "yaw_deg", "ground_m_per_px": "ground_m_per_px"}
TILTED = ("tilt_deg", "altitude_m", "tilt_corrected")


def search_cells(cells: DataFrame, make: Callable[[], Matcher]) -> DataFrame:
    """Candidates of a search: cells (with frame_image, tile_image, tile) matched and posed. Without a homography a cell has no pose and counts 0 inliers.

    Where cells bring `intrinsics` (3 x 3, null if unknown), places are those under the camera and not those in the frame's centre, with tilt_deg, altitude_m and tilt_corrected."""
    rows = match_pairs(cells.withColumns({"_w": F.col("frame_image.width").cast("double"), "_h": F.col("frame_image.height").cast("double")}), make)
    nadir = "intrinsics" in cells.columns
    pose = camera.nadir_pose(F.col("h"), F.col("_w"), F.col("_h"), F.col("intrinsics")) if nadir else camera.pose(F.col("h"), F.col("_w"), F.col("_h"))
    posed = F.col("h").isNotNull()
    told = POSED | ({c: c for c in TILTED} if nadir else {})
    out = rows.withColumns({"has_pose": posed, "n_inliers": F.when(posed, F.col("n_inliers")).otherwise(F.lit(0))} | {n: F.when(posed, pose[c]) for n, c in told.items()})
    return out.drop("_w", "_h")


@dataclasses.dataclass(frozen=True)
class Search:
    """How a frame is searched: the grid about its prior, the gates, and whether locks are refined."""

    radius_m: float = camera.DEFAULT_SEARCH["radius_m"]
    step_m: float = camera.DEFAULT_SEARCH["grid_step_m"]
    scales_m: tuple[float, ...] = camera.DEFAULT_SEARCH["scales_m"]
    least: int = 20
    ratio: float = 1.0
    refine: bool = True


def _candidates(cells: DataFrame, frames: DataFrame, key: list[str], tiles: Callable[[DataFrame], DataFrame], make: Callable[[], Matcher]) -> DataFrame:
    x, y = geo.to_mercator(F.col("lon"), F.col("lat"))
    shown = tiles(cells).join(frames.select(*key, "frame_image", *[c for c in ("intrinsics",) if c in frames.columns]), key)
    return search_cells(shown, make).withColumns({"x_m": x, "y_m": y}).drop("tile", "intrinsics", "h", "n_matches", "error")


def validate(frames: DataFrame, key: list[str], tiles: Callable[[DataFrame], DataFrame], make: Callable[[], Matcher], how: Search = Search()) -> DataFrame:
    """Frames (key, frame_image, prior_lat, prior_lon, and if known intrinsics, gt_lat, gt_lon) searched from coarse to fine and scored: a row for each frame, found or not.

    tiles adds tile and tile_image to cells (key, lat, lon, span_m). The coarse pass matches the grid and gates its best cell against the strongest one apart from it; the cells of the fine pass lie about
    the locks, and its best counts unless it has fewer inliers. Candidates are written once between the passes, so that no image is matched twice."""
    priors = frames.select(*key, "prior_lat", "prior_lon")
    cells = search.candidates(search.grid_centres(priors, F.lit(float(how.radius_m)), F.lit(float(how.step_m))), list(how.scales_m)).drop("prior_lat", "prior_lon")
    coarse = scan.written(_candidates(cells, frames, key, tiles, make), "coarse")
    gated = search.lock_gate(coarse, F.lit(1.5 * how.step_m), how.least, how.ratio, *key)
    told = [*POSED, *[c for c in TILTED if c in coarse.columns]]
    rows = gated.select(*key, "n_inliers", "margin_ratio", "locked", F.lit("coarse").alias("pass"), "lat", "lon", "span_m", "scan_idx", *told)
    if how.refine:
        rows = scan.written(rows, "gated")
        fine = search.best_candidate(_candidates(search.fine_cells(rows, *key), frames, key, tiles, make), *key)
        finer = F.struct("n_inliers", "lat", "lon", "span_m", "scan_idx", *told)
        both = rows.join(fine.select(*key, finer.alias("_fine")), key, "left")
        use = F.col("locked") & F.coalesce(F.col("_fine.n_inliers") >= F.col("n_inliers"), F.lit(False))
        rows = both.select(*key, "margin_ratio", "locked", F.when(use, F.lit("fine")).otherwise(F.col("pass")).alias("pass"), *[F.when(use, F.col(f"_fine.{c}")).otherwise(F.col(c)).alias(c) for c in ("n_inliers", "lat", "lon", "span_m", "scan_idx", *told)])
    truth = [c for c in ("t_s", "gt_lat", "gt_lon") if c in frames.columns]
    out = frames.select(*key, *truth).join(rows.drop("lat", "lon"), key, "left").withColumns({"n_inliers": F.coalesce("n_inliers", F.lit(0)), "locked": F.coalesce("locked", F.lit(False))})
    if "gt_lat" in truth:
        out = out.withColumn("err_m", geo.haversine(F.col("gt_lat"), F.col("gt_lon"), F.col("est_lat"), F.col("est_lon")))
    return out


def cropped(cells: DataFrame, maps: DataFrame, pixels: int) -> DataFrame:
    """Cells with tile and tile_image, cut out of georeferenced maps (map_tile, map_image: grey or of three channels): the first map that holds a cell's place, sampled at the nearest pixel; beyond its edges a
    tile is black. Cells without a map have no image."""
    x, y = geo.to_mercator(F.col("lon"), F.col("lat"))
    m = maps.select(F.monotonically_increasing_id().alias("_map"), "map_tile", "map_image")
    placed = cells.withColumns({"x": x, "y": y, "_cell": F.monotonically_increasing_id()})
    # a place meets maps by quadtree cell, and its map's pixels only at the end
    near = store.holding(placed.select("_cell", "x", "y"), m.select("_map", "map_tile"), "map_tile").groupBy("_cell").agg(F.min("_map").alias("_map"))
    half = F.col("span_m") / 2
    box = F.struct((x - half).alias("minx"), (y - half).alias("miny"), (x + half).alias("maxx"), (y + half).alias("maxy"), F.lit(pixels).alias("width"), F.lit(pixels).alias("height"))
    rows = scan.written(placed.drop("x", "y").withColumn("tile", box), "cells").join(near, "_cell").join(m, "_map")

    @F.pandas_udf("struct<data: binary, height: int, width: int>")
    def cut(box: pd.DataFrame, whole: pd.DataFrame, image: pd.DataFrame) -> pd.DataFrame:
        out = []
        for b, w, i in zip(box.itertuples(), whole.itertuples(), image.itertuples()):
            a = image_of(i.data, int(i.height), int(i.width))
            at = lambda lo, hi, n, start, size, m: np.floor((lo + (np.arange(n) + 0.5) * (hi - lo) / n - start) / size * m).astype(int)
            px = at(b.minx, b.maxx, pixels, w.minx, w.maxx - w.minx, a.shape[1])
            py = a.shape[0] - 1 - at(b.maxy, b.miny, pixels, w.miny, w.maxy - w.miny, a.shape[0])
            ok = ((py >= 0) & (py < a.shape[0]))[:, None] & ((px >= 0) & (px < a.shape[1]))[None]
            tile = a[np.clip(py, 0, a.shape[0] - 1)[:, None], np.clip(px, 0, a.shape[1] - 1)[None]] * (ok if a.ndim == 2 else ok[..., None])
            out.append((tile.astype(np.uint8).tobytes(), pixels, pixels))
        return pd.DataFrame(out, columns=["data", "height", "width"])

    return rows.withColumn("tile_image", cut("tile", "map_tile", "map_image")).drop("_map", "_cell", "map_tile", "map_image")


def pairwise_links(pairs: DataFrame, make: Callable[[], Matcher], least: int = LEAST_INLIERS) -> DataFrame:
    """Links of consecutive frames: the homography only if enough pairs agree on it, the count of inliers in any case."""
    rows = match_pairs(pairs, make)
    return rows.withColumn("h", F.when(F.col("n_inliers") >= least, F.col("h")))
