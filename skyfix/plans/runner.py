"""Benchmark runs: datasets and models by name, the matrix of scenario by model by sample, and what comes out best."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyfix.functions import camera, geo
from skyfix.operators import asof, metrics, search


@dataclass(frozen=True)
class Config:
    """Settings as nested mappings, looked up by dotted name."""

    values: dict[str, Any] = field(default_factory=dict)

    @staticmethod
    def load(path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            return Config(yaml.safe_load(f) or {})

    def get(self, name: str, default: Any = None) -> Any:
        at: Any = self.values
        for part in name.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at


@dataclass(frozen=True)
class Dataset:
    """scenarios: scenario, terrain, prior_lat, prior_lon, altitude_m?, hfov_deg?; samples: scenario, frame, t_s?, gt_lat?, gt_lon?."""

    name: str
    scenarios: DataFrame
    samples: DataFrame


class Registry:
    def __init__(self, what: str):
        self.what, self.known = what, {}

    def add(self, name: str, make: Callable) -> None:
        self.known[self._normal(name)] = make

    def get(self, name: str) -> Callable:
        key = self._normal(name)
        if key not in self.known:
            raise ValueError(f"unknown {self.what} {name!r}; known: {', '.join(sorted(self.known))}")
        return self.known[key]

    @staticmethod
    def _normal(name: str) -> str:
        return name.strip().lower().replace("-", "_").replace(" ", "_")


#: Models map cells to candidates: a function of (cells DataFrame) giving n_inliers, has_pose, est_lat, est_lon for each cell.
DATASETS, MODELS = Registry("dataset"), Registry("model")


def _not_built(*_: Any) -> Dataset:
    raise NotImplementedError("this dataset's files aren't published in a form that can be read here")


DATASETS.add("satloc", _not_built)


def with_truth(samples: DataFrame, track: DataFrame, key: str) -> DataFrame:
    """Samples with the nearest fix as truth; null without a track."""
    rows = asof.nearest(samples, track, key)
    return rows.select(*samples.columns, F.col("fix.lat").alias("gt_lat"), F.col("fix.lon").alias("gt_lon"))


def scene_search(scenarios: DataFrame) -> DataFrame:
    """Search sizes of every scenario from its expected altitude (zero and null count as unknown)."""
    altitude = F.coalesce(*[F.nullif(F.col(c), F.lit(0.0)) for c in ("altitude_m", "altitude_prior_m") if c in scenarios.columns], F.lit(None).cast("double"))
    fov = F.col("hfov_deg") if "hfov_deg" in scenarios.columns else F.lit(camera.HFOV)
    return scenarios.withColumns(camera.search_for(altitude, fov))


def first_samples(samples: DataFrame, most: int | None) -> DataFrame:
    """The first samples of each scenario; none or 0: all."""
    if not most:
        return samples
    return samples.withColumn("_rank", F.row_number().over(Window.partitionBy("scenario").orderBy("frame"))).where(F.col("_rank") <= most).drop("_rank")


def run(dataset: Dataset, models: dict[str, Callable[[DataFrame], DataFrame]], min_inliers: int = 20, ratio: float = 1.0, max_samples: int | None = None) -> DataFrame:
    """Frame scores of every model on every sample: grid, model, best candidate, gates, error."""
    if dataset.scenarios.where("prior_lat is null or prior_lon is null").limit(1).count():
        raise ValueError("every scenario needs a prior position")
    plan = scene_search(dataset.scenarios)
    centres = search.grid_centres(plan, F.col("radius_m"), F.col("grid_step_m"))
    scales = F.array(*[F.col(f"scale_{i}") for i in range(len(camera.LADDER))])
    cells = centres.select("scenario", "centre_idx", "lat", "lon", "grid_step_m", F.posexplode(scales).alias("scale_idx", "span_m"))
    cells = cells.withColumn("scan_idx", F.col("centre_idx") * len(camera.LADDER) + F.col("scale_idx"))
    samples = first_samples(dataset.samples, max_samples)
    out = None
    for ordinal, (name, model) in enumerate(models.items()):
        x, y = geo.to_mercator(F.col("lon"), F.col("lat"))
        cands = model(samples.join(cells, "scenario")).withColumns({"x_m": x, "y_m": y})
        gated = search.lock_gate(cands, F.lit(1.5) * _step(cands), min_inliers, ratio, "scenario", "frame")
        rows = samples.join(gated.select("scenario", "frame", "est_lat", "est_lon", F.coalesce("n_inliers", F.lit(0)).alias("n_inliers"), "locked"), ["scenario", "frame"], "left")
        err = geo.haversine(F.col("gt_lat"), F.col("gt_lon"), F.col("est_lat"), F.col("est_lon"))
        rows = rows.withColumns({"model": F.lit(name), "model_ord": F.lit(ordinal), "t_s": F.coalesce(F.col("t_s"), F.col("frame").cast("double")), "err_m": err, "runtime_s": F.lit(None).cast("double")})
        out = rows if out is None else out.unionByName(rows)
    return out


def _step(cands: DataFrame) -> Column:
    return F.col("grid_step_m") if "grid_step_m" in cands.columns else F.lit(camera.DEFAULT_SEARCH["grid_step_m"])


def results(scores: DataFrame, metric: str = "recall_5m") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metrics by scenario and model, the best model of each scenario, the model best most often)."""
    by = metrics.field_metrics(scores, "scenario", "model", "model_ord")
    best = metrics.select_best(by, metric, "scenario", "model_ord")
    return by, best, metrics.best_overall(best, "scenario")
