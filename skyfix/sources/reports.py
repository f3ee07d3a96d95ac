"""Small texts and identities that the driver makes of collected aggregates."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settings_hash(settings: dict[str, Any]) -> str:
    """SHA-1 of the settings as JSON with sorted keys, spaced as Python does."""
    return hashlib.sha1(json.dumps(settings, sort_keys=True).encode()).hexdigest()


def status_line() -> Column:
    """A frame's line of a run's log: its error, or that it isn't locked or has no pose."""
    what = F.when(F.col("locked") & F.col("err_m").isNotNull(), F.format_string("err %.2f m", "err_m")).when(F.col("locked"), F.lit("locked")).when(F.col("est_lat").isNotNull(), F.lit("UNLOCKED")).otherwise(F.lit("no pose"))
    return F.concat(F.format_string("frame %5d ", F.col("frame")), what, F.format_string(" (%d inliers)", F.col("n_inliers")))


def markdown(metrics: DataFrame, best: str | None, asked: list[str]) -> str:
    """A table of field metrics (a row for each model), the pick, and the models that gave nothing."""
    show = lambda v, unit="": "—" if v is None else f"{v:.1f}{unit}"
    rows = metrics.orderBy("model").collect()
    lines = ["| Model | Locked | Recall 5 m | Median | Worst |", "|---|---|---|---|---|"]
    lines += [f"| {r['model']} | {r['n_locked']}/{r['n']} | {r['recall_5m']:.2f} | {show(r['median_err_m'], ' m')} | {show(r['worst_err_m'], ' m')} |" for r in rows]
    lines.append(f"\nPick: {best or 'none'}")
    if missing := sorted(set(asked) - {r["model"] for r in rows}):
        lines.append(f"Without results: {', '.join(missing)}")
    return "\n".join(lines) + "\n"
