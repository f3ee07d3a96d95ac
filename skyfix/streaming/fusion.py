"""The causal half of fusion on a stream: state per track, in Structured Streaming.

Steps before a track's first fix wait in the state (two numbers each), as the batch filter starts them from that fix. Within a micro-batch steps are
sorted by frame; a step whose time is earlier than the last one's, or missing, counts as simultaneous with it (its dt is 0), as in batch.
With `idle` a track that gets no step for so long is forgotten, and steps that still waited for a first fix with it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skyfix.operators.fusion import STATE, Tuning, predict, start, update

MEMORY = "last_t double, begun boolean, state array<double>, waiting array<struct<frame: long, t_s: double>>"
MEASURED = ("pos_e", "pos_n", "pos_std", "vel_e", "vel_n", "vel_std")


def _advance(s, frame, t_s, measured, last_t, first, cfg):
    known = t_s == t_s and t_s is not None
    now = float(t_s) if known else last_t
    s = predict(s, 0.0 if first else max(now - last_t, 0.0), first, cfg)
    used = rejected = False
    pe, pn, ps, ve, vn, vs = measured
    if pe == pe and pn == pn:
        s, used = update(s, pe, pn, ps if ps == ps else cfg.fix_std_m, True, cfg.gate_chi2)
        rejected = not used
    if ve == ve and vn == vn:
        s, _ = update(s, ve, vn, vs if vs == vs else cfg.velocity_std, False, 0.0)
    return s, (frame, t_s if known else None, *s[:4], float(np.sqrt(max(2 * s[4], 0))), used, rejected), now


def filter_stream(steps: DataFrame, key: str, cfg: Tuning = Tuning(), idle_ms: int | None = None) -> DataFrame:
    """A stream of steps (key, frame, t_s, pos_e, pos_n, and if known pos_std, vel_e, vel_n, vel_std) to a stream of filtered states."""
    names = [c.split(" ")[0] for c in STATE.split(", ")]

    def run(group: tuple, batches: Iterator[pd.DataFrame], memory: GroupState) -> Iterator[pd.DataFrame]:
        if memory.hasTimedOut:
            memory.remove()
            return
        last_t, begun, held, waiting = memory.get if memory.exists else (0.0, False, None, [])
        s, waiting = (tuple(held) if held is not None else None), list(waiting)
        pdf = pd.concat(list(batches)).sort_values(["frame", "t_s"], kind="stable")
        cells = [pdf[c].to_numpy(float).tolist() if c in pdf else [math.nan] * len(pdf) for c in MEASURED]
        out = []
        for frame, t_s, *measured in zip(pdf["frame"].tolist(), pdf["t_s"].to_numpy(float).tolist(), *cells):
            fixed = measured[0] == measured[0] and measured[1] == measured[1]
            if s is None and not fixed:
                waiting.append((int(frame), float(t_s)))
                continue
            todo = [(frame, t_s, measured)]
            if s is None:
                s = start(measured[0], measured[1], cfg)
                todo = [(f, t, [math.nan] * 6) for f, t in waiting] + todo
                last_t = next((t for _, t, _ in todo if t is not None and t == t), 0.0)
                waiting = []
            for f, t, m in todo:
                s, row, last_t = _advance(s, int(f), math.nan if t is None else t, m, last_t, not begun, cfg)
                out.append(row)
                begun = True
        memory.update((float(last_t), begun, None if s is None else [float(x) for x in s], waiting))
        if idle_ms:
            memory.setTimeoutDuration(idle_ms)
        if out:
            rows = pd.DataFrame(out, columns=names)
            rows.insert(0, key, group[0])
            yield rows

    kind = dict(steps.dtypes)[key]
    limit = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return steps.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {STATE}", MEMORY, "append", limit)
