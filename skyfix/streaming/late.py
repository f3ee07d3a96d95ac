"""The causal filter on a stream whose steps come late and out of order: event time, a watermark, timers, and state that ends.

A step waits until the watermark has passed its time; then all that wait up to there are filtered in the order of their times. So what comes out doesn't depend on the
order of arrival, as long as a step is no later than the watermark's delay; later ones are dropped. The rule as a batch: of the steps that weren't behind the watermark when they came, fusion.fuse_tracks
without smoothing, in the order of time.

What waits is bounded by the steps of one delay. A track that has had no step for `idle_ms` of event time is forgotten, with all its state; if it comes back it begins anew.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from skyfix.operators.fusion import MEASURED, STATE, Tuning, start
from skyfix.streaming.fusion import _advance

HELD = "frame long, t_s double, at_ms long, " + ", ".join(f"{c} double" for c in MEASURED)
#: Name of the store that timers and lists need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LateFilter(StatefulProcessor):
    def __init__(self, key: str, cfg: Tuning, idle_ms: int):
        self.key, self.cfg, self.idle = key, cfg, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", HELD)
        self.now = handle.getValueState("now", "last_t double, last_ms long, begun boolean, s array<double>")
        self.early = handle.getListState("early", "frame long, t_s double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for pdf in rows:
            own = pd.DataFrame({c: pdf[c] if c in pdf else math.nan for c in ("frame", "t_s", "at_ms", *MEASURED)})
            self.held.appendList([(int(r.frame), float(r.t_s), int(r.at_ms), *(float(getattr(r, c)) for c in MEASURED)) for r in own.itertuples()])
            least = int(own["at_ms"].min())
            first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(first + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        ready, wait = sorted((r for r in held if r[2] < mark), key=lambda r: (r[2], r[0])), [r for r in held if r[2] >= mark]
        last_t, last_ms, begun, s = tuple(self.now.get()) if self.now.exists() else (0.0, 0, False, None)
        if not ready:
            if not wait and mark - last_ms >= self.idle:
                for state in (self.held, self.now, self.early):
                    state.clear()
            elif wait:
                self.handle.registerTimer(min(r[2] for r in wait) + 1)
            return
        if wait:
            self.held.put(wait)
        else:
            self.held.clear()
        s, out, early = (tuple(s) if s is not None else None), [], [tuple(r) for r in self.early.get()] if self.early.exists() else []
        for frame, t_s, at_ms, *measured in ready:
            last_ms = max(last_ms, at_ms)
            if s is None and not (measured[0] == measured[0] and measured[1] == measured[1]):
                early.append((frame, t_s))
                continue
            todo = [(frame, t_s, measured)]
            if s is None:
                s = start(measured[0], measured[1], self.cfg)
                todo = [(f, t, [math.nan] * 6) for f, t in early] + todo
                last_t, early = next((t for _, t, _ in todo if t == t), 0.0), []
            for f, t, m in todo:
                s, row, last_t = _advance(s, f, t, m, last_t, not begun, self.cfg)
                out.append(row)
                begun = True
        if early:
            self.early.put(early)
        else:
            self.early.clear()
        self.now.update((float(last_t), int(last_ms), begun, None if s is None else [float(x) for x in s]))
        self.handle.registerTimer(min(r[2] for r in wait) + 1 if wait else last_ms + self.idle)
        if out:
            rows = pd.DataFrame(out, columns=[c.split(" ")[0] for c in STATE.split(", ")])
            rows.insert(0, self.key, key[0])
            yield rows

    def close(self) -> None:
        pass


def filter_late(steps: DataFrame, key: str, at: str, delay: str = "30 seconds", cfg: Tuning = Tuning(), idle_ms: int = 600_000) -> DataFrame:
    """A stream of steps (key, frame, t_s, pos_e, pos_n, ..., and `at`, a timestamp) to filtered states, each once its time is behind the watermark."""
    steps.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    own = steps.withWatermark(at, delay).withColumn("at_ms", F.unix_millis(at))
    kind = dict(steps.dtypes)[key]
    return own.groupBy(key).transformWithStateInPandas(LateFilter(key, cfg, idle_ms), f"`{key}` {kind}, {STATE}", "Append", "EventTime")
