"""Quality by compression: zstandard dictionaries of good and of bad labelled text, and a calibrated size difference.

A text is compressed once with either dictionary. (bad size - good size) / length is the normalised difference; a logistic
curve fitted on labelled rows that the dictionaries haven't seen turns it, with how far the text compresses at all and its length, into
the probability of label 1. All training rows come from a bounded sample: at most `per_class` labelled documents of
each class, those of lowest hash of their id, one text for each id (of several the one of lowest hash), and at most `window` characters of each, from a place given by the id.

Defined results: a null text is the empty text and gets the score of no bytes at all; rows without an id are scored but never
trained on; null labels and labels of documents that aren't there are passed over, contradictory labels of an id too. Without labels of both classes every
score is the share of label 1 (0.5 without any). Columns besides id and text are never read; equal texts get equal scores.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfix.llm.common import crc_mod, map_slices

PER_CLASS, WINDOW, DICTIONARY, LEVEL = 4000, 16_384, 110 << 10, 3


@dataclasses.dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    level: int = LEVEL


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; of few samples simply their text."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-size:]


class Sizer:
    """Features of texts from their compressed sizes."""

    def __init__(self, good: bytes, bad: bytes, level: int):
        self.of = [zstandard.ZstdCompressor(level=level, dict_data=self._loaded(d, level), write_content_size=False, write_dict_id=False) for d in (good, bad)]

    @staticmethod
    def _loaded(data: bytes, level: int):
        d = zstandard.ZstdCompressionDict(data or b"\0" * 8)
        d.precompute_compress(level=level)
        return d

    def features(self, texts: list[bytes]) -> np.ndarray:
        good, bad = (np.array([len(c.compress(t)) for t in texts], float) for c in self.of)
        n = np.fromiter(map(len, texts), float, len(texts)) + 16  # a frame's own bytes count for little in very short texts
        ratio = good / n
        return np.stack([np.ones(len(n)), 20 * (bad - good) / n, ratio, np.maximum(0.3 - ratio, 0) * 10, np.maximum(0.15 - ratio, 0) * 20, np.log(n)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (w * (y - p)) - ridge * b
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b = b + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", held_out: tuple[int, int] = (5, 0), per_class: int = PER_CLASS, window: int = WINDOW) -> Model:
    """Learns from labelled rows whose crc32 of the id, modulo held_out[0], isn't held_out[1]."""
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & (crc_mod("id", held_out[0]) != held_out[1]))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(totals.values())
    prior = totals.get(1, 0) / total if total else 0.5
    if len(totals) < 2:
        return Model(b"", b"", (float(np.log((prior + 1e-3) / (1 - prior + 1e-3))), 0, 0, 0, 0, 0))
    chosen: dict = {}
    for label in (0, 1):
        for r in known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(per_class).collect():
            chosen.setdefault(r["id"], set()).add(label)
    ids = documents.sparkSession.createDataFrame([(i,) for i, v in chosen.items() if len(v) == 1], f"id {dict(known.dtypes)['id']}")
    n = F.greatest(F.length("text") - window, F.lit(0))
    part = F.expr(f"substring(text, cast(1 + pmod(xxhash64(id), n + 1) as int), {window})")
    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(ids), "id").withColumn("n", n).select("id", F.xxhash64("text").alias("hash"), part.alias("text"))
    rows = rows.groupBy("id").agg(F.min(F.struct("hash", "text")).alias("one")).select("id", "one.text").collect()  # at most 2 * per_class rows
    rows = sorted((r["id"], r["text"]) for r in rows)
    use: dict = {0: [], 1: []}
    for i, text in rows:
        use[min(chosen[i])].append(text.encode("utf-8", "replace"))
    good, bad = _dictionary(use[1][::2], DICTIONARY), _dictionary(use[0][::2], DICTIONARY)
    seen = [(t, label) for label in (0, 1) for t in (use[label][1::2] or use[label])]
    if not seen:
        return Model(b"", b"", (float(np.log((prior + 1e-3) / (1 - prior + 1e-3))), 0, 0, 0, 0, 0))
    y = np.array([label for _, label in seen], float)
    share = np.where(y == 1, prior / max(y.sum(), 1), (1 - prior) / max((1 - y).sum(), 1)) * len(y)
    x = Sizer(good, bad, LEVEL).features([t for t, _ in seen])
    return Model(good, bad, tuple(map(float, _logistic(x, y, share))))


def score(documents: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.3, held_out: tuple[int, int] = (5, 0)) -> DataFrame:
    """Per document: id, held_out, score, predicted (1 from the threshold on)."""
    kind = dict(documents.select(id_column).dtypes)[id_column]

    def make():
        sizer, w = Sizer(model.good, model.bad, model.level), np.array(model.weights)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = sizer.features([t or b"" for t in batch.column(2).to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64())], names=["id", "held_out", "score"])

        return each

    source = documents.select(F.col(id_column).alias("id"), F.col(text_column).cast("binary").alias("text"))
    source = source.select("id", (crc_mod("id", held_out[0]) == held_out[1]).alias("held_out"), "text")
    out = map_slices(source, make, f"id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumnRenamed("id", id_column)
