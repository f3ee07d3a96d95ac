"""Texts with their keys (n-grams, suffix heads) as a written table, and which keys different texts share.

Texts count as equal if their words are, whatever the white space and case: by a 128-bit cryptographic digest of the words. Copies are dealt with
once, as the first row of their digest, so that a group of copies of any size costs its rows and no pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfix.llm import wordhash
from skyfix.llm.common import MOST_SENT, bound_batches, discard, slices, written

SLICE = 2 << 20


def list_column(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One list a row, of these sizes, from their values one after the other."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def bytes_column(data: bytes, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.array([data[a:b] for a, b in zip(starts.tolist(), ends.tolist())], pa.binary())


def text_table(docs: DataFrame, extract: Callable[[wordhash.Words], tuple[np.ndarray, np.ndarray, np.ndarray]], name: str) -> DataFrame:
    """A row for each row of docs (id, text, tag): row (its number), id, tag, a and b (halves of the digest; null without words), n, keys, words.

    extract gives of each text n, how many keys it has, and all keys."""

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for piece in slices(batch, limit=SLICE):
                w = wordhash.Words(piece.column(1).to_pylist())
                n, sizes, keys = extract(w)
                plain = [w.normalised(i) for i in range(len(w.counts))]
                digests = np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=16).digest() for t in plain), "<i8").reshape(-1, 2)
                none = w.counts == 0
                columns = [np.arange(row, row + len(plain)), piece.column(0), piece.column(2), *(pa.array(np.ascontiguousarray(digests[:, i]), pa.int64(), mask=none) for i in (0, 1)), n]
                columns += [list_column(keys.astype(np.int64), sizes, pa.int64()), pa.array(plain, pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=["row", "id", "tag", "a", "b", "n", "keys", "words"])
                row += len(plain)

    bound_batches(docs.sparkSession)
    if "tag" not in docs.columns:
        docs = docs.withColumn("tag", F.lit(None).cast("binary"))
    return written(docs.select("id", "text", "tag").mapInArrow(run, "row long, id long, tag binary, a long, b long, n long, keys array<long>, words binary"), name)


def firsts(texts: DataFrame) -> DataFrame:
    """Each different text with words: a, b, the row that stands for it (of smallest id; without any, of smallest row), id, copies."""
    lead = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("lead")
    return texts.where(F.col("a").isNotNull()).groupBy("a", "b").agg(lead, F.count(F.lit(1)).alias("copies")).select("a", "b", "lead.row", "lead.id", "copies")


def narrowed(texts: DataFrame, name: str) -> DataFrame:
    """The written table without keys and words, which go from disk."""
    out = written(texts.drop("keys", "words"), name)
    discard(texts)
    return out


def own_keys(texts: DataFrame, each: DataFrame) -> DataFrame:
    """(row, key) of the different texts: copies' keys aren't told again."""
    rows = each.select("row")
    if rows.limit(MOST_SENT + 1).count() <= MOST_SENT:
        rows = F.broadcast(rows)
    return texts.select("row", "keys").join(rows, "row", "left_semi").select("row", F.explode("keys").alias("key"))


def held_by_several(entries: DataFrame) -> DataFrame:
    """The (row, key) entries whose key several rows hold, with the number of holders.

    Entries cross the network once: they are dealt by key, counted there, and what was counted is joined with them where they are. A row has a key once, so that even a
    key that all rows hold is a small share of the entries (one in the keys of a row). Without nulls from the start, as a later join by row would leave them out of
    one side only, and the two sides would be dealt separately."""
    dealt = entries.where("row is not null and key is not null").repartition("key")
    held = dealt.groupBy("key").agg(F.min("row").alias("lo"), F.max("row").alias("hi"), F.count(F.lit(1)).alias("holders")).where("lo < hi").select("key", "holders")
    return dealt.join(held, "key")
