"""Ordered scans over long groups, without a group in one task: rows in bounded blocks, elements reduced within blocks, a scan over blocks, and a replay.

An associative step (motions multiplied, filters composed) is first taken over each block of at most `BLOCK` rows, many blocks at once; only
one element a block is then scanned in its group, and every block is replayed from what came before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfix.sources.tables import shared_folder

#: Rows of a block.
BLOCK = 4096

Element = tuple[np.ndarray, ...]
Combine = Callable[[Element, Element], Element]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the folder that all executors share: what has been computed outlives them."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def inclusive(combine: Combine, element: Element, place: np.ndarray) -> Element:
    """Prefix products of every segment at once, in as many steps as its length has bits. The last axis runs over rows, place is a row's number in its segment."""
    out = [x.copy() for x in element]
    reach, longest = 1, int(place.max(initial=-1)) + 1
    while reach < longest:
        at = np.flatnonzero(place >= reach)
        got = combine(tuple(x[..., at - reach] for x in out), tuple(x[..., at] for x in out))
        for x, g in zip(out, got):
            x[..., at] = g
        reach *= 2
    return tuple(out)


def reduced(combine: Combine, element: Element, sizes: np.ndarray) -> Element:
    """The product of every segment (none is empty): neighbours are combined until one element is left, in all about as many products as there are rows."""
    out, sizes = element, np.asarray(sizes)
    while len(sizes) and sizes.max() > 1:
        place, back = places(sizes)
        left = np.flatnonzero(place % 2 == 0)
        pair = back[left] > 0
        both = combine(tuple(x[..., left[pair]] for x in out), tuple(x[..., left[pair] + 1] for x in out))
        out = tuple(x[..., left] for x in out)
        for x, b in zip(out, both):
            x[..., pair] = b
        sizes = (sizes + 1) // 2
    return out


def suffix(combine: Combine, element: Element, back: np.ndarray) -> Element:
    """The same from the end of each segment; back counts rows from there."""
    turned = inclusive(lambda a, b: combine(b, a), tuple(x[..., ::-1] for x in element), back[::-1])
    return tuple(x[..., ::-1] for x in turned)


def places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place from the start, place from the end) of the rows of segments of these sizes."""
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(int(sizes.sum())) - start
    return place, np.repeat(sizes, sizes) - 1 - place


def blocked(rows: DataFrame, keys: list[str], order: list[Column], columns: list[str], size: int = BLOCK) -> DataFrame:
    """(block, *keys, *columns as arrays): pieces of at most `size` rows of each group; the numbers of a group's blocks rise in its order.

    Rows are range-partitioned by keys and order, so that a long group is dealt over tasks."""
    kinds = dict(rows.dtypes)
    schema = ", ".join(["block long", *[f"`{k}` {kinds[k]}" for k in keys], *[f"`{c}` array<{kinds[c]}>" for c in columns]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for i in range(len(keys)):
                a, b = batch.column(i)[1:], batch.column(i)[:-1]
                new[1:] |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
            new[0] = True
            begin = np.flatnonzero(new)
            place, _ = places(np.diff(begin, append=batch.num_rows))
            starts = np.flatnonzero(place % size == 0)
            bounds = pa.array(np.append(starts, batch.num_rows), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(block, block + len(starts))), *(batch.column(i).take(pa.array(starts)) for i in range(len(keys))), *(pa.ListArray.from_arrays(bounds, batch.column(len(keys) + i)) for i in range(len(columns)))], names=["block", *keys, *columns])
            block += len(starts)

    ranged = rows.repartitionByRange(*[F.col(k) for k in keys], *order).sortWithinPartitions(*[F.col(k) for k in keys], *order)
    return written(ranged.select(*keys, *columns).mapInArrow(run, schema), "blocks")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values with NaN for nulls, sizes) of a list column of numbers."""
    return column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False), pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def packed(element: Element) -> pa.Array:
    """A list of all numbers of each row's element."""
    n = element[0].shape[-1]
    flat_ = np.concatenate([x.reshape(-1, n) for x in element]).T
    return lists(np.ascontiguousarray(flat_).ravel(), np.full(n, flat_.shape[1]))


def unpacked(values: np.ndarray, shapes: list[tuple[int, ...]]) -> Element:
    """The elements of rows of numbers (rows x numbers)."""
    out, at = [], 0
    for s in shapes:
        k = int(np.prod(s))
        out.append(np.ascontiguousarray(values[:, at : at + k].T).reshape(*s, len(values)))
        at += k
    return tuple(out)


def carried(summaries: DataFrame, keys: list[str], combine: Combine, shapes: list[tuple[int, ...]], from_end: bool = False) -> DataFrame:
    """(block, before): from one element a block (block, *keys, element), the product of all blocks before it in its group (after it, from_end); null for the first.

    A group is one row a block here, so a thousandth of its rows and less."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        whole = unpacked(np.stack(pdf["element"].to_list()), shapes)
        n = len(pdf)
        got = suffix(combine, whole, np.arange(n)[::-1]) if from_end else inclusive(combine, whole, np.arange(n))
        rows = np.concatenate([x.reshape(-1, n) for x in got]).T.tolist()
        return pd.DataFrame({"block": pdf["block"].to_numpy(), "before": [*rows[1:], None] if from_end else [None, *rows[:-1]]})

    return summaries.groupBy(*keys).applyInPandas(run, "block long, before array<double>")


def mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of matrices that lie along the last axis."""
    return sum(a[:, k, None] * b[None, k] for k in range(a.shape[1]))


def transposed(a: np.ndarray) -> np.ndarray:
    return np.swapaxes(a, 0, 1)


def inverse2(a: np.ndarray) -> np.ndarray:
    return np.array([[a[1, 1], -a[0, 1]], [-a[1, 0], a[0, 0]]]) / (a[0, 0] * a[1, 1] - a[0, 1] * a[1, 0])
