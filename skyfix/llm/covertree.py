"""Embedding near-duplicates: exact cosine threshold pairs by dual traversal of cover trees.

Vectors become unit vectors in double precision, whose chord is a metric: cosine >= t means chord <= sqrt(2 - 2 t).

1. Equal vectors of a label are one point with their number as its weight.
2. Top levels. In labels of more than `BLOCK` points, pivots are taken from a bounded sample, farthest first (so their prefixes are nets of falling radius), and
   every point goes to the cell of its nearest pivot. Cells are dealt to blocks of about `BLOCK` points; a hot cell has many.
3. Trees. A task builds the cover tree of a block: a node of level i has its points within 2^i of its centre; its children are centres more than 2^(i-1) apart, its
   own among them, that cover its points with half the radius. Nodes keep their real covering radius and their points stand in one range.
4. Dual traversal. Blocks meet in pairs unless their covering radii rule all links out; of two trees, pairs of nodes are taken apart from the roots down. A
   pair whose centres are further apart than the threshold and both radii goes; one that is nearer than the threshold less both radii links all its points at once,
   counted by range and weight without listing them, so that a dense group of any size costs its nodes; others are split into their children's pairs.
5. Links are summed by point; of every pair of blocks only a spanning forest of its links goes on to the components.

All vectors of different direction that lie apart must still be compared block by block: in high dimension, vectors without near ones prune little, and work grows with the square of a label's
distinct vectors divided by the machines; memory doesn't (a task holds two blocks).

Distances within `SLACK` of a bound are taken apart further; a pair of points that is as near to the threshold is decided from exactly rounded sums of its own components.

Defined results: null labels and vectors that are null, empty or zero, or hold null, NaN or infinite components, link with nothing; vectors of different lengths neither. Rows keep their number: repeated rows
are vectors of their own and link with each other; a row without an id counts as a link and has the smallest id that it reaches, or null, and is not kept. Other columns are never read. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import io
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfix.llm.common import bound_batches, discard, sent, written
from skyfix.llm.components import components
from skyfix.llm.wordhash import spread

#: Points of a block; blocks on the right of one strip; points from which on a node's net is made of them at once.
BLOCK, STRIP, FEW = 2048, 16, 8
#: Groups that get pivots, pivots of one, and numbers in all vectors of the sample: bounds of what the driver holds.
MOST_GROUPS, MOST_PIVOTS, SAMPLE_NUMBERS = 256, 64, 1 << 20
#: Chords are taken for exact to this; nodes of a smaller radius are not split by nets any more.
SLACK, LEAST_RADIUS = 1e-6, 2.0**-10


def units(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    """From exactly rounded sums, so that it depends on the two vectors only."""
    x, y = (v.astype(np.float64) / float(np.abs(v).max()) for v in (x, y))
    return math.fsum((x * y).tolist()) / math.sqrt(math.fsum((x * x).tolist()) * math.fsum((y * y).tolist()))


def chords(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * dots, 0))


class Tree:
    """The cover tree of some points: of each node its centre, its range of points in `order`, its covering radius and its children (one range of nodes)."""

    def __init__(self, raw: np.ndarray, weights: np.ndarray, rows: np.ndarray, nodes: np.ndarray | None = None, radius: np.ndarray | None = None):
        self.raw, self.weights, self.rows = raw, weights, rows
        self.unit = units(raw)
        if nodes is None:
            order, nodes, radius = self._built()
            self.raw, self.weights, self.rows, self.unit = raw[order], weights[order], rows[order], self.unit[order]
        self.nodes, self.radius = nodes, radius
        self.centre, self.lo, self.hi, self.child_lo, self.child_hi = nodes
        self.at = self.unit[self.centre]
        upto = np.concatenate([[0], np.cumsum(self.weights)])
        self.weight = upto[self.hi] - upto[self.lo]
        self.single = self.hi - self.lo == 1

    def _built(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(self.unit)
        order = np.arange(n)
        root = int(np.argmax(self.unit @ self.unit.mean(axis=0)))
        nodes: list[list[int]] = [[root, 0, n, 0, 0]]
        radius = [0.0]
        todo = [0]
        while todo:
            at = todo.pop()
            centre, lo, hi = nodes[at][:3]
            if hi - lo == 1:
                continue
            points = order[lo:hi]
            far = chords(self.unit[points] @ self.unit[centre])
            far[points == centre] = 0
            radius[at] = r = float(far.max())
            parts = self._net(points, centre, far, r)
            order[lo:hi] = np.concatenate([p for _, p in parts])
            nodes[at][3:] = [len(nodes), len(nodes) + len(parts)]
            for c, p in parts:
                todo.append(len(nodes))
                nodes.append([c, lo, lo + len(p), 0, 0])
                radius.append(0.0)
                lo += len(p)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        table = np.array(nodes, np.int64).T
        table[0] = place[table[0]]
        return order, table, np.array(radius)

    def _net(self, points: np.ndarray, centre: int, far: np.ndarray, r: float) -> list[tuple[int, np.ndarray]]:
        """Centres of the next level with the points that they cover; the node's own centre is the first."""
        if len(points) <= FEW or r < LEAST_RADIUS:
            return [(int(p), points[i : i + 1]) for i, p in enumerate(points)]
        half = 2.0 ** (math.ceil(math.log2(r)) - 1)
        own = far <= half
        out, rest = [(centre, points[own])], points[~own]
        near = self.unit[rest] @ self.unit[rest].T >= 1 - half * half / 2
        left = np.ones(len(rest), bool)
        for i in range(len(rest)):
            if left[i]:
                mine = near[i] & left
                mine[i] = True
                left &= ~mine
                out.append((int(rest[i]), rest[mine]))
        return out

    def dumped(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, raw=self.raw, weights=self.weights, rows=self.rows, nodes=self.nodes.astype(np.int32), radius=self.radius)
        return out.getvalue()

    @staticmethod
    def loaded(data: bytes) -> Tree:
        held = np.load(io.BytesIO(data), allow_pickle=False)
        return Tree(held["raw"], held["weights"], held["rows"], held["nodes"].astype(np.int64), held["radius"])


def _children(s: Tree, t: Tree, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of the pairs of nodes (a, b); a node without children stands for itself."""
    alo, blo = np.where(s.single[a], a, s.child_lo[a]), np.where(t.single[b], b, t.child_lo[b])
    an, bn = np.where(s.single[a], 1, s.child_hi[a] - s.child_lo[a]), np.where(t.single[b], 1, t.child_hi[b] - t.child_lo[b])
    k = spread(an * bn)
    width = np.repeat(bn, an * bn)
    return np.repeat(alo, an * bn) + k // width, np.repeat(blo, an * bn) + k % width


def dual(s: Tree, t: Tree, least: float, together: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, int]:
    """(nodes of s, nodes of t) whose points all link, every linked pair of points in exactly one of them, and how many pairs of nodes were looked at.

    s is t: pairs within the tree, each once; (a, a) stands for all pairs of different points of a."""
    limit, same = math.sqrt(max(0.0, 2 - 2 * least)), s is t
    done: list[tuple[np.ndarray, np.ndarray]] = []
    looked = 0

    def kept(a: np.ndarray, b: np.ndarray, dots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Notes pairs that link as a whole, and gives those that must be split."""
        d, r = chords(dots), s.radius[a] + t.radius[b]
        whole = d + r < limit - SLACK
        both = s.single[a] & t.single[b]
        for i in np.flatnonzero(both & ~whole).tolist():
            whole[i] = cosine(s.raw[s.lo[a[i]]], t.raw[t.lo[b[i]]]) >= least
        if whole.any():
            done.append((a[whole], b[whole]))
        more = ~whole & ~both
        return a[more], b[more]

    stack: list[tuple[np.ndarray, np.ndarray]] = []
    alike = [np.zeros(1, np.int64)] if same else []
    if not same:
        zero = np.zeros(1, np.int64)
        if float(chords(s.at[:1] @ t.at[0])[0]) <= s.radius[0] + t.radius[0] + limit + SLACK:
            stack.append(kept(zero, zero, s.at[:1] @ t.at[0]))
    while alike or stack:
        if alike:  # a node with itself: all its points link, or its children do with themselves and each other
            a = alike.pop()
            a = a[~s.single[a]]
            whole = 2 * s.radius[a] < limit - SLACK
            if whole.any():
                done.append((a[whole], a[whole]))
            for x in a[~whole].tolist():
                c = np.arange(s.child_lo[x], s.child_hi[x])
                alike.append(c)
                i, j, seen = _near(s, s, int(c[0]), int(c[-1]) + 1, int(c[0]), int(c[-1]) + 1, limit, True)
                looked += seen
                stack.append(kept(i, j, np.einsum("ij,ij->i", s.at[i], s.at[j])))
            continue
        a, b = stack.pop()
        if not len(a):
            continue
        fan = np.where(s.single[a], 1, s.child_hi[a] - s.child_lo[a]) * np.where(t.single[b], 1, t.child_hi[b] - t.child_lo[b])
        big = fan > 4096
        for x, y in zip(a[big].tolist(), b[big].tolist()):
            alo, ahi = (x, x + 1) if s.single[x] else (int(s.child_lo[x]), int(s.child_hi[x]))
            blo, bhi = (y, y + 1) if t.single[y] else (int(t.child_lo[y]), int(t.child_hi[y]))
            i, j, seen = _near(s, t, alo, ahi, blo, bhi, limit, False)
            looked += seen
            stack.append(kept(i, j, np.einsum("ij,ij->i", s.at[i], t.at[j])))
        a, b, fan = a[~big], b[~big], fan[~big]
        lots = np.cumsum(fan) // together
        for lot in np.unique(lots).tolist():
            i, j = _children(s, t, a[lots == lot], b[lots == lot])
            looked += len(i)
            dots = np.einsum("ij,ij->i", s.at[i], t.at[j])
            near = chords(dots) <= s.radius[i] + t.radius[j] + limit + SLACK
            stack.append(kept(i[near], j[near], dots[near]))
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), looked
    return np.concatenate([x for x, _ in done]), np.concatenate([y for _, y in done]), looked


def _near(s: Tree, t: Tree, alo: int, ahi: int, blo: int, bhi: int, limit: float, upper: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs of two ranges of nodes that the covering radii don't rule out, by products of whole ranges; upper: each pair of different nodes once."""
    at, other, seen = [], [], 0
    for x in range(alo, ahi, 512):
        stop = min(x + 512, ahi)
        reach = s.radius[x:stop, None] + t.radius[None, blo:bhi] + (limit + SLACK)
        near = 2 - 2 * (s.at[x:stop] @ t.at[blo:bhi].T) <= reach * reach
        if upper:
            near &= np.arange(blo, bhi)[None] > np.arange(x, stop)[:, None]
        seen += near.size
        i, j = np.nonzero(near)
        at.append(i + x)
        other.append(j + blo)
    return np.concatenate(at), np.concatenate(other), seen


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, by hooking and pointer jumping."""
    label = np.arange(n)
    while True:
        before = label
        a, b = label[u], label[v]
        m = np.minimum(a, b)
        label = label.copy()
        np.minimum.at(label, a, m)
        np.minimum.at(label, b, m)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label, before):
            return label


def linked(s: Tree, t: Tree, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, links, root) of the points that link: links counts rows by weight, root is the row of one point of the component that the links of s with t make."""
    same = s is t
    a, b, _ = dual(s, t, least)
    if not len(a):
        return (np.zeros(0, np.int64),) * 3
    ns, nt = len(s.rows), len(t.rows)
    shift = 0 if same else ns
    size = shift + nt
    gain, itself = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)

    def add(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray, weight) -> None:
        np.add.at(sums, lo, weight)
        np.subtract.at(sums, hi, weight)

    own = a == b if same else np.zeros(len(a), bool)
    add(gain, s.lo[a], s.hi[a], t.weight[b])
    add(gain, t.lo[b[~own]] + shift, t.hi[b[~own]] + shift, s.weight[a[~own]])
    add(itself, s.lo[a[own]], s.hi[a[own]], 1)
    weights, rows = (s.weights, s.rows) if same else (np.concatenate([s.weights, t.weights]), np.concatenate([s.rows, t.rows]))
    links = np.cumsum(gain)[:size] - np.cumsum(itself)[:size] * weights
    # a node that links as a whole has its points in one component
    u, v = [s.centre[a]], [t.centre[b] + shift]
    for tree, node, base in ((s, a, 0), (t, b, shift)):
        node = np.unique(node)
        u.append(spread(tree.hi[node] - tree.lo[node], tree.lo[node]) + base)
        v.append(np.repeat(tree.centre[node], tree.hi[node] - tree.lo[node]) + base)
    label = forest(size, np.concatenate(u), np.concatenate(v))
    has = links > 0
    return rows[has], links[has], rows[label[has]]


def _vectors(embeddings: DataFrame, id_column: str, vector_column: str, label_column: str) -> tuple[DataFrame, np.dtype]:
    """(row, id, label, dim, a, b, vector) of every row, and the numbers' type; the vector as bytes, dim and its digest (a, b) only where it can link."""
    kind = embeddings.schema[vector_column].dataType.elementType.typeName()
    wide = np.dtype("<f4") if kind == "float" else np.dtype("<f8")

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            n, column = batch.num_rows, batch.column(2)
            flat = column.flatten()
            values = flat.cast(pa.float64() if wide.itemsize == 8 else pa.float32(), safe=False).fill_null(math.nan).to_numpy(zero_copy_only=False)
            sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False))
            starts = np.cumsum(sizes) - sizes
            labelled = column.is_valid().to_numpy(zero_copy_only=False) & batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            data, dims, halves = [None] * n, np.zeros(n, np.int32), np.zeros((n, 2), np.int64)
            for i in np.flatnonzero(labelled & (sizes > 0)).tolist():
                v = values[starts[i] : starts[i] + sizes[i]].astype(wide) + wide.type(0)  # no negative zero
                if np.isfinite(v).all() and v.any():
                    data[i], dims[i] = v.tobytes(), sizes[i]
                    halves[i] = np.frombuffer(hashlib.blake2b(data[i], digest_size=16).digest(), "<i8")
            none = np.array([d is None for d in data], bool)
            made = [pa.array(np.arange(row, row + n)), batch.column(0), batch.column(1), pa.array(dims, pa.int32(), mask=none), *(pa.array(np.ascontiguousarray(halves[:, k]), mask=none) for k in (0, 1)), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=["row", "id", "label", "dim", "a", "b", "vector"])
            row += n

    bound_batches(embeddings.sparkSession)
    source = embeddings.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("string").alias("label"), F.col(vector_column).alias("vector"))
    return written(source.mapInArrow(run, "row long, id long, label string, dim int, a long, b long, vector binary"), "vectors"), wide


def farthest_first(x: np.ndarray, most: int) -> np.ndarray:
    """Up to most points of x, each the farthest from those before; fewer if no more lie apart."""
    chosen = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[chosen[0]]
    while len(chosen) < most:
        i = int(np.argmin(near))
        if near[i] > 1 - LEAST_RADIUS**2 / 2:
            break
        chosen.append(i)
        near = np.maximum(near, x @ x[i])
    return x[chosen]


def _pivots(points: DataFrame, wide: np.dtype, block: int) -> dict[tuple[str, int], np.ndarray]:
    """Pivots of the largest groups (label, dim), from a sample of at most SAMPLE_NUMBERS numbers."""
    sizes = points.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).orderBy(F.desc("n"), "label", "dim").limit(MOST_GROUPS).collect()
    if not sizes:
        return {}
    wanted = {(r["label"], r["dim"]): min(MOST_PIVOTS, -(-r["n"] // block)) for r in sizes}
    share = SAMPLE_NUMBERS / sum(k * d for (_, d), k in wanted.items())
    shares = points.sparkSession.createDataFrame([(r["label"], r["dim"], min(1.0, share * wanted[r["label"], r["dim"]] / r["n"], 32 * wanted[r["label"], r["dim"]] / r["n"])) for r in sizes], "label string, dim int, share double")
    drawn = points.join(F.broadcast(shares), ["label", "dim"]).where(F.pmod(F.xxhash64("row", F.lit(1)), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    most = 2 * max(1, SAMPLE_NUMBERS // max(d for _, d in wanted))
    found: dict[tuple[str, int], list[bytes]] = {}
    for r in drawn.select("label", "dim", "row", "vector").limit(most).collect():
        found.setdefault((r["label"], r["dim"]), []).append((r["row"], bytes(r["vector"])))
    return {k: farthest_first(units(np.stack([np.frombuffer(v, wide) for _, v in sorted(own)])), wanted[k]) for k, own in found.items()}


def _blocks(points: DataFrame, wide: np.dtype, block: int) -> DataFrame:
    """(block, label, dim, n, centre, radius, tree): every point in one block, of about `block` points at most."""
    pivots = _pivots(points, wide, block)

    def cells(batches):
        for batch in batches:
            labels, dims = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            cell, places = np.zeros(len(labels), np.int32), {}
            for i, k in enumerate(zip(labels, dims)):
                if k in pivots:
                    places.setdefault(k, []).append(i)
            for k, own in places.items():
                x = units(np.stack([np.frombuffer(batch.column(4)[i].as_py(), wide) for i in own]))
                cell[own] = np.argmax(x @ pivots[k].T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    placed = points.select("row", "label", "dim", "copies", "vector")
    placed = written(placed.mapInArrow(cells, "row long, label string, dim int, copies long, vector binary, cell int"), "cells") if pivots else placed.withColumn("cell", F.lit(0))
    counts = placed.groupBy("label", "dim", "cell").agg(F.count(F.lit(1)).alias("held"))
    alone = placed.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("in_all")).where("in_all > 1")
    counts = counts.join(alone, ["label", "dim"]).select("label", "dim", "cell", F.ceil(F.col("held") / block).cast("int").alias("parts"))
    dealt = placed.join(sent(counts, "cell-parts"), ["label", "dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("row", F.lit(2)), F.col("parts")).cast("int")).drop("parts")
    dealt = dealt.repartition("label", "dim", "cell", "part")  # not by cell alone, which may hold most points

    def build(key, table):
        raw = np.frombuffer(b"".join(table.column("vector").to_pylist()), wide).reshape(table.num_rows, -1)
        order = np.argsort(table.column("row").to_numpy())
        tree = Tree(raw[order], table.column("copies").to_numpy()[order], table.column("row").to_numpy()[order])
        one = {"block": [int(tree.rows.min())], "label": [key[0].as_py()], "dim": [key[1].as_py()], "n": [len(tree.rows)], "centre": [tree.at[0].tolist()], "radius": [float(tree.radius[0])], "tree": [tree.dumped()]}
        return pa.table(one, schema=pa.schema([("block", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("n", pa.int64()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("tree", pa.binary())]))

    made = dealt.groupBy("label", "dim", "cell", "part").applyInArrow(build, "block long, label string, dim int, n long, centre array<double>, radius double, tree binary")
    out = written(made, "cover-trees")
    if pivots:
        discard(placed)
    return out


def _pairs(blocks: DataFrame, limit: float) -> DataFrame:
    """(left, right) of the blocks that may hold links, left <= right, a block with itself among them."""
    heads = blocks.select("block", "label", "dim", "centre", "radius")
    deals = heads.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / 64).cast("int").alias("deals"))
    heads = heads.join(deals, ["label", "dim"])  # blocks of a large label meet in several tasks
    left = heads.withColumn("deal", F.pmod(F.xxhash64("block"), F.col("deals")).cast("int")).drop("deals")
    right = heads.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).select("label", "dim", "deal", F.col("block").alias("other"), F.col("centre").alias("there"), F.col("radius").alias("reach"))
    dot = F.aggregate(F.zip_with("centre", "there", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot))
    near = (F.col("block") == F.col("other")) | (apart <= F.col("radius") + F.col("reach") + (limit + SLACK))
    return left.join(right, ["label", "dim", "deal"]).where((F.col("block") <= F.col("other")) & near).select(F.col("block").alias("left"), F.col("other").alias("right"))


def _joined(blocks: DataFrame, least: float) -> DataFrame:
    """(row, links, root) of every pair of blocks."""
    pairs = _pairs(blocks, math.sqrt(max(0.0, 2 - 2 * least))).withColumn("strip", F.pmod(F.xxhash64("right"), F.lit(1 << 20)))
    sizes = pairs.groupBy("left").agg(F.ceil(F.count(F.lit(1)) / STRIP).cast("int").alias("strips"))
    pairs = written(pairs.join(sizes, "left").select("left", "right", F.pmod("strip", F.col("strips")).cast("int").alias("strip")), "block-pairs")
    trees = blocks.select("block", "tree")
    lefts = pairs.select("left", "strip").distinct().join(trees, F.col("left") == F.col("block")).select("left", "strip", F.lit(0).alias("kind"), "block", "tree")
    rights = pairs.join(trees, F.col("right") == F.col("block")).select("left", "strip", F.lit(1).alias("kind"), "block", "tree")

    def run(batches):
        now, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                left, strip, kind, block = (batch.column(c)[i].as_py() for c in range(4))
                if kind == 0:
                    now, held = (left, strip), Tree.loaded(batch.column(4)[i].as_py())
                    continue
                assert now == (left, strip)
                other = held if block == left else Tree.loaded(batch.column(4)[i].as_py())
                rows, links, root = linked(held, other, least)
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows, links, root)], names=["row", "links", "root"])

    dealt = lefts.unionByName(rights).repartition("left", "strip").sortWithinPartitions("left", "strip", "kind")
    out = written(dealt.mapInArrow(run, "row long, links long, root long"), "vector-links")
    discard(pairs)
    return out


def near_vectors(embeddings: DataFrame, least: float = 0.93, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", block: int = BLOCK) -> DataFrame:
    """Per vector: id, n_links, component_id, kept (id is the component's)."""
    vectors, wide = _vectors(embeddings, id_column, vector_column, label_column)
    own = ["label", "dim", "a", "b"]
    points = vectors.where(F.col("a").isNotNull()).groupBy(*own).agg(F.min("row").alias("row"), F.min("id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.min("vector").alias("vector"))
    points = written(points, "vector-points")
    blocks = _blocks(points, wide, block)
    links = _joined(blocks, least)
    totals = links.groupBy("row").agg(F.sum("links").alias("links"))
    stars = components(links.where("row <> root").select(F.col("row").alias("u"), F.col("root").alias("v")))
    heads = points.select("row", *own, "least_id", "copies").join(totals, "row", "left").join(stars.select(F.col("u").alias("row"), F.col("v").alias("up")), "row", "left")
    heads = heads.where("links > 0 or copies > 1").withColumn("top", F.coalesce("up", "row"))
    tops = heads.groupBy("top").agg(F.min("least_id").alias("component"))
    found = written(heads.join(tops, "top").select(*own, (F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links"), "component"), "vector-heads")
    rows = vectors.select("id", *own).join(found, own, "left")
    component = F.coalesce("component", "id")
    out = rows.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
    out = written(out, "near-vectors")
    discard(vectors, points, blocks, links, stars, found)
    return out
