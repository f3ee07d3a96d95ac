import math
import random

import numpy as np
import pytest

from skyfix.llm import covertree


def brute(rows, least=0.93):
    """(id, links, smallest id reached) by comparing every pair of rows."""
    def fit(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    ok = [(lab is not None) and fit(v) for _, v, lab in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, v, lab) in enumerate(rows):
        for j in range(i):
            w, other = rows[j][1], rows[j][2]
            if ok[i] and ok[j] and lab == other and len(v) == len(w) and covertree.cosine(np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)) >= least:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    out = []
    for i, (d, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        c = min(ids, default=None)
        out.append((d, links[i], c, d is not None and d == c))
    return sorted(out, key=str)


def _clusters(r, n, d, noises=(0.0, 0.05, 0.1, 0.2, 0.3)):
    out = []
    while len(out) < n:
        c = r.normal(size=d)
        for _ in range(int(r.integers(1, 12))):
            out.append(c / np.linalg.norm(c) + r.normal(size=d) * r.choice(noises) / math.sqrt(d))
    return np.array(out[:n])


@pytest.mark.parametrize("least", [0.93, 0.5, 1.0, -0.5])
def test_traversal_equals_all_pairs(least):
    r = np.random.default_rng(3)
    for d in (2, 5, 40):
        x = np.unique(_clusters(r, 300, d), axis=0)
        r.shuffle(x)
        weights = r.integers(1, 4, len(x))
        whole = covertree.Tree(x, weights, np.arange(len(x)) + 100)
        u = covertree.units(x)
        hit = u @ u.T >= least
        sure = np.abs(u @ u.T - least) > 1e-9
        hit[~sure] = [covertree.cosine(x[i], x[j]) >= least for i, j in zip(*np.nonzero(~sure))]
        np.fill_diagonal(hit, False)
        want = {i + 100: int(n) for i, n in enumerate(hit @ weights) if n}
        # points with copies also count their own in a self join, less themselves
        rows, links, root = covertree.linked(whole, whole, least)
        assert dict(zip(rows.tolist(), links.tolist())) == want
        label = covertree.forest(len(x), *np.nonzero(hit)) if hit.any() else np.arange(len(x))
        groups = lambda pairs: {frozenset(a for a, b in pairs if b == g) for g in {b for _, b in pairs}}
        assert groups(list(zip((rows - 100).tolist(), root.tolist()))) == groups([(i, g) for i, g in enumerate(label.tolist()) if hit[i].any()])
        # two trees
        s, t = covertree.Tree(x[:120], weights[:120], np.arange(120)), covertree.Tree(x[120:], weights[120:], np.arange(120, len(x)))
        t = covertree.Tree.loaded(t.dumped())
        rows, links, _ = covertree.linked(s, t, least)
        cross = hit.copy()
        cross[:120, :120] = cross[120:, 120:] = False
        assert dict(zip(rows.tolist(), links.tolist())) == {i: int(n) for i, n in enumerate(cross @ weights) if n}


def test_the_tree_is_a_cover_tree():
    r = np.random.default_rng(8)
    x = _clusters(r, 500, 6)
    tree = covertree.Tree(x, np.ones(len(x), np.int64), np.arange(len(x)))
    for i in range(len(tree.radius)):
        own = np.arange(tree.lo[i], tree.hi[i])
        far = covertree.chords(tree.unit[own] @ tree.at[i])
        assert tree.centre[i] in own and far.max() <= tree.radius[i] + 1e-7
        kids = np.arange(tree.child_lo[i], tree.child_hi[i])
        if not len(kids):
            assert tree.single[i]
            continue
        assert np.concatenate([np.arange(tree.lo[k], tree.hi[k]) for k in kids]).tolist() == own.tolist()
        assert tree.centre[i] in tree.centre[kids]
        if len(own) > covertree.FEW and tree.radius[i] >= covertree.LEAST_RADIUS:
            half = 2.0 ** (math.ceil(math.log2(tree.radius[i])) - 1)
            apart = covertree.chords(tree.at[kids] @ tree.at[kids].T)
            assert tree.radius[kids].max() <= half + 1e-7 and apart[~np.eye(len(kids), dtype=bool)].min() > half - 1e-7


def test_dense_groups_are_counted_by_nodes():
    r = np.random.default_rng(1)
    x = np.ones(16) + r.normal(size=(2000, 16)) * 0.01
    tree = covertree.Tree(x, np.ones(2000, np.int64), np.arange(2000))
    a, _, looked = covertree.dual(tree, tree, 0.93)
    assert len(a) < 50 and looked < 2000
    assert covertree.linked(tree, tree, 0.93)[1].tolist() == [1999] * 2000


@pytest.mark.parametrize("block", [16, 64, 4096])
def test_equal_to_brute_force(spark, block):
    r, p = np.random.default_rng(block), random.Random(block)
    rows = [(i, [float(np.float32(v)) for v in x], i % 3) for i, x in enumerate(_clusters(r, 260, 8))]
    hot = np.ones(8)
    rows += [(1000 + i, [float(np.float32(v)) for v in hot + r.normal(size=8) * 0.02], 1) for i in range(120)]
    rows += [(2000 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, -0.0], 2) for i in range(30)] + [(2100, [2.0, 4.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0], 2)]
    odd = [(1, None, 1), (2, [], 1), (3, [0.0] * 8, 1), (4, [1.0, None], 1), (5, [math.nan] * 8, 1), (6, [math.inf] + [1.0] * 7, 1), (7, [1.0, 2.0], 1), (8, [1.0, 2.0], 1), (9, [1.0] * 8, None), (None, [1.0] * 8, 1), (None, [1.0] * 8, None), (10, [1e30] * 8, 1), (11, [1e-30] * 8, 1)]
    rows += [(3000 + (i or -1) if i is not None else None, v, lab) for i, v, lab in odd] + [rows[5], rows[5]]
    p.shuffle(rows)
    df = spark.createDataFrame([(*x, 0, "no") for x in rows], "vec_id long, embedding array<float>, label int, n_links int, kept string").repartition(3)
    got = sorted(map(tuple, covertree.near_vectors(df, block=block).collect()), key=str)
    assert got == brute(rows)


def test_pairs_at_the_threshold(spark):
    # 0.6 and 0.8: the cosine of (1, 0) with (3, 4) is exactly 0.6
    rows = [(1, [1.0, 0.0], 1), (2, [3.0, 4.0], 1), (3, [3.0, 4.000001], 1), (4, [5.0, 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {x.vec_id: (x.n_links, x.component_id) for x in covertree.near_vectors(df, least=0.6).collect()}
    assert got == {1: (1, 1), 2: (2, 1), 3: (1, 1), 4: (0, 4)}


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0], 1)], "vec_id long, embedding array<double>, label int")
    assert covertree.near_vectors(df.limit(0)).collect() == []
    assert list(map(tuple, covertree.near_vectors(df).collect())) == [(1, 0, 1, True)]
