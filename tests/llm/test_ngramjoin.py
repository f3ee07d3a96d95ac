import random

import numpy as np
import pytest

from skyfix.llm import ngramjoin, wordhash
from skyfix.llm.components import components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def brute(rows, percent=75):
    sets = []
    for _, text in rows:
        w = (text or "").encode().translate(LOWER).split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("rounds", "most"), [(0, 0), (2, 8)])
def test_equal_to_brute_force(spark, rounds, most):
    r = random.Random(11 + rounds)
    word = lambda: r.choice("abcdefgh") + r.choice("xyz") + str(r.randint(0, 40))
    rows, ids = [], iter(r.sample(range(10_000), 400))
    for _ in range(12):  # families whose members drift apart
        base = [word() for _ in range(r.randint(3, 120))]
        for _ in range(r.randint(1, 9)):
            rows.append((next(ids), " ".join(base)))
            base = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                base[r.randrange(len(base))] = word()
    shared = [word() for _ in range(30)]
    rows += [(next(ids), " ".join(shared + [word() for _ in range(r.choice([2, 8, 200]))])) for _ in range(25)]
    rows += [(next(ids), None), (next(ids), ""), (next(ids), " \n"), (next(ids), "one two"), (next(ids), "ONE\ttwo "), (next(ids), "aé b c d"), (next(ids), "w " * 30_000), (None, rows[0][1]), (None, "no other"), rows[3], rows[3]]
    df = spark.createDataFrame([(*x, 7) for x in rows], "doc_id long, text string, component_id int").repartition(3)
    got = sorted(map(tuple, ngramjoin.similar(df, rounds=rounds, most_rounds=most).collect()), key=str)
    assert got == brute(rows)


def test_empty_and_unlinked_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "x y")], "doc_id long, text string")
    assert ngramjoin.similar(df.limit(0)).collect() == []
    assert sorted(map(tuple, ngramjoin.similar(df).collect())) == [(1, 2, 1), (2, 1, 2)]


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 130)] + [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)]
    got = {x.u: x.v for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {i: i for e in edges for i in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {i: m for i, m in root.items() if i != m}


def test_an_id_with_two_texts_represents_both(spark):
    r = random.Random(6)
    a, b = ([f"{c}{r.randint(0, 10_000)}" for _ in range(60)] for c in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(["new", *a[1:]])), (3, " ".join(["new", *b[1:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted((x.doc_id, x.component_id) for x in ngramjoin.similar(df).collect()) == [(1, 1), (1, 1), (2, 1), (3, 1)]


def test_texts_of_clashing_letters(spark):
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    flip = str.maketrans("ab", "ba")
    rows = [(10 * i + j, t) for i, n in enumerate((1024, 2048, 4096)) for j, t in enumerate((word[:n], word[:n].translate(flip)))]
    rows += [(100 + i, t + " and four words more") for i, t in rows]
    got = ngramjoin.similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted((i, 1, i) for i, _ in rows)


@pytest.mark.parametrize("hashed", [lambda h: h & np.uint64(3), lambda h: h * np.uint64(0)])
def test_sets_and_overlaps_are_of_words_not_hashes(monkeypatch, hashed):
    r = random.Random(9)
    texts = [" ".join(r.choices("abc", k=n)).encode() for n in (0, 1, 2, 4, 5, 6, 30, 60, 60, 200)]
    real, whole = wordhash.runs, wordhash.Words._hashed
    monkeypatch.setattr(wordhash, "runs", lambda h, n: hashed(real(h, n)))
    monkeypatch.setattr(wordhash.Words, "_hashed", lambda self: hashed(whole(self)))
    w = wordhash.Words(texts)
    assert len({(int(i), w.word(k)) for k, i in enumerate(w.ids())}) == len(set(w.ids().tolist())) == len({w.word(k) for k in range(len(w.starts))})
    sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} if len(x) >= 5 else {tuple(x)} if x else set() for x in (t.split() for t in texts)]
    assert ngramjoin.shingles(w, 5)[2].tolist() == [len(s) for s in sets]
    mask = [[0, 1, 2, 3, 4, 5] for _ in texts[6:]]
    member, pivot, overlap, union = ngramjoin._overlaps(w, 5, 6, mask)
    assert {(m, p): (o, u) for m, p, o, u in zip(*(x.tolist() for x in (member, pivot, overlap, union)))} == {(m, p): (len(sets[p] & sets[m + 6]), len(sets[p] | sets[m + 6])) for m in range(4) for p in range(6)}


def test_parities_never_exceed_the_difference():
    r = random.Random(12)
    base = [f"w{r.randint(0, 500)}" for _ in range(400)]
    texts = [" ".join(base).encode(), " ".join(base[: r.randint(50, 380)]).encode(), " ".join(w if r.random() < 0.9 else "x" + w for w in base).encode(), b"", b"one", " ".join(r.sample(base, 300)).encode()]
    w = wordhash.Words(texts)
    keys, _, size = ngramjoin.shingles(w, 5)
    bits = ngramjoin.parities(keys, size)
    ends = np.cumsum(size)
    sets = [set(keys[e - n : e].tolist()) for e, n in zip(ends, size)]
    apart = [[int(np.bitwise_count((a ^ b).view(np.uint64)).sum()) for b in bits] for a in bits]
    assert all(apart[i][j] <= len(sets[i] ^ sets[j]) and (apart[i][j] - len(sets[i] ^ sets[j])) % 2 == 0 for i in range(6) for j in range(6))
    assert apart[0][1] > 20 and bits[3].any() == False  # noqa: E712


def test_texts_of_common_blocks_make_few_pairs(spark, monkeypatch):
    """Texts of 20 out of 40 blocks: all share their rarest n-grams, none link. The last mask must not grow with the square of the texts."""
    r = random.Random(3)
    blocks = [" ".join(f"b{i}x{j}" for j in range(20)) for i in range(40)]
    counts, real = [], ngramjoin._whole_mask
    monkeypatch.setattr(ngramjoin, "_whole_mask", lambda *a: counts.append(real(*a).count()) or real(*a))
    for n in (150, 300):
        rows = [(i, " ".join(blocks[b] for b in sorted(r.sample(range(40), 20)))) for i in range(n)]
        got = ngramjoin.similar(spark.createDataFrame(rows, "doc_id long, text string"))
        assert all(x.component_id <= x.doc_id for x in got.collect())
    assert counts[1] <= max(100, 2.5 * counts[0]), counts


def test_families_around_a_text_that_is_not_the_first(spark):
    """Members at 80 % of their base but below 75 % of each other: only the base ties them."""
    r = random.Random(4)
    rows = []
    for f in range(3):
        base = [f"f{f}w{i}" for i in range(200)]
        for m in range(25):
            own = list(base)
            for k in r.sample(range(0, 200, 8), 4):  # four words, at most twenty n-grams each way
                own[k] = f"new{f}x{m}x{k}"
            rows.append((100 * f + m + 1, " ".join(own)))
        rows.append((100 * f + 50, " ".join(base)))
    got = sorted(map(tuple, ngramjoin.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute(rows) or sorted(got, key=str) == brute(rows)
    assert len({c for *_, c in got}) == 3
