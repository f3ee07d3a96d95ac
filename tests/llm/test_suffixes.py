import random

import pytest

from skyfix.llm import queries, suffixes

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def brute(rows, m):
    docs = [(d, t, (t or "").encode().translate(LOWER).split()) for d, t in rows]
    key = lambda d: (1 << 63) - 1 if d is None else d
    holders: dict = {}
    for i, (_, _, w) in enumerate(docs):
        for s in range(len(w) - m + 1):
            holders.setdefault(tuple(w[s : s + m]), set()).add(i)
    out = []
    for i, (d, _, w) in enumerate(docs):
        kept, lost = set(), set()
        for s in range(len(w) - m + 1):
            h = holders[tuple(w[s : s + m])]
            if len(h) > 1:
                (kept if key(d) == min(key(docs[j][0]) for j in h) else lost).update(range(s, s + m))
        for mask, flag in ((kept, True), (lost - kept, False)):
            own = sorted(mask)
            runs = [[x, x + 1] for x in own[:1]]
            for x in own[1:]:
                if x == runs[-1][1]:
                    runs[-1][1] += 1
                else:
                    runs.append([x, x + 1])
            out += [(d, a, b, b - a, flag) for a, b in runs]
    return sorted(out, key=str)


@pytest.mark.parametrize(("m", "k", "segment"), [(50, 8, 1 << 14), (12, 4, 1 << 14), (12, 4, 7)])
def test_equal_to_brute_force(spark, m, k, segment):
    r = random.Random(m)
    word = lambda: r.choice("abcdefgh") + r.choice("xyzé") + str(r.randint(0, 60))
    passages = [[word() for _ in range(r.choice([m - 1, m, m + 1, 3 * m]))] for _ in range(8)] + [["la"] * 2 * m]
    rows, ids = [], r.sample(range(10_000), 60)
    for d in ids:
        parts = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            parts += [word() for _ in range(r.randint(0, 40))] + p[a : a + r.randint(m // 2, 3 * m)]
        rows.append((d, " ".join(parts).capitalize()))
    rows += [(20_001, None), (20_002, ""), (20_003, "a b"), (None, " ".join(passages[3])), (20_004, "\n".join(passages[3])), (20_005, "x " * 20_000), rows[0], (rows[1][0], " ".join(passages[2]))]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, kept int").repartition(3)
    got = sorted((tuple(x) for x in suffixes.repeats(df, m, k, segment=segment).drop("digest").collect()), key=str)
    assert got == brute(rows, m)
    assert suffixes.repeats(df.limit(0), m, k).collect() == []


def test_cutting_keeps_the_first_copy(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(2, f"b one\n{passage} b two", 0), (1, f"a {passage}", 0), (3, passage, 0), (4, "clean", 5), (5, None, None), (None, f"n {passage} m", 0)]
    df = spark.createDataFrame([("x", *r) for r in rows], "_key string, doc_id long, text string, n_chars long")
    got = sorted((tuple(r)[1:] for r in suffixes.without_repeats(df).collect() if r[0] == "x"), key=str)
    assert got == sorted([(1, f"a {passage}", 0), (2, "b one\nb two", 11), (4, "clean", 5), (5, None, None), (None, "n m", 3)], key=str)


def test_one_passage_in_two_repeated_contexts(spark, tmp_path):
    run = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    p = run("p", 60)
    rows = [(1, f"{run('a', 20)} {p}"), *[(d, f"{run(f'own{d}-', 5)} {x} {p} {y}") for d, x, y in ((2, "x1 x2", "y1"), (3, "x1 x2", "y1"), (4, "u1", "v1 v2"), (5, "u1", "v1 v2"))]]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text.split() for r in suffixes.without_repeats(docs).collect()}
    assert got == {1: rows[0][1].split(), 2: [*run("own2-", 5).split(), "x1", "x2", "y1"], 3: run("own3-", 5).split(), 4: [*run("own4-", 5).split(), "u1", "v1", "v2"], 5: run("own5-", 5).split()}
    listed = sorted(map(tuple, queries.op6_suffix_dedup(spark, str(tmp_path)).collect()))
    assert listed == [(1, 20, 80, 60, True), (2, 5, 68, 63, True), (2, 7, 67, 60, False), (3, 5, 68, 63, False), (4, 5, 68, 63, True), (4, 6, 66, 60, False), (5, 5, 68, 63, False)]


def test_texts_of_clashing_letters(spark):
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    rows = []
    for i, n in enumerate((1024, 2048, 4096)):
        x = word[:n]
        for j, y in enumerate((x, x.translate(str.maketrans("ab", "ba")))):
            rows.append((10 * i + j, " ".join([y, *(f"w{i}-{k}" for k in range(60)), y])))
    got = suffixes.repeats(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.start_word, r.end_word, r.kept) for r in got] == [(10 * i + j, 1, 61, j == 0) for i in range(3) for j in range(2)]
