import math
import random
import zlib

import zstandard

from skyfix.llm import quality


def _rows(n):
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdeforstin", k=r.randint(2, 9)))
    out = []
    for i in range(n):
        good = i % 3 != 0
        words = [word() for _ in range(r.randint(20, 200))]
        out.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words), int(good)))
    return out


def test_learns_and_keeps_to_its_fold(spark):
    rows = _rows(600)
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(1000, None, 0.0), (1001, "", 0.0), (None, "x", 0.0), (3, rows[3][1], 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(7777, 1, 0), (None, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == 604 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    truth = {i: q for i, _, q in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    # held-out labels are never learned from
    flipped = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, 0) for i, _, q in rows] + [(7777, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    again = quality.score(docs, quality.fit(docs, flipped)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert [r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()] == [0.5]
    assert quality.score(docs.limit(0), quality.fit(docs, labels)).collect() == []
    assert 0.9 < quality.score(docs, quality.fit(docs, labels.limit(1))).collect()[0].score <= 1 or zlib.crc32(b"1") % 5 == 0


def test_scores_are_those_of_plain_compression(spark):
    rows = _rows(200)
    docs = spark.createDataFrame([*((i, t, 1, "x") for i, t, _ in rows), (900, "word " * 300_000, 1, "x"), (901, "é日本", 1, "x"), (902, None, 1, "x")], "doc_id long, text string, predicted int, held_out string")
    model = quality.fit(docs, spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int"))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for i, t, *_ in docs.collect():
        data = (t or "").encode()
        sizes = [len(zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress(data)) for d in (model.good, model.bad)]
        n = len(data) + 16
        ratio = sizes[0] / n
        x = [1, 20 * (sizes[1] - sizes[0]) / n, ratio, max(0.3 - ratio, 0) * 10, max(0.15 - ratio, 0) * 20, math.log(n)]
        assert abs(got[i] - 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(model.weights, x))))))) < 1e-9


def test_an_id_of_many_rows_is_learned_from_once(spark, monkeypatch):
    rows = _rows(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").unionByName(spark.range(5000).selectExpr("cast(1 as long) as doc_id", "concat('more ', cast(id as string)) as text"))
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    seen, real = [], quality._dictionary
    monkeypatch.setattr(quality, "_dictionary", lambda samples, size: seen.append(len(samples)) or real(samples, size))
    model = quality.fit(docs, labels)
    assert sum(seen) <= 200
    assert model == quality.fit(docs.repartition(7), labels.repartition(3))
