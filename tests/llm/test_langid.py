import itertools
import pathlib
import random
import subprocess
import sys
import zlib

import numpy as np
import pytest

from skyfix.llm import langid

SYLLABLES = {"aa": ["le", "eau", "que", "tion"], "bb": ["sch", "ung", "ein", "ver"], "cc": ["th", "ing", "ow", "er"]}


def _text(r, lang, n):
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(1, 4))) for _ in range(n))


@pytest.mark.parametrize("block", [1, 2, 3, 64])
def test_forward_backward_is_exact(block):
    rng = np.random.default_rng(block)
    k, lengths = 3, np.array([5, 0, 1, 6, 3])
    scores, a = rng.normal(size=(15, k)), np.exp(rng.normal(size=(k, k)))
    want, at = [], 0
    for n in lengths:
        p = np.zeros((n, k))
        for path in itertools.product(range(k), repeat=int(n)):
            w = np.prod([np.exp(scores[at + i, y]) for i, y in enumerate(path)]) * np.prod([a[x, y] for x, y in itertools.pairwise(path)])
            for i, y in enumerate(path):
                p[i, y] += w
        want.append(p / p.sum(axis=1, keepdims=True) if n else p)
        at += n
    assert np.allclose(langid.posteriors(scores, a, lengths, block), np.concatenate(want))


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    k, length = 3, 4
    scores, t, y = rng.normal(size=(8, k)), rng.normal(size=(k, k)), rng.integers(0, k, 8)

    def loss(scores, t):
        total = 0.0
        for s in (0, 4):
            m, gold, before = None, 0.0, None
            for i in range(s, s + length):
                m = (1 if m is None else m @ np.exp(t)) * np.exp(scores[i])
                gold += scores[i, y[i]] + (t[before, y[i]] if before is not None else 0)
                before = y[i]
            total += np.log(m.sum()) - gold
        return total

    by_score, by_pair = langid._lanes_gradient(scores, y, np.exp(t), length)
    for i, j in ((0, 0), (5, 2), (7, 1)):
        d = np.zeros_like(scores)
        d[i, j] = 1e-5
        assert abs((loss(scores + d, t) - loss(scores - d, t)) / 2e-5 - by_score[i, j]) < 1e-4
    for i, j in itertools.product(range(k), repeat=2):
        d = np.zeros_like(t)
        d[i, j] = 1e-5
        assert abs((loss(scores, t + d) - loss(scores, t - d)) / 2e-5 - by_pair[i, j]) < 1e-4


def test_code_switched_words():
    r = random.Random(3)
    m = langid.train([(_text(r, lang, 80), lang) for lang in SYLLABLES for _ in range(60)])
    text = " ".join(_text(r, lang, 12) for lang in ("aa", "bb", "aa", "cc"))
    want = [lang for lang in ("aa", "bb", "aa", "cc") for _ in range(12)]
    got = [x[1] for x in langid.label_words(text, m)]
    assert sum(a == b for a, b in zip(got, want)) >= 45


def test_query_edge_cases(spark):
    r = random.Random(5)
    rows = [(i, _text(r, lang, r.randint(5, 90)), lang, "s") for i, lang in enumerate(list(SYLLABLES) * 80)]
    odd = [(1000, None, "aa", "s"), (1001, "", None, "s"), (1002, "12 !? 9", "bb", "s"), (None, rows[0][1], "aa", "s"), (3, rows[3][1], None, "s"), (1003, _text(r, "bb", 30_000), None, "s"), (1004, "ß", None, "s")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    model = langid.fit(df)
    got = langid.predict(df, model).collect()
    assert len(got) == len(rows) + len(odd)
    by = {}
    for x in got:
        assert 0 <= x.score <= 1 and (x.doc_id is None or x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2))
        by.setdefault(x.doc_id, x)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002)) and by[1003].lang_pred == "bb"
    held = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 1000]
    assert sum(x.lang_pred == rows[x.doc_id][2] for x in held) >= 0.97 * len(held)
    # languages of held-out rows are never learned from
    hidden = spark.createDataFrame([(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string")
    assert langid.fit(hidden).languages == ("aa", "bb", "cc")
    assert langid.predict(df.limit(0), model).collect() == []
    assert [x.lang_pred for x in langid.predict(df.limit(1), langid.fit(df.limit(0))).collect()] == ["und"]


def test_every_language_is_learned(spark):
    r = random.Random(8)
    syllables = {f"l{i:02}": [chr(0x4E00 + 4 * i + j) for j in range(4)] for i in range(66)}
    text = lambda lang: " ".join("".join(r.choices(syllables[lang], k=2)) for _ in range(40))
    rows = [(100 * i + j, text(lang), lang) for i, lang in enumerate(syllables) for j in range(12 if i < 64 else 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, held_out=(1, 1))
    assert model.languages == tuple(syllables)
    rare = langid.predict(df.where("doc_id >= 6400"), model).collect()
    assert [x.lang_pred for x in rare] == [f"l{x.doc_id // 100:02}" for x in rare] and len(rare) == 18
    assert langid.fit(df, held_out=(1, 1), max_languages=2).languages == ("l00", "l01")


def test_a_hundred_languages_within_bounded_memory():
    code = """
import random, resource, sys
sys.path.insert(0, %r)
from skyfix.llm import langid
r = random.Random(4)
syl = [[chr(0x4E00 + 4 * i + j) for j in range(4)] for i in range(100)]
rows = [(" ".join("".join(r.choices(syl[i], k=2)) for _ in range(220)), f"l{i}") for i in range(100) for _ in range(8)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
m = langid.train(rows, epochs=1)
assert len(m.languages) == 100
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss) // 1024)
""" % str(pathlib.Path(langid.__file__).parents[2])
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) < 900  # megabytes of the whole process, the libraries included


@pytest.mark.parametrize("own", [3, 77, 1234, 99_991])
def test_a_language_under_one_id_is_learned(spark, own):
    r = random.Random(own)
    rows = [(200_000 + i, _text(r, "aa", 20), "aa") for i in range(300)]
    many = spark.range(5000).selectExpr(f"cast({own} as long) as doc_id", "concat('schung einver verung ', cast(id % 50 as string), ' einschung ungver') as text", "'bb' as lang")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").unionByName(many)
    model = langid.fit(df, held_out=(1, 1), sample=400)
    assert model.languages == ("aa", "bb")
    got = {x.lang_pred for x in langid.predict(many.limit(50), model).collect()}
    assert got == {"bb"}
