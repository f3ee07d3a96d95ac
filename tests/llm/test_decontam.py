import hashlib
import random
import re

import numpy as np
import pytest

from skyfix.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(docs, items, w=13):
    split = lambda t: WORD.findall((t or "").translate(LOWER))
    out = []
    for doc, text in docs:
        words, hit, found = split(text), set(), set()
        for item, it in items:
            iw = split(it)
            n = min(w, len(iw))
            for k in range(len(iw) - n + 1 if n and item is not None else 0):
                for a in range(len(words) - n + 1):
                    if words[a : a + n] == iw[k : k + n]:
                        hit |= set(range(a, a + n))
                        found.add(item)
        ids = ",".join(sorted(map(str, found)))
        out.append((doc, len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(words)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [32 << 20, 60])
def test_equal_to_brute_force(spark, block):
    r = random.Random(5)
    say = lambda n: " ".join(r.choices(["a", "Bé", "c9", "日本", "e_f", "g"], k=n))
    items = [(1, say(20)), (2, say(5)), (10, say(13)), (3, None), (4, "!!"), (None, say(3)), (2, say(14)), (7, "a")]
    docs = [(i, say(r.randint(0, 40))) for i in range(20)] + [(90 + k, f"{say(4)} {t} {say(300)}") for k, (_, t) in enumerate(items) if t]
    docs += [(5, None), (6, ""), (None, items[0][1]), (8, items[1][1]), (8, items[1][1]), (9, "x " * 30000 + items[2][1])]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, n_words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = decontam.decontaminate(d, b, block_bytes=block).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert decontam.decontaminate(d.limit(0), b).collect() == []
    assert [r.contaminated for r in decontam.decontaminate(d, b.limit(0)).collect()] == [False]


def test_clashing_windows_get_other_hashes(monkeypatch):
    real, calls = decontam._hash, []

    def weak(ids, starts, n, seed):
        calls.append(seed)
        return real(ids, starts, n, seed) & (np.uint64(1) if seed == n else np.uint64(2**64 - 1))

    monkeypatch.setattr(decontam, "_hash", weak)
    index = decontam.Index([(1, b"a b c d e f"), (2, b"b c d x"), (3, b"a b")], 3)
    assert [len(x.hashes) for x in index.windows] == [1, 5] and max(calls) > 3
    index.order_by_rarity({b"a": 3, b"b": 2, b"c": 9, b"d": 9, b"e": 9, b"f": 9, b"x": 0})
    words = [index.vocabulary.get(w, -1) for w in b"z a b c d x b c".split()]
    a, n, kind, w = index.find(np.array(words, np.int32), np.zeros(8, np.int64), np.full(8, 8))
    assert sorted(zip(a.tolist(), n.tolist())) == [(1, 2), (1, 3), (2, 3), (3, 3)]


def test_an_index_is_small():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(20_000)]
    items = [(i, " ".join(r.choices(vocabulary, k=1000)).encode()) for i in range(300)]
    index = decontam.Index(items, 13)
    index.order_by_rarity({})
    held = index.words.nbytes + sum(x.hashes.nbytes + x.places.nbytes + x.first_item.nbytes + x.items.nbytes for x in index.windows) + index.offsets.nbytes + index.lengths.nbytes + index.first.nbytes
    assert held < 56 * 300_000
