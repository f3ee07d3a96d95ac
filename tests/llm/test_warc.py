import base64
import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from skyfix.llm import warc
from skyfix.llm.common import workspace


@given(st.lists(st.lists(st.integers(0, 20)), max_size=7))
def test_loser_tree(runs):
    runs = [sorted(r) for r in runs]
    assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_url_key():
    assert warc.url_key("HTTP://www.Example.com:8080/A/b?q=1#top") == "com,example:8080)/a/b?q=1"
    assert warc.url_key("https://m.x.net") == "net,x,m)/" and warc.url_key(None) == "" and warc.url_key("not a url") == "not a url"


def test_damage_is_found():
    data = bytearray(warc.make_record(1, "http://a/ü b", b"payload", "20200101000000", None))
    assert warc.parse_record(bytes(data))[1].endswith(b"payload")
    data[-8] ^= 1
    with pytest.raises(warc.BadRecord):
        warc.parse_record(bytes(data))


ROWS = [
    (5, "http://b.com/1", "same"), (3, "http://a.com/2", "same"), (9, "http://a.com/1", "same"), (1, None, None), (2, "http://a.com/1", ""), (4, "x y\nz", "é" * 100_000), (None, "http://c", "same"), (None, "http://c", "only null"),
    (7, "http://d", "twice"), (7, "http://d", "twice"), (8, "http://e", "a\r\n\r\nWARC/1.1\r\n"),
]


@pytest.mark.parametrize("least", [0, 5])
def test_equal_to_brute_force(spark, least):
    df = spark.createDataFrame([(*r, "x", "y") for r in ROWS], "page_id long, url string, html string, offset string, digest string")
    got = sorted((tuple(r) for r in warc.round_trip(df, least).collect()), key=str)
    want = []
    for page, _, html in ROWS:
        data = (html or "").encode()
        ids = [p for p, _, h in ROWS if (h or "") == (html or "") and p is not None]
        first = min(ids, default=None)
        revisit = len(data) >= least and first is not None and page != first
        want.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)


def test_histories_are_globally_ordered(spark):
    r = random.Random(1)
    rows = [(i, f"http://{r.choice('abc')}.com/{r.randint(0, 5)}", str(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    runs = warc.write_archives(df, workspace(spark, "warc"), file_bytes=3000)
    assert runs.select("run").distinct().count() > 5
    got = [(x.url_key, x.stamp, x.page_id) for x in warc.merge_index(runs).collect()]
    assert got == sorted((warc.url_key(u), warc.stamp_of(i), i) for i, u, _ in rows)
    assert warc.round_trip(df.limit(0)).collect() == []


@pytest.mark.parametrize(("per_range", "fan_in", "chunk"), [(1 << 15, 256, 512), (40, 3, 4), (7, 2, 1)])
def test_merges_of_many_runs(spark, per_range, fan_in, chunk):
    r = random.Random(2)
    rows = [(i, f"http://{r.choice('abcé')}.com/{r.randint(0, 3)}" if i % 9 else None, str(i)) for i in range(400)]
    df = spark.createDataFrame([*rows, (None, None, "x"), rows[3]], "page_id long, url string, html string").repartition(4)
    runs = warc.write_archives(df, workspace(spark, "warc"), file_bytes=1500, chunk=chunk)
    assert runs.select("run").distinct().count() > 40
    got = [(x.url_key, x.stamp, x.page_id) for x in warc.merge_index(runs, per_range, fan_in, chunk).collect()]
    want = sorted(((warc.url_key(u), warc.stamp_of(i), i) for i, u, _ in [*rows, (None, None, "x"), rows[3]]), key=warc.order_of)
    assert got == want


def test_a_merge_holds_one_chunk_of_each_run(tmp_path):
    for n in range(100):
        w = warc.RunWriter(f"file://{tmp_path}/run{n}", 8)
        for i in range(80):
            w.add((f"k{i:03}", f"{n:03}", i, "u", "f", i, 1))
        assert w.close().num_rows == 10
    read = {}

    def counted(n):
        for i, capture in enumerate(warc.read_run(f"file://{tmp_path}/run{n}", range(10))):
            read[n] = i
            yield capture

    for at, capture in enumerate(warc.LoserTree([counted(n) for n in range(100)], warc.order_of)):
        assert capture[0] == f"k{at // 100:03}" and max(read.values()) - min(read.values()) <= 1
