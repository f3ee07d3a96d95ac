import hashlib

import public_tokenizers
from test_decontam import brute as contaminated
from test_ngramjoin import brute as linked
from test_suffixes import brute as repeated
from tokenizers import Tokenizer

import corpus_pipeline
from skyfix.llm import wordhash

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    stage = dict(corpus_pipeline.STAGES)
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = stage["language"](spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() >= 0.97 * len(texts)
    same = [(r.doc_id, r.text) for r in kept.collect()]
    assert all(texts[i] == t for i, t in same)
    assert "und" not in {r.text for r in stage["language"](spark, docs.limit(3).unionByName(spark.createDataFrame([(-5, "12 34", "en", "s", 5)], docs.schema)), SF).collect()}

    unique = stage["near_duplicates"](spark, docs, SF)
    want = sorted(i for i, _, c in linked(list(texts.items())) if i == c)
    assert sorted(r.doc_id for r in unique.collect()) == want and unique.columns == docs.columns

    cut = {r.doc_id: r for r in stage["repeated_passages"](spark, unique, SF).collect()}
    expected = {i: texts[i].encode() for i in want}
    for i, a, b, _, first in sorted(repeated([(i, texts[i]) for i in want], 50), reverse=True):
        if not first:
            data = expected[i]
            starts = wordhash.Words([data]).starts
            expected[i] = data[: starts[a]] + (data[starts[b] :] if b < len(starts) else b"")
    assert {i: r.text for i, r in cut.items()} == {i: d.decode() for i, d in expected.items() if d.split() or not texts[i].split()}
    assert all(r.n_chars == len(r.text) for r in cut.values())

    clean = stage["contamination"](spark, docs, SF)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, *_, bad in contaminated(list(texts.items()), items) if not bad)


def test_run_equals_its_stages(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas().to_dict("records"), docs.schema)
    assert sorted((r.doc_id, r.text) for r in got) == sorted((r.doc_id, r.text) for r in docs.collect()) and len(got) > 100
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in got:
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_stages_of_odd_rows(spark):
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)]
    a, near, other = " ".join(words), " ".join([*words[:-1], "end"]), " ".join(reversed(words))
    long = "sunny river " * 40_000
    schema = "label string, doc_id long, text string, lang string, source string, n_chars long, n_tokens string, row int, leads int"
    rows = [("x", 1, a, "en", None, 5, "t", 0, 0), ("x", 1, a, "en", "s", 5, "t", 0, 0), ("y", 2, near, None, "s", None, None, 0, 0), ("z", None, a, "en", "s", 1, "t", 0, 0), ("z", None, other, "en", "s", 1, "t", 0, 0)]
    rows += [("z", None, other, "en", "s", 1, "t", 0, 0), ("n", 3, None, None, None, None, None, 0, 0), ("n", 3, None, None, None, None, None, 0, 0), ("n", 4, "", "en", "s", 0, "", 0, 0), ("n", 1, "five words and no more", "en", "s", 0, "", 0, 0), ("l", 9, long, "en", "s", 0, "", 0, 0)]
    docs = spark.createDataFrame(rows, schema)
    stage = dict(corpus_pipeline.STAGES)
    got = stage["near_duplicates"](spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, a), (None, other), (3, None), (3, None), (4, ""), (1, "five words and no more"), (9, long)], key=str)
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, SF)
        assert [c for c in out.columns if c not in ("n_tokens", "ids_sha256", "decoded_sha256")] == [c for c in docs.columns if c != "n_tokens"]
        # null and empty texts have no language; the copy of doc 1 without an id is nothing but a passage of it
        assert out.count() == {"language": len(rows) - 3, "near_duplicates": 7, "repeated_passages": len(rows) - 1, "contamination": len(rows), "encoded": len(rows)}[name]
        assert function(spark, docs.limit(0), SF).collect() == []
