import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skyfix.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = "ab'sdltrevm é É123 ²½ΣςİǅÅ日本語́̀가\n\t\x1c\x85　!?_-$😀𝒳\x00<|>"


@given(st.lists(st.one_of(st.text(ODD, max_size=12), st.sampled_from(["<|endoftext|>", "<|startoftext|>", "we'll", "banana"])), max_size=8).map("".join), st.sampled_from([(1 << 16, 2048), (20, 3), (7, 1)]))
@settings(max_examples=150, deadline=None)
def test_equal_to_the_library_for_any_piece_size(text, sizes):
    v = bpe.vocabulary(PATH)
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert bpe.Encoder(v, *sizes).encode(text) == want
    assert [i for lists in bpe.Encoder(v, *sizes).slice([text]) for ids in lists for i in ids] == want
    d = bpe.Decoder(v)
    assert "".join(d.push(want[k : k + 3]) for k in range(0, len(want), 3)) + d.finish() == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("word", ["an" * 4000 + "a", "the" * 3000, "!" * 9000, "".join(random.Random(1).choices("abcdefghij", k=9000))])
def test_long_words_stream_with_the_merge_lists_lookahead(word):
    v = bpe.vocabulary(PATH)
    t = bpe.WordTransducer(v, 64)
    ids, most = [], 0
    for k in range(0, len(word), 100):
        ids += t.push(word[k : k + 100])
        most = max(most, len(t.held))
    assert ids + t.finish() == LIBRARY.encode(word, add_special_tokens=False).ids
    assert most <= v.lookahead + 64 + 100


def test_bytes_form_holds_back_unfinished_characters():
    v = bpe.vocabulary(PATH)
    ids = LIBRARY.encode("日本語 é!", add_special_tokens=False).ids
    d = bpe.Decoder(v, "bytes")
    assert "".join(d.push([i]) for i in ids) + d.finish() == "日本語 é ! "


def test_query_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "Hello <|endoftext|> World's", "x"), (4, "ab " * 40000, "x"), (4, "ab " * 40000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = [tuple(r) for r in bpe.encode_decode(df, PATH).collect()]
    want = []
    for i, text, _ in rows:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False))))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe.encode_decode(df.limit(0), PATH).collect() == []


def test_every_code_point_as_in_the_library():
    v = bpe.vocabulary(PATH)
    every = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    wrong = []
    for a in range(0, len(every), 8192):
        texts = [f"ab{c}Cd {c}1 x{c}̣ x́{c}̣" for c in map(chr, every[a : a + 8192])]
        want = LIBRARY.encode_batch(texts, add_special_tokens=False)
        got = bpe.Encoder(v).slice(texts)
        wrong += [every[a + i] for i, (w, g) in enumerate(zip(want, got)) if w.ids != [x for ids in g for x in ids]]
    assert wrong == []


@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), st.sampled_from([(1 << 16, 2048), (5, 1)]))
@settings(max_examples=300, deadline=None)
def test_any_characters_as_in_the_library(text, sizes):
    assert bpe.Encoder(bpe.vocabulary(PATH), *sizes).encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids
