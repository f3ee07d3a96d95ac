import hashlib
import random
import re

import pytest

from skyfix.llm import middle


def brute(doc_id, text):
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "", re.DOTALL)
    h = hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n, t = len(tokens), text or ""
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def _texts():
    r = random.Random(5)
    pieces = ["word", "Z", " ", "\n", "é", "日本", "😀", "12", "<", "S>", "<P", ">", "\x00", "--", "A" * 40]
    out = [None, "", "a", "é", "<", "<P>", "x<S>y", "<M", "a<", "<<S", "only letters".replace(" ", "")]
    return out + ["".join(r.choices(pieces, k=r.randint(1, 300))) for _ in range(300)] + ["L" * 700_000 + "é", "日" * 200_000, "word " * 200_000]


@pytest.mark.parametrize(("stride", "block"), [(1, 1), (3, 7), (64, 50), (1024, 1 << 18)])
def test_every_cut_is_where_the_tokens_end(stride, block):
    for text in [t for t in _texts() if t and len(t) < 4000][:120]:
        tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
        held = middle.Checkpoints(text.encode(), stride, block)
        assert (held.n, held.n_points, len(held.tokens)) == (len(tokens), len(text), -(-len(tokens) // stride))
        for c in {0, 1, len(tokens) // 3, len(tokens) // 2, len(tokens) - 1, len(tokens)}:
            before = "".join(tokens[:c])
            assert held.cut(c) == (len(before.encode()), len(before))


def test_equal_to_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(_texts())] + [(None, "no id at all"), (7, "twice"), (7, "twice"), (-12, "negative id")]
    df = spark.createDataFrame([(*x, 1, "f") for x in rows], "doc_id long, text string, n int, form string")
    key = lambda r: str(r[:2])
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, bytes(r.output).decode()) for r in middle.fill_in_middle(df).collect()), key=str)
    assert got == sorted(((i, *brute(i, t)) for i, t in rows), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = sorted(map(tuple, middle.digests(df).collect()), key=key)
    assert got == sorted(((i, *(w := brute(i, t))[:4], sha(w[4]), sha(t or "")) for i, t in rows), key=key)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    assert middle.digests(df.limit(0)).collect() == []


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_parts_that_end_like_markers(form):
    for p in (b"", b"<", b"<S", b"a<P", b"S>"):
        for s in (b"", b">", b"P>", b"M>", b"<"):
            for m in (b"", b"S>", b"<", b"<M"):
                out = b"<P>" + p + b"<S>" + s + b"<M>" + m if form == "psm" else b"<S>" + s + b"<P>" + p + b"<M>" + m
                assert middle.restored(out, form) == p + m + s
    with pytest.raises(ValueError):
        middle.restored(b"no marker", form)
