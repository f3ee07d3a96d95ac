import itertools

import pytest

from skyfix.llm import audit


def fails(text):
    words = [w for w in text.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    out = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text)) + "D" * any(c in "#$%&*|" for c in text)
    return out


def brute(docs, labels):
    """Every order run over every document."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    bad = [fails(t or "") + "E" * (i is not None and i > least[t or ""]) for i, t, _ in docs]
    out, shapley = {}, {}
    for part in {s or "" for *_, s in docs}:
        own = [(i, f) for (i, _, s), f in zip(docs, bad) if (s or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                lost = [(i, f) for i, f in left if x in f]
                failed = sum(x in f for _, f in own)
                left = [(i, f) for i, f in left if x not in f]
                out[part, "".join(order), step] = [len(left), len(lost), failed - len(lost), sum(f == x for _, f in own), sum(i in good for i, _ in lost if i is not None), sum(i in toxic for i, _ in lost if i is not None)]
                shapley[part, x] = shapley.get((part, x), 0) + len(lost)
    return sorted((p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items())


def test_equal_to_running_every_order(spark):
    words = [f"w{i}" for i in range(400)]
    plain, few, same, caps = " ".join(words), "short one", "again " * 300, " ".join(w.upper() + "X" for w in words)
    docs = [(1, plain, "a"), (2, plain, "b"), (2, plain, "a"), (3, few, "a"), (4, few, None), (5, few, ""), (6, same, "b"), (7, caps + " #", "b"), (8, caps, "a"), (9, None, "a"), (10, "", "a"), (None, few, "a"), (None, few, "a"), (None, None, None), (11, "é " * 250 + "|", "c")]
    docs += [(12, "one\x0btwo\x85three   four", "c"), (13, "Ab" * 50, "c"), (14, "A" + "b" * 49, "c"), (15, "x\ny " * 300_000, "c"), (0, same, "a"), (-3, "short one", "d")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, 0, 1), (7, 1, 1), (9, None, 1), (None, 1, 1), (77, 1, 1), (6, 1, None)]
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, source string, quality int, part string").repartition(3)
    got = audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.collect())) == brute(docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_sums_are_inverted_exactly(spark):
    docs = spark.createDataFrame([(i, f"{'Q' * (i % 3)} {'x ' * (i % 7 * 60)}{'$' * (i % 2)}", "s") for i in range(60)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    sums = audit.parities(docs, labels).collect()[0]
    cells = audit.cells(audit.parities(docs, labels)).collect()[0].cells
    assert sums.s0 == sum(cells) == 60 and min(cells) >= 0
    assert all(sums[f"s{k}"] == sum(c * (-1) ** (m & k).bit_count() for m, c in enumerate(cells)) for k in range(32))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert audit.audit(docs.limit(0), labels).collect() == []
    assert sum(r.removed for r in audit.audit(docs, labels.limit(0)).collect()) == 120


@pytest.mark.parametrize("mask", range(32))
def test_the_closed_form_of_a_mask(mask):
    firsts = [next((x for x in order if mask >> x & 1), None) for order in itertools.permutations(range(5))]
    assert all(firsts.count(f) == (120 // mask.bit_count() if mask >> f & 1 else 0) for f in range(5))
