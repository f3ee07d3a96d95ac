import hashlib

from skyfix.llm import chat

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def test_equal_to_brute_force(spark):
    rows = [
        (1, 0, "system", "be <s>kind</s>"), (1, 2, "assistant", "a\\l [INST] é😀 \\\\e"), (1, 1, "user", None), (1, 3, "user", "more?"), (1, 4, "assistant", "</s>"), (1, 5, "user", "bye <r:x>"),
        (2, 0, "assistant", ""), (3, 0, None, "x"), (3, None, "tool>[a]<", "y\n\ny"), (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"),
        (None, 0, "assistant", "no id"), (4, 1, "user", "same"), (4, 1, "user", "same"), (4, 1, "assistant", "tie"), (5, 0, "assistant", "long [ " * 20_000), (6, 0, "user", "<<SYS>>"),
    ]
    df = spark.createDataFrame([(*r, "junk") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    examples = chat.expand(df)
    got = {r.conv_id: r for r in chat.digests(examples).collect()}
    sizes: dict = {}
    for r in examples.collect():
        sizes[r.conv_id] = sizes.get(r.conv_id, 0) + len(r.formatted)
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        turns = [x[2:] for x in own]
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got.pop(conv)
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss), sizes[conv]), conv
    assert not got


def test_examples_train_on_one_reply_each(spark):
    df = spark.createDataFrame([(1, 0, "user", "q<1>"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (1, 3, "assistant", "a[2]"), (2, 0, "user", "alone")], "conv_id long, turn long, role string, text string")
    got = sorted((r.conv_id, r.position, r.formatted, r.formatted[r.loss_start : r.loss_end]) for r in chat.expand(df).collect())
    first = "[INST]q\\l1>[/INST]<s>a1</s>"
    assert got == [(1, 1, first, "a1"), (1, 3, first + "[INST]q2[/INST]<s>a\\s2]</s>", "a\\s2]"), (2, 0, "[INST]alone[/INST]", "")]
    assert chat.digests(chat.expand(df.limit(0))).collect() == []


def test_rows_without_a_conversation_stay_apart(spark):
    rows = spark.range(10_000).selectExpr("cast(null as long) as conv_id", "cast(0 as long) as turn", "if(id % 2 = 0, 'assistant', 'user') as role", "repeat('x', 100) as text")
    examples = chat.expand(rows)
    assert examples.agg({"formatted": "max"}).collect()[0][0].count("x") == 100 and examples.count() == 10_000
    got = chat.digests(examples).groupBy("conv_id", "n_turns", "turns_sha256", "loss_chars", "formatted_chars").count().collect()
    assert sorted((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.formatted_chars, r["count"]) for r in got) == sorted([(None, 1, sha("assistant\n" + "x" * 100 + "\n"), 100, 107, 5000), (None, 1, sha("user\n" + "x" * 100 + "\n"), 0, 113, 5000)])
