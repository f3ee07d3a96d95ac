import random

import numpy as np
import public_tokenizers
import pytest

from skyfix.llm import tokencount
from skyfix.llm.common import opened, workspace

END = 50256


@pytest.mark.parametrize(("block", "group"), [(2, 2), (7, 1), (64, 3), (1 << 20, 256)])
def test_scan_of_foreign_files(spark, block, group):
    r = random.Random(block)
    folder = workspace(spark, "flat")
    system, path = opened(folder)
    want, listed = [], []
    for f in range(6):
        docs = [r.randint(0, 9) if r.random() < 0.8 else 120 for _ in range(r.randint(0, 12))]
        ids = [x for n in docs for x in [*(r.randint(0, 50255) for _ in range(n)), END]]
        rest = r.choice([0, 0, 5, 90]) if f else 0
        ids += [1] * rest
        with system.open_output_stream(f"{path}/f{f}") as out:
            out.write(np.array(ids, "<u2").tobytes())
        listed.append((f"f{f}", 2 * len(ids)))
        want += [(f"f{f}", i, n, True) for i, n in enumerate(docs)] + [(f"f{f}", len(docs), rest, False)] * (rest > 0)
    files = spark.createDataFrame(listed, "file string, file_bytes long")
    assert sorted(tuple(x) for x in tokencount.scan(spark, files, folder, END, block_bytes=block, group=group).collect()) == sorted(want)


def test_query_edge_cases(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = [(1, None), (2, ""), (None, "Hello <|endoftext|> world"), (4, "ab " * 50_000), (4, "ab " * 50_000), (5, "é\n\n")]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, n_tokens int")
    enc = tokencount.encoding(path, public_tokenizers.PATTERN)
    got = tokencount.count_tokens(df, path, public_tokenizers.PATTERN, END, block_bytes=1000).select("doc_id", "n_tokens").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, len(enc.encode_ordinary(t or ""))) for i, t in rows), key=str)
    assert tokencount.count_tokens(df.limit(0), path, public_tokenizers.PATTERN, END).collect() == []
