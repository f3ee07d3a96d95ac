r"""Fill-in-middle: two cuts at token bounds, and prefix, suffix and middle behind markers.

Tokens are `[A-Za-z]+|[^A-Za-z]` over code points. A text's tokens are counted once, block by block, and every `STRIDE` tokens a checkpoint keeps the
offsets of its token in bytes and in code points. A cut after so many tokens is found by binary search among the checkpoints and a rescan of at most
`STRIDE` tokens from the one before it: no token list, no offset table of the whole text, and texts of any length cost a block and their checkpoints.

Cuts and form come from the id alone: h1 to h4 are the first four 8-digit groups of the hex SHA-256 of `1:` and the decimal id. Texts that hold a
marker, empty ones and a tenth of the rest stay plain. A marker can't arise where a part meets a marker, as markers begin with `<`, end with `>` and hold neither in
between; so an output and its form give back the text (`restored`).

Defined results: a null text is the empty one (plain, n = 0); a row without an id has the hash of `1:`; rows keep their number, repeated rows are equal. Other columns are never read.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfix.llm.common import map_slices

#: Tokens from checkpoint to checkpoint, and bytes that are looked at together.
STRIDE, BLOCK = 1024, 1 << 18
#: The markers, and of a hundred texts those that are cut, and of those that are cut the ones with the suffix first.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
CUT_PERCENT, SPM_PERCENT = 90, 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _token_starts(block: np.ndarray, after_letter: bool) -> np.ndarray:
    """Whether a token starts at each byte: at code points but letters that follow a letter."""
    letter = _LETTER[block]
    starts = (block & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    if after_letter and len(block):
        starts[0] &= not letter[0]
    return starts


class Checkpoints:
    """Token count of UTF-8 text, and where every stride-th token starts."""

    def __init__(self, data: bytes, stride: int = STRIDE, block: int = BLOCK):
        self.data, self.stride, self.block = data, stride, block
        self.tokens: list[int] = []
        self.bytes: list[int] = []
        self.points: list[int] = []
        self.n = self.n_points = 0
        for at in range(0, len(data), block):
            part = np.frombuffer(data, np.uint8, min(block, len(data) - at), at)
            starts = np.flatnonzero(_token_starts(part, at > 0 and bool(_LETTER[data[at - 1]])))
            point = (part & 0xC0) != 0x80
            marked = starts[-self.n % stride :: stride]
            if len(marked):
                before = np.add.accumulate(point, dtype=np.int64)[marked] - 1  # a token starts with a code point
                self.tokens += range(self.n + -self.n % stride, self.n + len(starts), stride)
                self.bytes += (marked + at).tolist()
                self.points += (before + self.n_points).tolist()
            self.n += len(starts)
            self.n_points += int(np.count_nonzero(point))

    def cut(self, token: int) -> tuple[int, int]:
        """(bytes, code points) before this token; of the count of tokens: of the whole text."""
        if token >= self.n:
            return len(self.data), self.n_points
        i = bisect.bisect_right(self.tokens, token) - 1
        at, points, left = self.bytes[i], self.points[i], token - self.tokens[i]
        width = 8 * self.stride
        while left:  # the token at `at` is counted as 0
            part = np.frombuffer(self.data, np.uint8, min(width, len(self.data) - at), at)
            starts = np.flatnonzero(_token_starts(part, at > 0 and bool(_LETTER[self.data[at - 1]])))
            skip = 1 if len(starts) and starts[0] == 0 and at == self.bytes[i] else 0
            if len(starts) - skip >= left:
                stop = int(starts[left - 1 + skip])
                return at + stop, points + int(np.count_nonzero((part[:stop] & 0xC0) != 0x80))
            left -= len(starts) - skip
            points += int(np.count_nonzero((part & 0xC0) != 0x80))
            at += len(part)
        return at, points


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    h = hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    return tuple(int(h[i : i + 8], 16) for i in (0, 8, 16, 24))


def transform(doc_id: int | None, data: bytes) -> tuple[int, str, int | None, int | None, bytes]:
    """(tokens, form, code points of prefix and of middle, output) of a text in UTF-8."""
    held = Checkpoints(data)
    h1, h2, h3, h4 = draws(doc_id)
    if not data or h3 % 100 >= CUT_PERCENT or PREFIX in data or SUFFIX in data or MIDDLE in data:
        return held.n, "plain", None, None, data
    (a, pa_), (b, pb) = (held.cut(c) for c in sorted((h1 % (held.n + 1), h2 % (held.n + 1))))
    if h4 % 100 < SPM_PERCENT:
        return held.n, "spm", pa_, pb - pa_, b"".join((SUFFIX, data[b:], PREFIX, data[:a], MIDDLE, data[a:b]))
    return held.n, "psm", pa_, pb - pa_, b"".join((PREFIX, data[:a], SUFFIX, data[b:], MIDDLE, data[a:b]))


def restored(output: bytes, form: str) -> bytes:
    """The text, from an output and its form alone."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    if not output.startswith(first):
        raise ValueError(f"an output of form {form} begins with {first.decode()}")
    one = output.index(second, len(first))
    two = output.index(MIDDLE, one + len(second))
    parts = {first: output[len(first) : one], second: output[one + len(second) : two]}
    return parts[PREFIX] + output[two + len(MIDDLE) :] + parts[SUFFIX]


def fill_in_middle(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: id, n, form, prefix_chars, middle_chars, output (binary, UTF-8)."""
    return _mapped(documents, id_column, text_column, "output binary", lambda form, out: (out,))


def digests(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The same with the digests of the output and of the text that it gives back, instead of the output."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return _mapped(documents, id_column, text_column, "output_sha256 string, restored_sha256 string", lambda form, out: (sha(out), sha(restored(out, form))))


def _mapped(documents: DataFrame, id_column: str, text_column: str, schema: str, each) -> DataFrame:
    kinds = [pa.binary() if "binary" in c else pa.string() for c in schema.split(", ")]
    names = ["id", "n", "form", "prefix_chars", "middle_chars", *(c.split(" ")[0] for c in schema.split(", "))]

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, form, a, b, out = transform(i, t or b"")
                made.append((n, form, a, b, *each(form, out)))
            columns = list(zip(*made))
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.string(), pa.int64(), pa.int64(), *kinds]))], names=names)

        return run

    source = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("binary").alias("text"))
    return map_slices(source, make, f"id long, n long, form string, prefix_chars long, middle_chars long, {schema}").withColumnRenamed("id", id_column)
