"""Token counts by separator scan of flat token files.

A token file is nothing but ids of fixed width (little-endian), every document's followed by the end-of-document id; there is no index.
Files are read in byte ranges, each a row of a plan: a block's search for separators is one vectorised comparison, and gives the
lengths between its separators, what stands before the first and after the last. Blocks are stitched by a prefix scan over
these: a document's count is what its blocks hold together, also where it covers many blocks. The scan runs over
a row for each block: first over groups of blocks, then inside each group, so that no task has to hold a whole large file's blocks.

`write_token_files` makes such files of a table of texts, and a manifest of which document stands where, since the files can't say.

Defined results: null or empty texts are documents of 0 tokens; ids of rows may be null or repeat, as rows stay apart; ids after the last
separator of a file are one more document, marked as not terminated; an empty file has no document. Other columns are never read.
"""

from __future__ import annotations

import base64
import functools
import uuid

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyfix.llm.common import opened, slices, workspace, written

BLOCK_BYTES, FILE_BYTES, GROUP = 1 << 20, 128 << 20, 256


@functools.lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def write_token_files(documents: DataFrame, folder: str, vocabulary_path: str, pattern: str, separator: int, width: int = 2, id_column: str = "doc_id", text_column: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes flat files of ids; the manifest (id, file, file_bytes, ordinal) as a written table."""
    kind = dict(documents.select(id_column).dtypes)[id_column]
    ids = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    schema = f"id {kind}, file string, file_bytes long, ordinal long"

    def run(batches):
        enc, end = encoding(vocabulary_path, pattern), np.array([separator], f"<u{width}").tobytes()
        system, path = opened(folder)
        attempt = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
        out, file, number, size, own = None, "", 0, 0, []

        def closed():
            out.close()
            n = sum(map(len, own))
            return pa.RecordBatch.from_arrays([pa.concat_arrays(own), pa.array([file] * n), pa.array([size] * n, pa.int64()), pa.array(range(n), pa.int64())], names=["id", "file", "file_bytes", "ordinal"])

        try:
            for batch in batches:
                for part in slices(batch):
                    if out is None:
                        file = f"tokens-{attempt}-{number:04d}.bin"
                        out, number, size, own = system.open_output_stream(f"{path}/{file}", compression=None), number + 1, 0, []
                    data = b"".join(x for t in part.column(1).to_pylist() for x in (np.array(enc.encode_ordinary(t or ""), f"<u{width}").tobytes(), end))
                    out.write(data)
                    size += len(data)
                    own.append(part.column(0))
                    if size >= file_bytes:
                        yield closed()
                        out = None
            if out is not None:
                yield closed()
                out = None
        finally:
            if out is not None:
                out.close()

    return written(ids.mapInArrow(run, schema), "token-manifest")


def scan(spark: SparkSession, files: DataFrame, folder: str, separator: int, width: int = 2, block_bytes: int = BLOCK_BYTES, group: int = GROUP) -> DataFrame:
    """Documents in files (file, file_bytes): file, ordinal, n_tokens, terminated."""
    step = block_bytes // width * width
    last = F.floor((F.col("file_bytes") - 1) / step)
    blocks = files.where(F.col("file_bytes") > 0).select("file", "file_bytes", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("block"))

    def run(batches):
        system, path = opened(folder)
        for batch in batches:
            rows = []
            for file, total, block in zip(*(c.to_pylist() for c in batch.columns)):
                with system.open_input_file(f"{path}/{file}") as source:
                    data = np.frombuffer(source.read_at(min(step, total - block * step), block * step), f"<u{width}")
                at = np.flatnonzero(data == separator)
                inner = np.diff(at) - 1
                rows.append((file, block, len(data), len(at), int(at[0]) if len(at) else len(data), len(data) - 1 - int(at[-1]) if len(at) else len(data), inner.tolist(), total - block * step <= step))
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_()]
            names = ["file", "block", "ids", "separators", "head", "tail", "inner", "final"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    found = blocks.repartition(F.col("file"), F.col("block")).mapInArrow(run, "file string, block int, ids long, separators long, head long, tail long, inner array<long>, final boolean")
    found = written(found.withColumn("group", F.floor(F.col("block") / group).cast("int")), "token-blocks")

    # (separators, ids since the last of them, or all) of a group; then of all groups before it; then of all blocks before a block
    def since(span):
        """Ids since the last separator in the rows of a window, with how many ids there are up to that row's end."""
        return F.last(F.when(F.col("separators") > 0, F.col("upto") - F.col("tail")), ignorenulls=True).over(span)

    def before(order):
        return order.rowsBetween(Window.unboundedPreceding, -1)

    inside = Window.partitionBy("file", "group").orderBy("block")
    own = found.select("file", "group", "block", "ids", "separators", "tail").withColumn("upto", F.sum("ids").over(inside)).groupBy("file", "group").agg(F.max("upto").alias("ids"), F.sum("separators").alias("separators"), F.max(F.when(F.col("separators") > 0, F.col("upto") - F.col("tail"))).alias("mark"))
    own = own.withColumn("tail", F.when(F.col("separators") > 0, F.col("ids") - F.col("mark")).otherwise(F.col("ids")))
    across = Window.partitionBy("file").orderBy("group")
    own = own.withColumn("upto", F.sum("ids").over(across))
    groups = own.select("file", "group", F.coalesce(F.sum("separators").over(before(across)), F.lit(0)).alias("docs0"), (F.coalesce(F.sum("ids").over(before(across)), F.lit(0)) - F.coalesce(since(before(across)), F.lit(0))).alias("open0"))
    rows = found.join(groups, ["file", "group"]).withColumn("upto", F.sum("ids").over(inside))
    seen, mark = F.coalesce(F.sum("ids").over(before(inside)), F.lit(0)), since(before(inside))
    rows = rows.withColumn("docs", F.col("docs0") + F.coalesce(F.sum("separators").over(before(inside)), F.lit(0))).withColumn("open", F.when(mark.isNull(), F.col("open0") + seen).otherwise(seen - mark))
    first = F.when(F.col("separators") > 0, F.array(F.col("open") + F.col("head")))
    ended = F.concat(F.coalesce(first, F.array().cast("array<bigint>")), F.col("inner"))
    left = F.when(F.col("separators") > 0, F.col("tail")).otherwise(F.col("open") + F.col("ids"))
    rest = F.when(F.col("final") & (left > 0), F.array(left)).otherwise(F.array().cast("array<bigint>"))
    docs = rows.select("file", "docs", F.col("separators"), F.posexplode(F.concat(ended, rest)).alias("place", "n_tokens"))
    return docs.select("file", (F.col("docs") + F.col("place")).alias("ordinal"), "n_tokens", (F.col("place") < F.col("separators")).alias("terminated"))


def count_tokens(documents: DataFrame, vocabulary_path: str, pattern: str, separator: int, width: int = 2, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: id, file, ordinal, n_tokens, from files written into the shared folder and scanned."""
    spark, folder = documents.sparkSession, workspace(documents.sparkSession, "tokens")
    manifest = write_token_files(documents, folder, vocabulary_path, pattern, separator, width, id_column, text_column)
    files = manifest.select("file", "file_bytes").distinct()
    found = scan(spark, files, folder, separator, width, block_bytes)
    return manifest.join(found, ["file", "ordinal"]).select(F.col("id").alias(id_column), "file", "ordinal", "n_tokens")
