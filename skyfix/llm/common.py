"""Shared plumbing of the training-data operators: table access, the shared work folder, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python worker handles at once; bounds its memory whatever the Arrow batch holds.
SLICE_BYTES = 4 << 20
#: The session's setting that names the folder which the driver and all executors share.
SHARED = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one. Only on one machine, where the session names none (as in tests), a local one is set."""
    root = spark.conf.get(SHARED, None) or spark.sparkContext.getConf().get(SHARED)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SHARED} to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="skyfix-")
        spark.conf.set(SHARED, root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Whether Spark deletes what a query shuffled as soon as it ends, instead of when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, which outlives any executor. What was shuffled for it is deleted at once, as the table stands for it."""
    session = df.sparkSession
    path, before = workspace(session, name), session.conf.get(CLEANUP, "false")
    session.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        session.conf.set(CLEANUP, before)
    out = session.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again."""
    for t in tables:
        session = t.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(t._written_at)
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(id_column: str, modulus: int):
    """crc32 of the id's decimal text, modulo; null ids count as 0."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % F.lit(modulus), F.lit(0))


#: Rows of an Arrow batch, where the session doesn't say otherwise: whole texts are long, and batches stand in memory several times over.
BATCH_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(session: SparkSession) -> None:
    """Only where the user hasn't named a number (10000 included) neither at the start nor since."""
    if session.conf.get(BATCH_RECORDS) == "10000" and not session.sparkContext.getConf().contains(BATCH_RECORDS):
        session.conf.set(BATCH_RECORDS, "1000")


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about limit bytes (a longer text is a run of its own)."""
    sizes = pa.compute.binary_length(batch.column(batch.schema.get_field_index(text))).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str | T.StructType, text: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow over bounded slices. make() runs once for each task and returns the function for one slice."""

    def run(batches):
        each = make()
        for batch in batches:
            for part in slices(batch, text, limit):
                if (out := each(part)) is not None:
                    yield out

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def appended(df: DataFrame, text: str, make: Callable[[], Callable[[pa.Array], list[pa.Array]]], added: T.StructType, limit: int = SLICE_BYTES) -> DataFrame:
    """df with further columns that the function of make() gives for a slice of texts. Other columns only pass through, whatever their names."""
    names, at = [f"_{i}" for i in range(len(df.columns))], df.columns.index(text)
    plain = T.StructType([*(T.StructField(n, f.dataType) for n, f in zip(names, df.schema.fields)), *(T.StructField(f"_{len(names) + i}", f.dataType) for i, f in enumerate(added.fields))])

    def run(batches):
        each = make()
        for batch in batches:
            for part in slices(batch, names[at], limit):
                yield pa.RecordBatch.from_arrays([*part.columns, *each(part.column(at))], names=plain.names)

    bound_batches(df.sparkSession)
    return df.toDF(*names).mapInArrow(run, plain).toDF(*df.columns, *added.names)


def opened(uri: str):
    """(file system, path) of a folder that all executors share, made if it isn't there."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)
    return system, path


#: Rows of a narrow table that may be sent to every task; more are shuffled.
MOST_SENT = 250_000


def sent(df: DataFrame, name: str, most: int = MOST_SENT) -> DataFrame:
    """A written table of a few narrow columns, to be broadcast if it has no more rows than this."""
    table_ = written(df, name)
    return F.broadcast(table_) if table_.limit(most + 1).count() <= most else table_
