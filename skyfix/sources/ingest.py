"""Ingested frames as a committed folder: pictures in shards, frames.csv and manifest.json.

Writing is a data source with a two-phase commit. Each task writes its pictures, reads them back, and leaves what it wrote as a piece of the index; the driver puts the
pieces together, in order and without holding them, and publishes frames.csv and then the manifest, each by one rename. The manifest is what counts: it names the digest of the
frames.csv that belongs to it. A task that fails leaves the manifest and the index of the run before as they were.
"""

from __future__ import annotations

import csv
import dataclasses
import hashlib
import io
import json
import uuid
from datetime import datetime, timezone
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from skyfix.operators import frames as fr
from skyfix.sources import jpeg, tables
from skyfix.sources.reports import settings_hash

#: Columns of the sink: a row without content is listed as it is (it was written before).
SINK = "shard int, status string, index long, t_ms long, blur_score double, filename string, content binary, bytes long, sha1 string"
#: The fields that tell a video, and where a shard's pictures are.
IDENTITY = ("name", "size_bytes", "n_frames")
SHARD = "shards/shard_{:04d}"


def opened(uri: str):
    """(file system, path) of a folder that driver and executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def _read(system, path: str) -> bytes | None:
    from pyarrow import fs

    if system.get_file_info(path).type != fs.FileType.File:
        return None
    with system.open_input_stream(path) as f:
        return f.read()


def _put(system, path: str, data: bytes) -> None:
    with system.open_output_stream(path) as f:
        f.write(data)


@dataclasses.dataclass
class Piece(WriterCommitMessage):
    """What a task has written: its piece of the index, where it stands in order, and how many pictures were new."""

    path: str
    first: tuple
    listed: int
    written: int


class IngestWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.out, self.head, self.run, self.codes = options["path"], json.loads(options["head"]), options["run"], options.get("codes", "true") == "true"

    def write(self, iterator):
        system, out = opened(self.out)
        name = f"{out}/_pieces-{self.run}/{uuid.uuid4().hex}"
        lines, first, listed, written, made = [], None, 0, 0, set()
        system.create_dir(f"{out}/_pieces-{self.run}", recursive=True)
        with system.open_output_stream(name) as piece:
            for batch in iterator:
                for row in batch.to_pylist():
                    if row["content"] is not None:
                        folder = f"{out}/{SHARD.format(row['shard'])}"
                        if folder not in made:
                            system.create_dir(folder, recursive=True)
                            made.add(folder)
                        _put(system, f"{folder}/{row['filename']}", row["content"])
                        back = _read(system, f"{folder}/{row['filename']}")
                        if back != row["content"] or jpeg.problem(back, self.codes):
                            raise OSError(f"frame failed write verification: {folder}/{row['filename']}: {jpeg.problem(back or b'', self.codes) or 'other bytes'}")
                        row["bytes"], row["sha1"], written = len(back), hashlib.sha1(back).hexdigest(), written + 1
                    first = first or (row["shard"], row["index"])
                    listed += 1
                    lines.append(json.dumps([row["shard"], row["status"], {k: row[k] for k in ("index", "t_ms", "blur_score", "filename", "bytes", "sha1")}]))
                piece.write("".join(x + "\n" for x in lines).encode())
                lines = []
        return Piece(name, first or (1 << 62, 0), listed, written)

    def commit(self, messages):
        system, out = opened(self.out)
        pieces = sorted((m for m in messages if m and m.listed), key=lambda m: m.first)
        run, digest, current = self.run, hashlib.sha1(), None
        with system.open_output_stream(f"{out}/frames.csv.{run}") as index, system.open_output_stream(f"{out}/manifest.json.{run}") as manifest:

            def tell(row) -> None:
                text = io.StringIO()
                csv.writer(text, lineterminator="\r\n").writerow(row)
                digest.update(text.getvalue().encode())
                index.write(text.getvalue().encode())

            tell(tables.FRAME_INDEX)
            manifest.write((json.dumps(self.head)[:-1] + ', "shards": {').encode())
            for m in pieces:
                with system.open_input_stream(m.path) as f:
                    for line in io.TextIOWrapper(f, "utf-8"):
                        shard, status, frame = json.loads(line)
                        if shard != current:
                            manifest.write((("" if current is None else "]}, ") + f'"{shard}": {{"status": "{status}", "frames": [').encode())
                        else:
                            manifest.write(b", ")
                        current = shard
                        manifest.write(json.dumps(frame).encode())
                        tell([shard, *(frame[c] if frame[c] is not None else "" for c in tables.FRAME_INDEX[1:])])
            manifest.write((("" if current is None else "]}") + f'}}, "index_sha1": "{digest.hexdigest()}"}}').encode())
        system.move(f"{out}/frames.csv.{run}", f"{out}/frames.csv")
        system.move(f"{out}/manifest.json.{run}", f"{out}/manifest.json")
        self._clear(system, out)

    def abort(self, messages):
        system, out = opened(self.out)
        self._clear(system, out)

    def _clear(self, system, out: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{out}/_pieces-{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{out}/_pieces-{self.run}")


class IngestFolder(DataSource):
    """Format `skyfix_ingest`: SINK rows, sorted by shard and index across partitions, to a folder."""

    @classmethod
    def name(cls) -> str:
        return "skyfix_ingest"

    def writer(self, schema, overwrite: bool):
        return IngestWriter(dict(self.options))


@dataclasses.dataclass(frozen=True)
class Ingested:
    """What a run did."""

    n_shards: int
    n_written: int
    n_skipped: int
    completed: bool


def manifest_of(out: str) -> dict[str, Any] | None:
    """The head of a folder's manifest: everything but its frames."""
    system, path = opened(out)
    data = _read(system, f"{path}/manifest.json")
    if data is None:
        return None
    whole = json.loads(data)
    return whole | {"shards": {k: v["status"] for k, v in whole["shards"].items()}}


def ingest(spark: SparkSession, pictures: DataFrame, out: str, video: dict[str, Any], settings: dict[str, Any], cap: int | None = None, force: bool = False, codes: bool = True) -> Ingested:
    """Sampled pictures of one video (shard, index, t_ms, blur_score, filename, content) into a folder; complete shards of the run before are kept, others written anew, `cap` pictures at most.

    A manifest of another video or other settings raises an IngestMismatchError, or is replaced by force."""
    before = manifest_of(out)
    same = settings_hash(settings)
    if before is not None:
        bad = [f for f in IDENTITY if before["video"].get(f) != video.get(f)] + ["settings"] * (before.get("settings_hash") != same)
        if bad and not force:
            raise fr.IngestMismatchError(f"{out} holds another ingest: {', '.join(bad)} differ")
        before = None if bad else before
    done = [int(k) for k, v in before["shards"].items() if v == "complete"] if before else []
    every = pictures.select(F.lit(0).alias("video"), F.col("shard").cast("int").alias("shard"), F.col("index").cast("long").alias("idx"))
    complete = spark.createDataFrame([(0, k) for k in done], "video int, shard int")
    plan = fr.ingest_plan(every, complete, cap, "video")
    states = fr.shard_states(plan, every, "video")
    counts = states.agg(F.count(F.lit(1)).alias("n"), F.sum("n_written").alias("w"), F.sum("n_skipped").alias("s"), F.count_if(F.col("status") == "complete").alias("c")).first()
    total, written = every.select("shard").distinct().count(), counts["w"] or 0
    completed = counts["c"] == total
    system, path = opened(out)
    if before is not None and before["completed"] and not written and _read(system, f"{path}/frames.csv") is not None:
        return Ingested(total, 0, counts["s"] or 0, True)
    head = {"video": {k: video.get(k) for k in (*IDENTITY, "fps", "width", "height")}, "settings": settings, "settings_hash": same, "created_utc": before["created_utc"] if before else datetime.now(timezone.utc).isoformat(), "completed": completed}
    rows = pictures.select(F.col("shard").cast("int").alias("shard"), F.col("index").cast("long").alias("index"), "t_ms", F.round("blur_score", 2).alias("blur_score"), "filename", "content")
    new = rows.join(plan.where("action = 'write'").select(F.col("idx").alias("index")), "index").join(states.select("shard", "status"), "shard")
    new = new.select("shard", "status", "index", "t_ms", "blur_score", "filename", "content", F.lit(None).cast("long").alias("bytes"), F.lit(None).cast("string").alias("sha1"))
    if before:
        listed = tables.manifest_frames(spark, f"{out}/manifest.json").where(F.col("status") == "complete")
        new = new.unionByName(listed.select("shard", "status", "index", "t_ms", "blur_score", "filename", F.lit(None).cast("binary").alias("content"), "bytes", "sha1"))
    system.create_dir(path, recursive=True)
    spark.dataSource.register(IngestFolder)
    ordered = new.repartitionByRange("shard", "index").sortWithinPartitions("shard", "index")
    ordered.write.format("skyfix_ingest").option("path", out).option("head", json.dumps(head)).option("run", uuid.uuid4().hex).option("codes", str(codes).lower()).mode("append").save()
    return Ingested(total, written, counts["s"] or 0, completed)


def verify(spark: SparkSession, out: str, codes: bool = True) -> DataFrame:
    """(shard, status, filename, problem): every picture of the manifest with its first failing check, and a row without a shard if frames.csv is missing or another manifest's."""
    head = manifest_of(out)
    schema = "shard int, status string, filename string, problem string"
    if head is None:
        return spark.createDataFrame([(None, None, None, "no manifest.json")], schema)
    listed = tables.manifest_frames(spark, f"{out}/manifest.json").withColumn("filename", F.concat(F.format_string("shard_%04d/", "shard"), "filename"))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jpg").load(f"{out}/shards")
    found = found.select(F.substring_index("path", "/", -2).alias("filename"), "content")
    decodes = jpeg.decodes if codes else fr.whole_picture
    rows = fr.verify(listed, found, decodes)
    system, path = opened(out)
    index = _read(system, f"{path}/frames.csv")
    if head["completed"] and (index is None or hashlib.sha1(index).hexdigest() != head.get("index_sha1")):
        rows = rows.unionByName(spark.createDataFrame([(None, None, "frames.csv", "missing" if index is None else "of another manifest")], schema))
    return rows


def demote(spark: SparkSession, out: str, checked: DataFrame) -> list[int]:
    """Marks complete shards with problems as partial and the ingest as not completed, so that the next run writes just them; the shards."""
    bad = sorted(r["shard"] for r in fr.verified_shards(checked.where("shard is not null")).where("new_status <> status").collect())
    if bad:
        system, path = opened(out)
        whole = json.loads(_read(system, f"{path}/manifest.json"))
        for k in bad:
            whole["shards"][str(k)]["status"] = "partial"
        _put(system, f"{path}/manifest.json.demoted", json.dumps(whole | {"completed": False}).encode())
        system.move(f"{path}/manifest.json.demoted", f"{path}/manifest.json")
    return bad
