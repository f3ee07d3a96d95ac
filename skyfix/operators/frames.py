"""Frame sampling, shards, ingest plans and their verification."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sample_step(fps: float, every_s: float) -> int:
    return max(1, round(fps * every_s))


def uniform(frames: DataFrame, step: int, cap: int | None, key: str) -> DataFrame:
    """Every step-th frame, the first `cap` of a key (0 or none: all)."""
    rows = frames.where(F.col("idx") % step == 0)
    if not cap:
        return rows
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy("idx"))).where(F.col("_rank") <= cap).drop("_rank")


def sharpest(frames: DataFrame, step: int, least: float, key: str) -> DataFrame:
    """Of every window of `step` frames the sharpest, the first of equal ones; a window whose best is below `least` gives none."""
    w = Window.partitionBy(key, F.floor(F.col("idx") / step)).orderBy(F.desc("blur_score"), "idx")
    return frames.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank").where(F.col("blur_score") >= least)


def parse_frames(spec: Column, total: Column) -> Column:
    """'a,b,c' to its distinct frames in order, a count to that many spread evenly (one: the first); null if one is out of range."""
    listed = F.array_sort(F.array_distinct(F.transform(F.filter(F.split(spec, ","), lambda s: F.trim(s) != ""), lambda s: F.trim(s).cast("long"))))
    k = F.trim(spec).try_cast("long")
    even = F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda i: F.bround(i * (total - 1) / (k - 1)).cast("long"))
    spread = F.when(k == 1, F.array(F.lit(0).cast("long"))).otherwise(F.array_sort(F.array_distinct(even)))
    out = F.when(spec.contains(","), listed).when(k >= 1, spread)
    return F.when(F.forall(out, lambda i: (i >= 0) & (i < total)), out)


def require_frames(spec: str, total: int) -> list[int]:
    """The frames of a specification; a ValueError that says what is wrong with it, where parse_frames gives null."""
    if total <= 0:
        raise ValueError(f"a video of {total} frames has none to take")
    parts = [p.strip() for p in spec.split(",")] if "," in spec else None
    try:
        if parts is not None:
            out = sorted({int(p) for p in parts if p})
        elif (n := int(spec)) < 1:
            raise ValueError(f"{n} is no number of frames")
        else:
            out = [0] if n == 1 else sorted({round(i * (total - 1) / (n - 1)) for i in range(n)})
    except ValueError as e:
        raise ValueError(f"bad frames {spec!r}: {e}") from None
    if not out or out[0] < 0 or out[-1] >= total:
        raise ValueError(f"bad frames {spec!r}: {out or 'none'}, of 0 to {total - 1}")
    return out


def grabbed(frames: DataFrame, wanted: DataFrame, *on: str, named: int = 20) -> DataFrame:
    """The wanted frames; a LookupError names the first of those that aren't there."""
    lost = wanted.select(*on).distinct().join(frames, list(on), "left_anti").orderBy(*on).limit(named).collect()
    if lost:
        raise LookupError(f"frames that aren't there: {', '.join(str(tuple(r)) for r in lost)}")
    return frames.join(wanted.select(*on).distinct(), list(on), "left_semi")


def shard_of(t_s: Column, seconds: float) -> Column:
    return F.floor(t_s / seconds).cast("long")


def milliseconds(t_s: Column) -> Column:
    return (t_s * 1000).cast("long")


def sample_name(idx: Column, t_ms: Column) -> Column:
    return F.format_string("frame_%06d_t%07dms.jpg", idx, t_ms)


def ingest_name(idx: Column, t_ms: Column) -> Column:
    return F.format_string("frame_%06d_t%08dms.jpg", idx, t_ms)


def ingest_plan(frames: DataFrame, complete: DataFrame, cap: int | None, key: str) -> DataFrame:
    """Frames (idx, shard) with skip for complete shards, else write, until `cap` are written; frames after the last written one aren't reached."""
    rows = frames.join(complete.select(key, "shard", F.lit(True).alias("_done")), [key, "shard"], "left")
    rows = rows.withColumn("action", F.when(F.col("_done"), "skip").otherwise("write"))
    if cap:
        w = Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_before", F.coalesce(F.sum((F.col("action") == "write").cast("int")).over(w), F.lit(0))).where(F.col("_before") < cap).drop("_before")
    return rows.drop("_done")


def shard_states(planned: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """A shard is complete once all its frames are written or skipped, and some later frame or the end of the video was reached."""
    want = frames.groupBy(key, "shard").agg(F.max("idx").alias("_last"), F.count(F.lit(1)).alias("n_frames"))
    got = planned.groupBy(key, "shard").agg(F.max("idx").alias("_reached"), F.count_if(F.col("action") == "write").alias("n_written"), F.count_if(F.col("action") == "skip").alias("n_skipped"))
    end = frames.groupBy(key).agg(F.max("idx").alias("_end"))
    top = planned.groupBy(key).agg(F.max("idx").alias("_top"))
    rows = want.join(got, [key, "shard"]).join(end, key).join(top, key)
    done = (F.col("_reached") == F.col("_last")) & ((F.col("_top") > F.col("_last")) | (F.col("_top") == F.col("_end")) | (F.col("n_written") == 0))
    return rows.select(key, "shard", "n_frames", "n_written", "n_skipped", F.when(done, "complete").otherwise("partial").alias("status"))


class IngestMismatchError(RuntimeError):
    """A folder holds the frames of another video, or of other settings."""


def require_match(manifest: DataFrame, video: DataFrame, key: str, fields: list[str]) -> None:
    """Raises an IngestMismatchError that names the fields of the first manifest that differs from its video."""
    if (bad := mismatches(manifest, video, key, fields).where(F.size("reasons") > 0).orderBy(key).first()) is not None:
        raise IngestMismatchError(f"{bad[key]}: {', '.join(bad['reasons'])} differ")


def mismatches(manifest: DataFrame, video: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Which of the identity fields differ."""
    v = video.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    reasons = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields]))
    return manifest.join(v, key).select(key, reasons.alias("reasons"))


def whole_picture(content: Column) -> Column:
    """Whether bytes are a JPEG stream from its first marker to its last; a decoder may be given to verify() in its place."""
    return (F.hex(F.substring(content, 1, 2)) == "FFD8") & (F.hex(F.substring(content, -2, 2)) == "FFD9")


def verify(manifest: DataFrame, files: DataFrame, decodes: Callable[[Column], Column] = whole_picture) -> DataFrame:
    """A row for each file of the manifest (shard, status, filename, bytes, sha1) with its first failing check, if any; files (filename, content).

    Contents are looked at where they are read; their size, digest and check are what is joined."""
    found = files.select("filename", F.length("content").alias("_size"), F.sha1("content").alias("_sha1"), F.coalesce(decodes(F.col("content")), F.lit(False)).alias("_decodes"))
    rows = manifest.join(found, "filename", "left")
    problem = F.when(F.col("_size").isNull(), "missing").when(F.col("_size") != F.col("bytes"), "size").when(F.col("_sha1") != F.col("sha1"), "sha1").when(~F.col("_decodes"), "undecodable")
    return rows.select("shard", "status", "filename", problem.alias("problem"))


def verified_shards(checked: DataFrame) -> DataFrame:
    """Complete shards with any problem fall back to partial."""
    return checked.groupBy("shard", "status").agg(F.count("problem").alias("n_problems")).withColumn("new_status", F.when((F.col("status") == "complete") & (F.col("n_problems") > 0), "partial").otherwise(F.col("status")))
