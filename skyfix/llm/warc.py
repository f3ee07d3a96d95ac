"""WARC archives of pages, their capture index by external merge, and reading back through it.

Writing: every task writes its pages as gzip members of WARC/1.1 files in the shared folder, and its captures as a run
sorted by URL key, timestamp and page id. A payload that several pages share is written once, by the page of smallest id; the others are revisits.
Merging: the order is cut into ranges, and of every range a task merges what the runs have there, by a loser tree that reads the runs' files chunk by chunk,
so that partition after partition gives the capture histories in global order and memory depends on the number of runs only; more than FAN_IN runs are first merged into longer ones. Reading: the merged captures go to tasks by file and are read
in the order of their offsets; digests and lengths are verified.

A task that is repeated writes new files, which only the rows of the successful attempt name; the index is a written table.

Defined results: a null html is the empty payload; rows without a page_id are kept, and are responses if no row with an id has
their payload; so are all rows that repeat the smallest id with the same payload. A null url has an empty key and no target field. Other columns are never
read. Empty input gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import datetime
import hashlib
import itertools
import urllib.parse
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfix.llm.common import discard, opened, workspace, written

FILE_BYTES, GZIP_LEVEL = 256 << 20, 1
#: Captures of a chunk (what a merge holds of each run at once) and, about, of a range; runs that are merged at once.
CHUNK, RANGE, FAN_IN = 512, 1 << 15, 256
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "url_key string, stamp string, page_id long, url string, file string, offset long, length long"
CAPTURES = pa.schema([("url_key", pa.string()), ("stamp", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_ORDER = "struct<url_key: string, stamp: string, known: boolean, page: long>"
#: A chunk of a run: where it is, how many captures it has, and the first and last in their order.
CHUNKS = f"run string, chunk int, n long, first {_ORDER}, last {_ORDER}"


class LoserTree:
    """Merges sorted iterators: inner nodes hold the loser of their match, so that each item costs one path of comparisons."""

    def __init__(self, runs: list[Iterable], key=lambda x: x):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = max(1, len(self.runs))
        self.heads: list = [None] * self.k  # (key, item), None once a run has ended
        self.losers = [-1] * self.k  # node 0: the winner
        for i in range(len(self.runs)):
            self._advance(i)
        if self.k > 1:
            won = [-1] * (2 * self.k)
            for i in range(self.k):
                won[self.k + i] = i
            for node in range(self.k - 1, 0, -1):
                a, b = won[2 * node], won[2 * node + 1]
                won[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
            self.losers[0] = won[1]
        else:
            self.losers[0] = 0

    def _advance(self, i: int) -> None:
        try:
            item = next(self.runs[i])
            self.heads[i] = (self.key(item), item)
        except StopIteration:
            self.heads[i] = None

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x[0] < y[0] or (x[0] == y[0] and a < b)

    def __iter__(self) -> Iterator:
        while (head := self.heads[self.losers[0]]) is not None:
            yield head[1]
            winner = self.losers[0]
            self._advance(winner)
            node = (winner + self.k) // 2
            while node >= 1:
                if self._before(self.losers[node], winner):
                    winner, self.losers[node] = self.losers[node], winner
                node //= 2
            self.losers[0] = winner


def url_key(url: str | None) -> str:
    """The sort form of a URL: host labels reversed and without a leading www, then port, path and query, lower case; no fragment."""
    if not url:
        return ""
    try:
        parts = urllib.parse.urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    query = f"?{parts.query}" if parts.query else ""
    return (",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + (parts.path or "/") + query).lower()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=(0x5C1F << 112 | 8 << 76 | 8 << 60 | ((page_id or 0) & ((1 << 60) - 1))))}>"


def stamp_of(page_id: int | None) -> str:
    """A capture time where the table has none: as many seconds after 2020 as the id says, within a century."""
    return (datetime.datetime(2020, 1, 1) + datetime.timedelta(seconds=(page_id or 0) % (3_000_000_000))).strftime("%Y%m%d%H%M%S")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _one_line(s: str) -> str:
    return urllib.parse.quote(s, safe="!#$%&'()*+,/:;=?@[]~") if any(c <= " " or c > "~" for c in s) else s


def make_record(page_id: int | None, url: str | None, payload: bytes, stamp: str, refers_to: int | None) -> bytes:
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    date = datetime.datetime.strptime(stamp, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    fields = [("WARC-Type", "revisit" if refers_to is not None else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date)]
    if url:
        fields.append(("WARC-Target-URI", _one_line(url)))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}")]
    if refers_to is not None:
        fields += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", PROFILE), ("WARC-Refers-To-Page", str(refers_to))]
    fields += [("WARC-Page", "" if page_id is None else str(page_id)), ("WARC-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


class BadRecord(ValueError):
    """A record that isn't whole or whose digests don't fit."""


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) and the block, with lengths and digests verified."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/1."):
        raise BadRecord("no WARC header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise BadRecord("block length")
    if fields["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise BadRecord("block digest")
    return fields, block


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def order_of(capture: tuple) -> tuple:
    """The order of capture histories: URL key, timestamp, page id (none first)."""
    return capture[0], capture[1], capture[2] is not None, capture[2] or 0


class RunWriter:
    """Writes sorted captures as a run in the shared folder, chunk by chunk; `chunks` tells of those written."""

    def __init__(self, uri: str, size: int):
        self.uri, self.size, self.held, self.chunks = uri, size, [], []
        system, path = fs.FileSystem.from_uri(uri)
        self.sink = system.open_output_stream(path, compression=None)
        self.out = pa.ipc.new_file(self.sink, CAPTURES)

    def add(self, capture: tuple) -> None:
        self.held.append(capture)
        if len(self.held) >= self.size:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            self.out.write_batch(_batch(self.held))
            first, last = (dict(zip(("url_key", "stamp", "known", "page"), order_of(c))) for c in (self.held[0], self.held[-1]))
            self.chunks.append({"run": self.uri, "chunk": len(self.chunks), "n": len(self.held), "first": first, "last": last})
            self.held = []

    def close(self) -> pa.RecordBatch:
        self._flush()
        self.out.close()
        self.sink.close()
        kind = pa.struct([("url_key", pa.string()), ("stamp", pa.string()), ("known", pa.bool_()), ("page", pa.int64())])
        return pa.RecordBatch.from_pylist(self.chunks, pa.schema([("run", pa.string()), ("chunk", pa.int32()), ("n", pa.int64()), ("first", kind), ("last", kind)]))


def _batch(captures: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*captures), CAPTURES)], schema=CAPTURES)


def read_run(uri: str, chunks: Iterable[int]) -> Iterator[tuple]:
    """The captures of these chunks of a run, one chunk in memory at a time."""
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as source:
        run = pa.ipc.open_file(source)
        for i in chunks:
            yield from zip(*(c.to_pylist() for c in run.get_batch(i).columns))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, stamp_column: str | None = None, file_bytes: int = FILE_BYTES, chunk: int = CHUNK) -> DataFrame:
    """Writes all pages, and of each file's captures a sorted run beside it; gives the runs' chunks as a written table."""
    columns = [F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")]
    stamp = F.col(stamp_column).cast("string") if stamp_column else F.lit(None).cast("string")
    # payloads are equal if their SHA-256 and length are; the SHA-1 that the records bear doesn't decide it
    pages = pages.select(*columns, stamp.alias("stamp")).withColumns({"digest": F.unhex(F.sha2("payload", 256)), "size": F.length("payload")})
    shared = pages.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    rows = pages.join(shared.select("digest", "size", "first"), ["digest", "size"], "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).select("page_id", "url", "payload", "stamp", "refers_to")

    def run(batches):
        system, path = opened(folder)
        attempt = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
        out, held, at, file, number = None, [], 0, "", 0

        def closed():
            out.close()
            index = RunWriter(f"{folder}/{file}.index", chunk)
            for capture in sorted(held, key=order_of):  # bounded by the file
                index.add(capture)
            return index.close()

        try:
            for batch in batches:
                for i in range(batch.num_rows):
                    page, url, payload, when, refers = (batch.column(c)[i].as_py() for c in range(5))
                    if out is None:
                        file = f"pages-{attempt}-{number:04d}.warc.gz"
                        out, at, number, held = system.open_output_stream(f"{path}/{file}", compression=None), 0, number + 1, []
                    when = when or stamp_of(page)
                    data = _gzip(make_record(page, url, payload, when, refers))
                    out.write(data)
                    held.append((url_key(url), when, page, url, file, at, len(data)))
                    at += len(data)
                    if at >= file_bytes:
                        yield closed()
                        out = None
            if out is not None:
                yield closed()
                out = None
        finally:
            if out is not None:
                out.close()

    return written(rows.mapInArrow(run, CHUNKS), "warc-runs")


def _fewer_runs(chunks: DataFrame, fan_in: int, size: int) -> DataFrame:
    """Runs merged by fan_in at a time into longer ones, by a task for each lot, until there are no more than that."""
    fan_in = max(2, fan_in)
    while (n := chunks.select("run").distinct().count()) > fan_in:
        lots = -(-n // fan_in)
        lot = F.pmod(F.xxhash64("run"), F.lit(lots))

        def merge(batches):
            for key, own in itertools.groupby(_rows(batches), lambda r: r[0]):
                runs = {name: [r[2] for r in part] for name, part in itertools.groupby(own, lambda r: r[1])}
                index = RunWriter(f"{min(runs).rpartition('/')[0]}/merged-{key:06d}-{uuid.uuid4().hex[:12]}.index", size)
                for capture in LoserTree([read_run(uri, own) for uri, own in sorted(runs.items())], order_of):
                    index.add(capture)
                yield index.close()

        dealt = chunks.select(lot.alias("lot"), "run", "chunk").repartition(lots, "lot").sortWithinPartitions("lot", "run", "chunk")
        merged = written(dealt.mapInArrow(merge, CHUNKS), "warc-merged")
        discard(chunks)
        chunks = merged
    return chunks


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def merge_index(chunks: DataFrame, per_range: int = RANGE, fan_in: int = FAN_IN, size: int = CHUNK) -> DataFrame:
    """Capture histories: the runs merged by URL key, timestamp and page id, partition after partition in order.

    The order is cut into ranges by the chunks' first captures. A range's task feeds a loser tree from the runs' files, of each the chunks that reach into the range, and holds one chunk a run."""
    chunks = _fewer_runs(chunks, fan_in, size)
    n = max(1, -(-(chunks.agg(F.sum("n")).first()[0] or 0) // per_range))
    cuts = chunks.select("first").repartitionByRange(n, "first").groupBy(F.spark_partition_id().alias("_p")).agg(F.min("first").alias("first"))
    bounds = sorted((tuple(r["first"]) for r in cuts.collect()))[1:]  # one for each range
    shared = chunks.sparkSession.sparkContext.broadcast(bounds)

    def reach(batches):
        ends = shared.value
        for batch in batches:
            out = []
            for run, chunk, first, last in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = (bisect.bisect_right(ends, tuple(x.values())) for x in (first, last))
                out += [(r, run, chunk) for r in range(a, b + 1)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), (pa.int32(), pa.string(), pa.int32()))], names=["part", "run", "chunk"])

    def merge(batches):
        ends = shared.value
        for part, own in itertools.groupby(_rows(batches), lambda r: r[0]):
            runs = {name: [r[2] for r in rows] for name, rows in itertools.groupby(own, lambda r: r[1])}
            low, high = ends[part - 1] if part else None, ends[part] if part < len(ends) else None
            within = lambda c: (low is None or order_of(c) >= low) and (high is None or order_of(c) < high)
            merged = iter(LoserTree([filter(within, read_run(uri, own)) for uri, own in sorted(runs.items())], order_of))
            while piece := list(itertools.islice(merged, 10_000)):
                yield _batch(piece)

    parts = chunks.select("run", "chunk", "first", "last").mapInArrow(reach, "part int, run string, chunk int")
    return parts.repartitionByRange(n, "part").sortWithinPartitions("part", "run", "chunk").mapInArrow(merge, CAPTURE)


def read_captures(captures: DataFrame, folder: str, keep_payload: bool = False) -> DataFrame:
    """Every capture's record, read from its archive and verified."""

    def run(batches):
        system, path = opened(folder)
        name, source = None, None
        try:
            for batch in batches:
                rows = []
                for file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                    if file != name:
                        if source is not None:
                            source.close()
                        name, source = file, system.open_input_file(f"{path}/{file}")
                    fields, block = parse_record(zlib.decompress(source.read_at(length, offset), 31))
                    payload = block.partition(b"\r\n\r\n")[2]
                    kind, digest, size = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["warc-payload-length"])
                    if kind == "response" and (digest != base32_sha1(payload) or size != len(payload)):
                        raise BadRecord("payload digest or length")
                    refers = fields.get("warc-refers-to-page")
                    rows.append((int(p) if (p := fields["warc-page"]) else None, size, digest, kind, int(refers) if refers else None, payload))
                cols = [list(c) for c in zip(*rows)] if rows else [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                n = 6 if keep_payload else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:n], kinds)], names=names[:n])
        finally:
            if source is not None:
                source.close()

    by_file = captures.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")
    return by_file.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * keep_payload)


def round_trip(pages: DataFrame, min_bytes: int = 0, stamp_column: str | None = None) -> DataFrame:
    """Pages written to archives in the shared folder, indexed, merged, and read back through the merged index."""
    folder = workspace(pages.sparkSession, "warc")
    return read_captures(merge_index(write_archives(pages, folder, min_bytes, stamp_column)), folder)
