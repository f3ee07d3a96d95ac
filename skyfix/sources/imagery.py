"""Reference imagery by request: providers by name, a source that makes one partition of each request, and the same for a table of requests.

Services answer errors in several ways: by status, or by a text where an image is expected. A request that fails is a row with its error, unless the read is told to stop.
"""

from __future__ import annotations

import dataclasses
import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skyfix.sources.benchmark import map_request, tile_request


@dataclasses.dataclass(frozen=True)
class Reply:
    status: int
    kind: str
    body: bytes


#: Gives the reply to (address, parameters, seconds).
Opener = Callable[[str, dict, float], Reply]


def http(url: str, params: dict, timeout: float) -> Reply:
    from urllib import error, parse, request

    try:
        with request.urlopen(f"{url}?{parse.urlencode(params)}", timeout=timeout) as r:
            return Reply(r.status, r.headers.get("Content-Type", ""), r.read())
    except error.HTTPError as e:
        return Reply(e.code, e.headers.get("Content-Type", ""), e.read())


@dataclasses.dataclass(frozen=True)
class Provider:
    """A service: its address, how often a request is made that meets an error of the server, and the pauses between."""

    name: str
    url: str
    params: Callable[[float, float, float, int], dict]
    attempts: int = 1
    pause_s: float = 1.0
    growth: float = 1.5
    timeout_s: float = 60.0

    def fetch(self, lat: float, lon: float, span_m: float, pixels: int, opener: Opener = http, sleep: Callable[[float], None] = time.sleep) -> tuple[bytes, str, int]:
        """(image, content type, attempts). RuntimeError for a status of 400 and more or a reply that is no image."""
        pause = self.pause_s
        for attempt in range(1, self.attempts + 1):
            reply = opener(self.url, self.params(lat, lon, span_m, pixels), self.timeout_s)
            if reply.status < 500 or attempt == self.attempts:
                break
            sleep(pause)
            pause *= self.growth
        if reply.status >= 400:
            raise RuntimeError(f"{self.name}: status {reply.status}")
        if "image" not in reply.kind:
            raise RuntimeError(f"{self.name}: no image ({reply.kind}): {reply.body[:500].decode('utf-8', 'replace')}")
        return reply.body, reply.kind, attempt


def _export(lat: float, lon: float, span_m: float, pixels: int) -> dict:
    own = map_request(lat, lon, span_m, pixels)
    return {"bbox": own["bbox"], "bboxSR": own["srs"], "imageSR": own["srs"], "size": own["size"], "format": own["format"], "f": "image"}


def _wms(layer: str, transparent: bool) -> Callable[[float, float, float, int], dict]:
    def params(lat: float, lon: float, span_m: float, pixels: int) -> dict:
        own = tile_request(lat, lon, span_m, pixels, layer)
        return own if transparent else {k: v for k, v in own.items() if k != "TRANSPARENT"}

    return params


PROVIDERS: dict[str, Provider] = {}


def register(provider: Provider) -> None:
    PROVIDERS[provider.name] = provider


#: Public services by name, their layers, and how they are asked again.
register(Provider("esri", "https://services.arcgisonline.com/arcgis/rest/services/World_Imagery/MapServer/export", _export, attempts=3))
register(Provider("pnoa", "https://www.ign.es/wms-inspire/pnoa-ma", _wms("OI.OrthoimageCoverage", True), attempts=3))
register(Provider("ign", "https://data.geopf.fr/wms-r/wms", _wms("HR.ORTHOIMAGERY.ORTHOPHOTOS", False)))


def get_provider(name: str) -> Provider:
    if (p := PROVIDERS.get(name.lower())) is None:
        raise ValueError(f"unknown provider {name!r}; known: {', '.join(sorted(PROVIDERS))}")
    return p


SCHEMA = "request long, provider string, lat double, lon double, span_m double, pixels int, tile struct<minx: double, miny: double, maxx: double, maxy: double, width: int, height: int>, content binary, content_type string, attempts int, error string"


def _row(number: int, r: dict, opener: Opener, sleep: Callable[[float], None], stop: bool) -> tuple:
    x0, y0, x1, y1 = map(float, map_request(r["lat"], r["lon"], r["span_m"], r["pixels"])["bbox"].split(","))
    own = number, r["provider"], r["lat"], r["lon"], r["span_m"], r["pixels"], (x0, y0, x1, y1, r["pixels"], r["pixels"])
    try:
        content, kind, attempts = get_provider(r["provider"]).fetch(r["lat"], r["lon"], r["span_m"], r["pixels"], opener, sleep)
    except (RuntimeError, ValueError, OSError) as e:
        if stop:
            raise
        return (*own, None, None, None, f"{type(e).__name__}: {e}"[:600])
    return (*own, content, kind, attempts, None)


class Request(InputPartition):
    def __init__(self, number: int, row: dict):
        self.number, self.row = number, row


def source(opener: Opener = http, sleep: Callable[[float], None] = time.sleep) -> type[DataSource]:
    """The data source `skyfix_imagery` with this opener. Option requests: a JSON list of {provider, lat, lon, span_m, pixels}; stop: true to end the read at the first error."""

    class Imagery(DataSource):
        @classmethod
        def name(cls) -> str:
            return "skyfix_imagery"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            rows, stop = json.loads(self.options["requests"]), self.options.get("stop", "false").lower() == "true"

            class Reader(DataSourceReader):
                def partitions(self):
                    return [Request(i, r) for i, r in enumerate(rows)]

                def read(self, partition):
                    yield _row(partition.number, partition.row, opener, sleep, stop)

            return Reader()

    return Imagery


def read_imagery(spark: SparkSession, requests: list[dict], opener: Opener = http, sleep: Callable[[float], None] = time.sleep, stop: bool = False) -> DataFrame:
    """A row for each request, in a partition of its own."""
    spark.dataSource.register(source(opener, sleep))
    return spark.read.format("skyfix_imagery").option("requests", json.dumps(requests)).option("stop", str(stop).lower()).load()


def fetched(requests: DataFrame, opener: Opener = http, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """The same for a table of requests (request, provider, lat, lon, span_m, pixels) of any size, partition by partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in SCHEMA.replace("struct<minx: double, miny: double, maxx: double, maxy: double, width: int, height: int>", "x").split(", ")]
        for pdf in batches:
            for r in pdf.to_dict("records"):  # a picture at a time
                out = _row(int(r["request"]), {k: r[k] for k in ("provider", "lat", "lon", "span_m")} | {"pixels": int(r["pixels"])}, opener, sleep, False)
                yield pd.DataFrame([[dict(zip(("minx", "miny", "maxx", "maxy", "width", "height"), v)) if k == "tile" else v for k, v in zip(names, out)]], columns=names)

    return requests.select("request", "provider", "lat", "lon", "span_m", "pixels").mapInPandas(run, SCHEMA)
