"""An open-data catalogue and the files it lists as a data source, for tables and streams.

    spark.dataSource.register(CatalogueSource)
    spark.read.format("catalogue").options(url=".../package_show?id=...", formats="CSV,ZIP").load()

The driver asks the catalogue; each resource is a partition that a task downloads, in rows of bounded size. Requests are tried again
after a wait that grows by the same step each time. With `known` (what landed_marks gives) a resource that has not changed
costs one conditional request and gives one row of status 304. As a stream, the offset holds each resource's ETag and times, so
a batch has the resources that changed since the last.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib import error, request

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "id string, name string, format string, url string, etag string, last_modified string, status int, part int, content binary"
#: Attempts, the step of the wait between them in seconds, bytes of a row's content, seconds until a silent server counts as failed.
ATTEMPTS, WAIT, PART_BYTES, TIMEOUT = 5, 1.5, 4 << 20, 60


@dataclass
class Resource(InputPartition):
    id: str
    name: str
    format: str
    url: str
    marks: tuple[str | None, str | None] = (None, None)  # ETag and Last-Modified of what has landed


def tried(call, attempts: int, wait: float):
    """call(), again after failures of the network or the server; other answers (404, 403) are final."""
    for k in range(attempts):
        try:
            return call()
        except (error.URLError, TimeoutError, ConnectionError, json.JSONDecodeError) as e:
            final = isinstance(e, error.HTTPError) and e.code < 500 and e.code not in (408, 429)
            if final or k == attempts - 1:
                raise
            time.sleep(wait * (k + 1))


class Requests:
    def __init__(self, options):
        self.url, self.formats = options["url"], {f.strip().upper() for f in options.get("formats", "CSV,ZIP").split(",")}
        self.attempts, self.wait = int(options.get("attempts", ATTEMPTS)), float(options.get("wait", WAIT))
        self.part_bytes, self.known = int(options.get("partBytes", PART_BYTES)), json.loads(options.get("known", "{}"))

    def resources(self) -> list[Resource]:
        """What the catalogue lists, of the wanted formats."""

        def ask():
            with request.urlopen(self.url, timeout=TIMEOUT) as reply:
                return json.load(reply)

        reply = tried(ask, self.attempts, self.wait)
        if not reply.get("success"):
            raise ValueError(f"the catalogue reports no success: {self.url}")
        found = (reply.get("result") or {}).get("resources") or []
        return [Resource(str(r.get("id") or r["url"]), r.get("name") or "", (r.get("format") or "").upper(), r["url"]) for r in found if r.get("url") and (r.get("format") or "").upper() in self.formats]

    def marks(self, resource: Resource) -> list[str | None]:
        """A resource's ETag and Last-Modified, without its content."""

        def ask():
            with request.urlopen(request.Request(resource.url, method="HEAD"), timeout=TIMEOUT) as reply:
                return [reply.headers.get("ETag"), reply.headers.get("Last-Modified")]

        return tried(ask, self.attempts, self.wait)

    def rows(self, r: Resource) -> Iterator[tuple]:
        etag, changed = r.marks
        headers = {k: v for k, v in (("If-None-Match", etag), ("If-Modified-Since", changed)) if v}
        told = (r.id, r.name, r.format, r.url)
        try:
            reply = tried(lambda: request.urlopen(request.Request(r.url, headers=headers), timeout=TIMEOUT), self.attempts, self.wait)
        except error.HTTPError as e:
            if e.code != 304:
                raise
            yield (*told, etag, changed, 304, 0, None)
            return
        with reply:  # a download that breaks off fails the task, which Spark runs again
            part, expected, got = 0, reply.headers.get("Content-Length"), 0
            while (content := reply.read(self.part_bytes)) or not part:
                got += len(content)
                yield (*told, reply.headers.get("ETag"), reply.headers.get("Last-Modified"), reply.status, part, content)
                part += 1
            if expected is not None and got != int(expected):
                raise ConnectionError(f"{r.url}: {got} of {expected} bytes")


class CatalogueReader(DataSourceReader):
    def __init__(self, options):
        self.requests = Requests(options)

    def partitions(self) -> list[Resource]:
        found = self.requests.resources()
        for r in found:
            r.marks = tuple(self.requests.known.get(r.id) or (None, None))
        return found

    def read(self, partition: Resource) -> Iterator[tuple]:
        return self.requests.rows(partition) if partition is not None else iter(())


class CatalogueStream(DataSourceStreamReader):
    def __init__(self, options):
        self.requests = Requests(options)

    def initialOffset(self) -> dict:
        return {"marks": "{}"}

    def latestOffset(self) -> dict:
        found = {r.id: [r.name, r.format, r.url, *self.requests.marks(r)] for r in self.requests.resources()}
        return {"marks": json.dumps(found, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Resource]:
        before, now = json.loads(start["marks"]), json.loads(end["marks"])
        return [Resource(k, *v[:3]) for k, v in sorted(now.items()) if before.get(k) != v]

    def read(self, partition: Resource) -> Iterator[tuple]:
        return self.requests.rows(partition)


class CatalogueSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CatalogueReader:
        return CatalogueReader(self.options)

    def streamReader(self, schema) -> CatalogueStream:
        return CatalogueStream(self.options)


def landed_marks(landed: DataFrame) -> str:
    """The option `known` from what has landed before: each resource's last ETag and Last-Modified."""
    rows = landed.filter("status = 200 AND part = 0").groupBy("id").agg(F.max_by(F.struct("etag", "last_modified"), F.coalesce("last_modified", F.lit(""))).alias("m")).collect()
    return json.dumps({r["id"]: [r["m"]["etag"], r["m"]["last_modified"]] for r in rows})


def latest_contents(landed: DataFrame, fetched_at: str = "fetched_at") -> DataFrame:
    """Of each resource the rows of its newest complete download, where rows tell when they were fetched."""
    newest = landed.filter("status = 200").groupBy("id").agg(F.max(fetched_at).alias(fetched_at))
    return landed.filter("status = 200").join(newest, ["id", fetched_at])
