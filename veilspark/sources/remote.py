"""Remote document stores behind a small client protocol: paged listing, download, upload, delete, retry.

The store's HTTP calls are injected (`call`), so that the rules here can be tested without a network
and any client library can serve. Listing and transfers run in tasks; tokens and
secrets belong to the driver's configuration and are read by `secret()`, never put into a column.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

DIRECT_BYTES, CHUNK_BYTES = 4 << 20, 5 << 20
TRANSIENT = (429, 500, 502, 503, 504)


@dataclass
class Response:
    status: int
    body: dict | bytes | None = None
    headers: dict | None = None


class Transient(Exception):
    """A time-out or a lost connection."""


Call = Callable[[str, str, dict, bytes | dict | None], Response]  # method, url, headers, body


def secret(name: str, folder: str = "/run/secrets") -> str | None:
    """NAME from the environment, from the file that NAME_FILE names, or from a file of that name in lower case in a secrets folder."""
    if value := os.environ.get(name):
        return value
    for path in (os.environ.get(f"{name}_FILE"), os.path.join(folder, name.lower())):
        if path and os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                return f.read().strip()
    return None


def retried(attempt: Callable[[], Response], tries: int = 4, ok: tuple[int, ...] = (), wait: Callable[[float], None] = time.sleep) -> Response:
    """A response without a transient error, after up to `tries` attempts with growing waits (or what Retry-After asks for)."""
    for k in range(1, tries + 1):
        try:
            r = attempt()
        except Transient:
            if k == tries:
                raise
            wait(5.0 * k)
            continue
        if r.status in TRANSIENT and k < tries:
            wait(float((r.headers or {}).get("Retry-After", 5 * k)))
        elif r.status < 400 or r.status in ok:
            return r
        else:
            raise OSError(f"status {r.status}")
    raise AssertionError


class Drive:
    """A library of a site: found by name, then addressed by paths."""

    def __init__(self, base: str, call: Call, token: Callable[[], str], wait: Callable[[float], None] = time.sleep):
        self.base, self.call, self.token, self.wait, self._drive = base.rstrip("/"), call, token, wait, None

    def _do(self, method: str, url: str, body=None, headers=None, ok=()) -> Response:
        return retried(lambda: self.call(method, url, {"Authorization": f"Bearer {self.token()}"} | (headers or {}), body), ok=ok, wait=self.wait)

    def open(self, host: str, site: str = "", library: str = "Documents") -> Drive:
        """Resolve site and library by name, once."""
        if self._drive is None:
            where = f"{host}:{site}" if site.strip("/") else host
            found = self._do("GET", f"{self.base}/sites/{self._do('GET', f'{self.base}/sites/{where}').body['id']}/drives").body["value"]
            ids = [d["id"] for d in found if d["name"] == library]
            if not ids:
                raise LookupError(f"no library {library!r} at {site or host}")
            self._drive = ids[0]
        return self

    def _url(self, path: str, tail: str = "") -> str:
        return f"{self.base}/drives/{self._drive}/root:/{path}" + (f":/{tail}" if tail else "")

    def files(self, folder: str) -> Iterator[tuple[str, dict]]:
        """(path below folder, item) of all files, page by page, folder by folder."""
        waiting = [(folder, "")]
        while waiting:
            path, rel = waiting.pop()
            url = self._url(path, "children")
            while url:
                page = self._do("GET", url).body
                for item in page.get("value", []):
                    below = f"{rel}/{item['name']}" if rel else item["name"]
                    if "folder" in item:
                        waiting.append((f"{path}/{item['name']}", below))
                    else:
                        yield below, item
                url = page.get("@odata.nextLink")

    def item(self, path: str) -> dict:
        return self._do("GET", self._url(path)).body

    def download(self, path: str) -> bytes:
        return self._do("GET", self._url(path, "content")).body

    def upload(self, path: str, data: bytes) -> dict:
        """Small files at once, larger ones in chunks of a session."""
        if len(data) <= DIRECT_BYTES:
            return self._do("PUT", self._url(path, "content"), data).body
        session = self._do("POST", self._url(path, "createUploadSession"), {"item": {"@microsoft.graph.conflictBehavior": "replace"}}).body["uploadUrl"]
        done = None
        for at in range(0, len(data), CHUNK_BYTES):
            part = data[at : at + CHUNK_BYTES]
            done = self._do("PUT", session, part, {"Content-Range": f"bytes {at}-{at + len(part) - 1}/{len(data)}"})
        return done.body

    def delete(self, path: str) -> bool:
        """Whether something was there; what is missing is no error."""
        return self._do("DELETE", self._url(path), ok=(404,)).status != 404


class _Folder(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _Reader(DataSourceReader):
    def __init__(self, opened: Callable[[], Drive], folder: str, content: bool):
        self.opened, self.folder, self.content = opened, folder, content

    def partitions(self):
        """One for each folder at the top, and one for the files beside them."""
        drive = self.opened()
        first = [i for i in drive._do("GET", drive._url(self.folder, "children")).body.get("value", []) if "folder" in i]
        return [_Folder(""), *[_Folder(i["name"]) for i in first]]

    def read(self, partition):
        drive = self.opened()
        base = f"{self.folder}/{partition.name}" if partition.name else self.folder
        for path, item in drive.files(base):
            if not partition.name and "/" in path:
                continue
            full = f"{partition.name}/{path}" if partition.name else path
            yield full, int(item.get("size", 0)), drive.download(f"{self.folder}/{full}") if self.content else None


def read_drive(spark: SparkSession, opened: Callable[[], Drive], folder: str, content: bool = True) -> DataFrame:
    """(path, length, content) of a remote folder; `opened` makes an opened Drive and must be picklable, as tasks call it."""

    class Remote(DataSource):
        @classmethod
        def name(cls):
            return "veilspark_drive"

        def schema(self):
            return "path string, length long, content binary"

        def reader(self, schema):
            return _Reader(opened, folder, content)

    spark.dataSource.register(Remote)
    return spark.read.format("veilspark_drive").load()


def write_drive(files: DataFrame, opened: Callable[[], Drive], folder: str) -> DataFrame:
    """Upload files (path, content); returns (path, stored) with the size that the store reports, for next_target()."""
    import pyarrow as pa

    def run(batches):
        drive = opened()
        for b in batches:
            paths = b.column("path").to_pylist()
            stored = [int((drive.upload(f"{folder}/{p}", c) or {}).get("size", len(c))) for p, c in zip(paths, b.column("content").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(stored, pa.int64())], ["path", "stored"])

    return files.select("path", "content").mapInArrow(run, "path string, stored long")
