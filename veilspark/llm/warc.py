"""WARC archives of single zstandard frames with a dictionary in the file's head.

A file starts with a skippable frame (0x184D2A5D) that holds the dictionary,
itself compressed or not; then each record is one frame. The reader streams a
file in bounded pieces, decodes frame by frame and validates version line,
header fields, block length, the HTTP head of responses and the payload digest.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import runtime as R

DICTIONARY_MAGIC, ZSTD_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
#: A file's dictionary is trained on its first records: so many, and so many bytes at most.
TRAIN_RECORDS, TRAIN_BYTES, DICTIONARY_BYTES = 200, 2 << 20, 32 << 10
#: Payload bytes after which a file ends, and payloads from which on equals are written once.
FILE_BYTES, REVISIT_BYTES = 128 << 20, 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = re.compile(rb"HTTP/1\.[01] \d{3}[^\r\n]*\r\n(?:[^\r\n]+\r\n)*\r\n")


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers["warc-type"]

    @property
    def payload(self) -> bytes:
        """The HTTP body of a response; revisits hold none."""
        return self.block[_HTTP.match(self.block).end() :] if self.kind == "response" else b""


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    tail = urn[len("<urn:page:") : -1] if urn else "none"
    return None if tail == "none" else int(tail)


def uri_text(url: str | None) -> str | None:
    """url with white space and control characters percent-encoded, as a header value needs."""
    return None if not url else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", page_urn(page_id)), ("WARC-Date", date), ("WARC-Target-URI", uri_text(url)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", page_urn(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *[f"{k}: {v}\r\n" for k, v in fields if v is not None], "\r\n"]).encode() + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> bytes:
    """A trained dictionary, or the first record's head where there is too little to train on."""
    sample, size = [], 0
    for r in records:
        sample.append(r[: 128 << 10])
        size += len(sample[-1])
        if size >= TRAIN_BYTES:
            break
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[:DICTIONARY_BYTES]


class Writer:
    """Writes records to a binary stream; the first ones wait until the dictionary is made of them."""

    def __init__(self, sink):
        self.sink, self.wait, self.size, self.records, self.zstd = sink, [], 0, 0, None

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.zstd is None:
            self.wait.append(record)
            self.size += len(record)
            if len(self.wait) >= TRAIN_RECORDS or self.size >= TRAIN_BYTES:
                self._start()
        else:
            self.sink.write(self.zstd.compress(record))

    def _start(self) -> None:
        plain = dictionary(self.wait)
        packed = zstandard.ZstdCompressor(level=9).compress(plain)
        self.sink.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
        self.zstd = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(plain), write_checksum=True, write_content_size=True)
        for r in self.wait:
            self.sink.write(self.zstd.compress(r))
        self.wait = []

    def close(self) -> None:
        if self.zstd is None:
            self._start()


def parse_record(raw: bytes) -> Record:
    """One decoded frame as a record; ValueError where headers, lengths or the payload's digest are wrong."""
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n")) or end < 0:
        raise ValueError("no WARC version line or header end")
    headers = {}
    for line in raw[:end].decode("utf-8").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"broken header line {line!r}")
        headers[name.lower()] = value.strip()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - headers.keys():
        raise ValueError(f"missing {sorted(missing)}")
    length = headers["content-length"]
    block = raw[end + 4 : -4]
    if not length.isdigit() or int(length) != len(block) or raw[-4:] != b"\r\n\r\n" or len(raw) < end + 8:
        raise ValueError("Content-Length and block differ")
    record = Record(headers, block)
    if record.kind in ("response", "revisit"):
        if not (http := _HTTP.match(block)):
            raise ValueError("no HTTP head in the block")
        said = re.search(rb"(?i)\r\nContent-Length: *(\d+)\r\n", http[0])
        if record.kind == "response":
            if said and int(said[1]) != len(record.payload):
                raise ValueError("the HTTP Content-Length and the payload differ")
            digest = headers.get("warc-payload-digest", "")
            if digest.startswith("sha1:") and digest[5:] != hashlib.sha1(record.payload).hexdigest():
                raise ValueError("payload digest differs")
        elif http.end() != len(block) or not headers.get("warc-refers-to"):
            raise ValueError("a revisit has a payload or refers to nothing")
    return record


def read_archive(source, piece: int = 256 << 10) -> Iterator[Record]:
    """The records of a binary stream, one frame at a time; a frame may span pieces."""

    def exactly(n: int) -> bytes:
        data = source.read(n)
        if len(data) != n:
            raise ValueError("the file breaks off in its head")
        return data

    magic, size = struct.unpack("<II", exactly(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame at the start")
    plain = exactly(size)
    if plain.startswith(ZSTD_MAGIC):
        plain = zstandard.ZstdDecompressor().decompress(plain)
    zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(plain))
    rest = source.read(piece)
    while rest:
        if not rest.startswith(ZSTD_MAGIC[: len(rest)]):
            raise ValueError("a frame that is no record")
        frame, out = zstd.decompressobj(), []
        while True:
            out.append(frame.decompress(rest))
            if frame.eof:
                break
            if not (rest := source.read(piece)):
                raise ValueError("the file breaks off in a frame")
        rest = frame.unused_data or source.read(piece)
        yield parse_record(b"".join(out))


def http_payload_length(record: Record) -> int:
    """Bytes of the full payload: of a response its own, of a revisit those its HTTP head states."""
    if record.kind == "response":
        return len(record.payload)
    said = re.search(rb"(?i)\r\nContent-Length: *(\d+)\r\n", record.block)
    return int(said[1]) if said else 0


MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType())])


def _written(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get(), []
        fs_ = sink = w = None
        size = 0

        def finish():
            w.close()
            sink.close()
            done.append((name, w.records))

        for rows in batches:
            cols = [rows.column(c) for c in ("page_id", "url", "html", "digest", "refers_to", "revisit")]
            for i in range(rows.num_rows):
                page_id, url, html, digest, refers_to, revisit = [c[i].as_py() for c in cols]
                if w is None:
                    fs_, base = R.filesystem(folder)
                    fs_.create_dir(base, recursive=True)
                    name = f"{base}/pages-{task.partitionId():06d}-{len(done):04d}-{task.taskAttemptId()}.warc.zst"  # a repeated task writes files of its own
                    sink = fs_.open_output_stream(name)
                    w, size = Writer(sink), 0
                payload = (html or "").encode("utf-8", "surrogatepass")
                w.add(record_bytes(page_id, url, payload, digest, refers_to, revisit, date))
                size += len(payload)
                if size >= FILE_BYTES:
                    finish()
                    w = None
        if w is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], MANIFEST.names)

    return run


def write(pages: DataFrame, folder: str | None = None, revisit_bytes: int = REVISIT_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of pages (page_id, url, html); returns the manifest of files.

    Of rows with equal payloads of at least revisit_bytes bytes, the largest
    page_id is a response and the others are revisits that refer to it; smaller
    payloads are responses. Null html is an empty payload, null page_id the
    smallest. Repeated rows of one page_id are all what that page_id is. An empty
    table writes no file. Digests are grouped without their payloads, with
    partial aggregation; the winners are joined back with AQE's skew handling,
    and small payloads carry a key of their own, so none of them meet.
    """
    spark = pages.sparkSession
    folder = folder or R.shared_dir(spark)
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = R.picked(pages, "page_id", "url", "html").withColumn("digest", F.sha1(body))
    large = F.octet_length(F.col("html")) >= revisit_bytes
    heads = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("key"), "head")
    keyed = rows.withColumn("key", F.when(large, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "digest").cast("string"))))
    revisit = F.coalesce(F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head")), F.lit(False))
    typed = keyed.join(heads, "key", "left").select("page_id", "url", "html", "digest", F.when(revisit, F.col("head")).alias("refers_to"), revisit.alias("revisit"))
    return R.cut(typed.mapInArrow(_written(folder, date), MANIFEST))


ROWS = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("url", T.StringType())])


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, expected in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                fs_, _ = R.filesystem(folder)
                rows, n = [], 0
                with fs_.open_input_stream(path) as f:
                    for r in read_archive(f):
                        h = r.headers
                        rows.append((page_of(h["warc-record-id"]), http_payload_length(r), h["warc-payload-digest"].removeprefix("sha1:"), r.kind, page_of(h.get("warc-refers-to")), h.get("warc-target-uri")))
                        n += 1
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist([dict(zip(ROWS.names, x)) for x in rows], _ARROW)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(ROWS.names, x)) for x in rows], _ARROW)
                if n != expected:
                    raise ValueError(f"{path} has {n} records, {expected} were written")

    return run


_ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the manifest's files, each validated: page_id, size and SHA-1 of the full payload, record type, what it refers to, and url.

    Repeated records each give a row, absent ids are null; an empty manifest gives no rows.
    """
    return manifest.repartition(R.tasks_for(manifest)).mapInArrow(_read(folder), ROWS)
