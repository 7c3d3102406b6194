"""Size matching: an output file brought to its input's size by bytes that readers ignore."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COM = 65_533  # most payload bytes of a JPEG comment


def pad_png(data: bytes, size: int) -> bytes | None:
    """A tEXt chunk before IEND; 14 bytes at least."""
    gap, end = size - len(data), data.rfind(b"IEND") - 4
    if gap == 0:
        return data
    if gap < 14 or end < 8:
        return None
    body = b"p\0".ljust(gap - 12, b" ")
    return data[:end] + struct.pack(">I", len(body)) + b"tEXt" + body + struct.pack(">I", zlib.crc32(b"tEXt" + body)) + data[end:]


def pad_jpeg(data: bytes, size: int) -> bytes | None:
    """Comment segments after the start marker; 4 bytes at least, and none of 1 to 3 is left over."""
    gap, parts = size - len(data), []
    if gap == 0:
        return data
    if gap < 4 or data[:2] != b"\xff\xd8":
        return None
    while gap:
        n = min(gap, _COM + 4)
        if 0 < gap - n < 4:
            n -= 4
        parts.append(b"\xff\xfe" + struct.pack(">H", n - 2) + b" " * (n - 4))
        gap -= n
    return data[:2] + b"".join(parts) + data[2:]


def pad_rtf(data: bytes, size: int) -> bytes | None:
    """Line ends after the last brace, which readers skip."""
    return data + b"\n" * (size - len(data)) if size >= len(data) else None


def pad_pdf(data: bytes, size: int) -> bytes | None:
    """A comment line after the end mark, near enough to the end for readers to find the mark."""
    gap = size - len(data)
    if gap == 0:
        return data
    if gap < 2 or gap > 1000:
        return None
    return data + b"%" + b" " * (gap - 2) + b"\n"


def pad_zip(data: bytes, size: int) -> bytes | None:
    """An archive comment up to 65,535 bytes; beyond, a stored member takes the rest."""
    gap = size - len(data)
    if gap == 0:
        return data
    if gap < 0:
        return None
    out = io.BytesIO(data)
    with zipfile.ZipFile(out, "a") as z:
        room = 65_535 - len(z.comment)
        if gap <= room:
            z.comment = z.comment + b" " * gap
            return_early = True
        else:
            info = zipfile.ZipInfo("padding.bin")
            overhead = 30 + 46 + 2 * len(info.filename)
            z.writestr(info, b" " * (gap - overhead))
            return_early = False
    padded = out.getvalue()
    return padded if len(padded) == size else None if return_early else pad_zip(padded, size)


PADDERS = {"png": pad_png, "jpg": pad_jpeg, "jpeg": pad_jpeg, "rtf": pad_rtf, "pdf": pad_pdf, "docx": pad_zip, "xlsx": pad_zip}


def match_size(data: bytes, path: str, size: int) -> tuple[bytes, bool]:
    """(data at the wanted size and True, or data as it is and False)."""
    padder = PADDERS.get(path.rsplit(".", 1)[-1].lower())
    out = padder(data, size) if padder else (data if len(data) == size else None)
    return (out, True) if out is not None and len(out) == size else (data, False)


def next_target(size_in: int, size_stored: int) -> int:
    """The size to aim at after a store has changed a file that was written at size_in."""
    return size_in - (size_stored - size_in)


#: Attempts to reach a size in a store that changes files.
TRIES = 3


def settled(raw: bytes, path: str, size_in: int, store: Callable[[bytes], int | None], tries: int = TRIES) -> tuple[bytes, int | None, bool]:
    """Write raw, padded to size_in, so that the *stored* file has that size: (what was written last, its stored size, whether it fits).

    store writes a file and returns its size as stored, null if unknown. A store only ever adds bytes, so a
    stored size above size_in lowers the next target by the difference; an unknown or smaller one ends the attempts.
    """
    data, _ = match_size(raw, path, size_in)
    stored = store(data)
    for _ in range(tries):
        if stored is None or stored <= size_in:
            break
        again, ok = match_size(raw, path, next_target(size_in, stored))
        if not ok or again == data:
            break
        data = again
        stored = store(data)
    return data, stored, stored == size_in


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [match_size(c, p, n) for c, p, n in zip(*[b.column(x).to_pylist() for x in ("content", "path", "length_in")])]
        before = [len(c) for c in b.column("content").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([r[0] for r in rows], pa.binary()), b.column("length_in"), pa.array(before, pa.int64()), pa.array([len(r[0]) for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_())], ["path", "content", "length_in", "length_before", "length_out", "matched"])


def matched_files(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """Outputs (path, content) brought to the size of the inputs (path, length) of their path; `matched` tells where that worked."""
    joined = outputs.select("path", "content").join(inputs.select("path", F.col("length").alias("length_in")), "path")
    return joined.mapInArrow(_matched, "path string, content binary, length_in long, length_before long, length_out long, matched boolean")


def append_generated(pairs: DataFrame, path: str, batch: int) -> None:
    """Add generated pairs (original_value, replacement_value) of one batch to the table at path; a batch that is written again replaces itself."""
    rows = pairs.select("original_value", "replacement_value").distinct().withColumn("batch", F.lit(batch).cast("long"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

def generated_table(spark: SparkSession, path: str) -> DataFrame:
    """The pairs of all batches at path; of one value the first batch's stays, so that a pseudonym never changes."""
    rows = spark.read.schema("original_value string, replacement_value string, batch long").parquet(path)
    return rows.groupBy("original_value").agg(F.min_by("replacement_value", F.struct("batch", "replacement_value")).alias("replacement_value"))


def mapping_page(table: DataFrame) -> DataFrame:
    """The rows of a mapping with its origins (with_generated()) as JSON lines in order of their values."""
    return table.orderBy("origin", "data_type", "original_value").select(F.to_json(F.struct("data_type", "original_value", "replacement_value", "origin")).alias("json"))


def write_report(files: DataFrame, path: str) -> None:
    """The run's report: one JSON line a file."""
    files.write.mode("overwrite").json(path)


def markdown_table(rows: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table (of `most` rows, for reports)."""
    got = rows.limit(most).collect()
    line = lambda cells: "| " + " | ".join(str(c) for c in cells) + " |"
    return "\n".join([line(rows.columns), line("---" for _ in rows.columns), *[line(r) for r in got]])
