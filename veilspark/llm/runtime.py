"""Shared plumbing of the training-data operators: the shared folder, written
tables that cut lineage, and views of Arrow text columns as byte arrays."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import posixpath
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step holds at a time; its work arrays take about 60 times as much.
SLICE_BYTES = 1 << 19


def _hadoop(spark: SparkSession, path: str):
    """(file system, qualified path) as Hadoop resolves them: a path without scheme belongs to the default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs_ = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs_, fs_.makeQualified(path)


#: The temporary folder of a local session without spark.checkpoint.dir.
_OWN: list[str] = []


def base_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, as the session has it.

    Where the setting is missing, a local master gets a temporary folder, as in
    tests; a cluster gets an error, since its machines share no local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="veilspark-"))
    return _OWN[0]


#: By application and shared folder: the folder that holds what this application writes there.
_FOLDERS: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of a fresh folder, in this application's folder below base_dir(), which is deleted when the driver ends."""
    key = spark.sparkContext.applicationId, base_dir(spark)
    if key not in _FOLDERS:
        fs_, path = _hadoop(spark, posixpath.join(key[1], f"veilspark-{uuid.uuid4().hex}"))
        fs_.mkdirs(path)
        fs_.deleteOnExit(path)
        uri = path.toString()
        _FOLDERS[key] = "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri
    return f"{_FOLDERS[key]}/{uuid.uuid4().hex}"


def drop(spark: SparkSession, *uris: str) -> None:
    """Delete folders of shared_dir() that nothing will read again."""
    for uri in uris:
        fs_, path = _hadoop(spark, uri)
        fs_.delete(path, True)


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside drop their shuffle files when they end: a written table is all that is read of them later."""
    before = spark.conf.get(_TIDY)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, before)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df written to the shared folder and read back, and the folder's URI: lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_dir(spark)
    with tidy(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """df by way of a table in the shared folder, see stored()."""
    return stored(df)[0]


#: Tasks that read files, for each core there is.
TASKS_A_CORE = 8


def tasks_for(files: DataFrame) -> int:
    """Tasks for a table with a row a file: one a file, as long as there are cores for them."""
    return max(1, min(files.count(), TASKS_A_CORE * files.sparkSession.sparkContext.defaultParallelism))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI in the shared folder, and the path in it."""
    return fs.FileSystem.from_uri(uri.replace("file:///", "/", 1) if uri.startswith("file:///") else uri)


def text_views(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty. No copy is made of the text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each; a longer row stands alone, whole."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: What this worker does, and what frees the memory that an operator keeps between tasks.
_DOES: list[str] = [""]
KEPT: list[dict | list] = []


def trim() -> None:
    """Give freed memory back to the system (where the C library can)."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def turn_to(owner: str) -> None:
    """A reused worker that turns to another operator forgets what the former kept. Arrow's memory comes from the C library, so that trim() frees it too."""
    if _DOES[0] != owner:
        pa.set_memory_pool(pa.system_memory_pool())
        for kept in KEPT:
            kept.clear()
        _POWERS.clear()
        gc.collect()
        trim()
        _DOES[0] = owner


def row_slices(batches: Iterator[pa.RecordBatch], owner: str, text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes of their texts, offsets) in slices of bounded size, for the operator `owner`."""
    turn_to(owner)
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = text_views(batch.column(batch.schema.get_field_index(text)))
        for i, j in slices(off, most):
            yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
    trim()


def text_of(raw: bytes) -> str:
    """The text of UTF-8 bytes; bytes that are none (a string column may hold such) become U+FFFD."""
    try:
        return raw.decode("utf-8", "surrogatepass")
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace")


def texts_of(data: np.ndarray, off: np.ndarray) -> list[str]:
    raw, at = data.tobytes(), off.tolist()
    return [text_of(raw[a:b]) for a, b in zip(at, at[1:])]


def u64(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the pair (a, b), element by element."""
    h = a * u64(0x9E3779B97F4A7C15) + b
    h ^= h >> u64(29)
    h *= u64(0xBF58476D1CE4E5B9)
    h ^= h >> u64(32)
    return h


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = (h ^ (h >> u64(30))) * u64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> u64(27))) * u64(0x94D049BB133111EB)
    return h ^ (h >> u64(31))


def gram_hashes(x: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive elements of x (empty if there are fewer), by doubling."""
    if n < 1 or len(x) < n:
        return np.zeros(0, np.uint64)
    power, size, out, have = x, 1, None, 0
    rest = n
    while rest:
        if rest & 1:
            out = power if out is None else combine(out[: len(x) - have - size + 1], power[have : len(x) - size + 1])
            have += size
        rest >>= 1
        if rest:
            power = combine(power[: len(power) - size], power[size:])
            size *= 2
    return out[: len(x) - n + 1]


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BASES = (0x2545F4914F6CDD1D, 0xD1342543DE82EF95)  # odd, hence invertible modulo 2**64


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    if which not in _POWERS or len(_POWERS[which][0]) < n + 1:
        n = max(n, SLICE_BYTES + 4096)
        both = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            x = np.full(n + 1, u64(base))
            x[0] = 1
            both.append(np.cumprod(x, dtype=np.uint64))
        _POWERS[which] = tuple(both)
    return _POWERS[which]


def run_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the runs codes[start:end], each by its content alone; `which` is one of two independent hashes. codes: positive integers."""
    up, down = _powers(len(codes), which)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.multiply(codes, up[: len(codes)], out=sums[1:], dtype=np.uint64, casting="unsafe")
    np.cumsum(sums, out=sums)
    return mix((sums[end] - sums[start]) * down[start])


def word_runs(is_word: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes; no run crosses a document's end."""
    n = len(is_word)
    first, last = is_word.copy(), is_word.copy()
    first[1:] &= ~is_word[:-1]
    last[:-1] &= ~is_word[1:]
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = is_word[cuts]
    last[cuts - 1] = is_word[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def picked(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that other columns can't clash with an operator's own; a doc_id of another integer type becomes a long."""
    return df.select(*[F.col(f"`{n}`").cast("long").alias(n) if n == "doc_id" else F.col(f"`{n}`") for n in names])


def with_texts(rows: pa.RecordBatch, texts: list, lengths: dict[int, int]) -> pa.RecordBatch:
    """rows with these texts; where there is a column n_chars, the rows in `lengths` get theirs."""
    columns = {"text": texts}
    if lengths and "n_chars" in rows.schema.names:
        columns["n_chars"] = [lengths.get(k, n) for k, n in enumerate(rows.column("n_chars").to_pylist())]
    for name, values in columns.items():
        i = rows.schema.get_field_index(name)
        rows = rows.set_column(i, rows.schema.field(i), pa.array(values, rows.schema.field(i).type))
    return rows


class Memo(dict):
    """Remembers fn(key) of the keys used last, in two generations of at most `most` bytes each (keys, values and the table's own share).

    A result of fn for a key longer than a sixteenth of that isn't kept. With
    `listed`, `fresh` holds what was computed until it is emptied.
    """

    #: Bytes of an entry besides the characters: two objects' heads and the table's slots.
    ENTRY = 180

    def __init__(self, fn, most: int, listed: bool = False):
        super().__init__()
        self.fn, self.most, self.size, self.old, self.fresh, self.listed = fn, most, 0, {}, [], listed

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
            if self.listed:
                self.fresh.append((key, value))
        size = self.ENTRY + len(value) + (len(key) if key.isascii() else 4 * len(key))
        if size * 16 > self.most:
            return value
        if self.size + size > self.most:
            self.old, self.size = dict(self), 0
            self.clear()
        self.size += size
        self[key] = value
        return value
