"""Token-ID files: independent zstandard frames with a trailing seek table.

Layout of a file, which any zstandard decoder reads from start to end:

    data frames   ids of consecutive documents, unsigned little-endian integers of 2 or 4 bytes
    index frame   b"TIDX", id width (u32), documents (u64), doc_ids (i64 each), null flags (u8 each), first ids (u64 each, one more than documents)
    seek table    skippable frame 0x184D2A5E: for each frame its compressed and plain size and the low 32 bits of
                  the XXH64 of its plain bytes (u32 each), then the number of frames (u32), 0x80 and 0x8F92EAB1

A reader takes the table from the end, then the index, and decompresses only the
frames that hold the documents it wants; every frame read is checked.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import runtime as R
from .token_counts import byte_symbols

#: Plain bytes of ids after which a frame ends, and of all frames after which a file ends (both at a document's end).
FRAME_BYTES, FILE_BYTES = 128 << 10, 64 << 20
#: Bytes of words and ids in each of the two generations that a worker remembers.
MEMO_BYTES = 40 << 20
#: Lower-case letters of Latin-1: words of these alone are one pre-token in normal form.
PLAIN_LETTERS = "".join(chr(c) for c in [*range(0x61, 0x7B), *range(0xDF, 0x100)] if c != 0xF7)
#: ASCII marks.
MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_ODD, _SPACE = re.compile("[\x1c-\x1f]"), re.compile(r"\s")


class Writer:
    """Writes one file; close() returns its size."""

    def __init__(self, sink, width: int):
        self.sink, self.width, self.zstd = sink, width, zstandard.ZstdCompressor(level=1, write_checksum=True)
        self.table: list[tuple[int, int, int]] = []
        self.docs: list[int | None] = []
        self.first, self.wait, self.waiting, self.plain = [0], [], 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.first.append(self.first[-1] + len(ids) // self.width)
        self.wait.append(ids)
        self.waiting += len(ids)
        self.plain += len(ids)
        if self.waiting >= FRAME_BYTES:
            self._frame(b"".join(self.wait))
            self.wait, self.waiting = [], 0

    def _frame(self, plain: bytes) -> None:
        packed = self.zstd.compress(plain)
        self.sink.write(packed)
        self.table.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.wait:
            self._frame(b"".join(self.wait))
        n = len(self.docs)
        ids = np.array([0 if d is None else d for d in self.docs], "<i8")
        null = np.array([d is None for d in self.docs], np.uint8)
        self._frame(struct.pack("<4sIQ", b"TIDX", self.width, n) + ids.tobytes() + null.tobytes() + np.array(self.first, "<u8").tobytes())
        entries = b"".join(struct.pack("<III", *x) for x in self.table)
        self.sink.write(struct.pack("<II", _SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.table), 0x80, _SEEKABLE))


class Reader:
    """Random access to a file (a seekable binary stream of known size)."""

    def __init__(self, source, size: int):
        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        if size < 17:
            raise ValueError("too short for a seek table")
        frames, kind, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != _SEEKABLE or kind != 0x80 or 12 * frames + 17 > size:
            raise ValueError("no seek table with checksums")
        head, length = struct.unpack("<II", self._at(size - 17 - 12 * frames, 8))
        if head != _SKIPPABLE or length != 12 * frames + 9:
            raise ValueError("broken seek table")
        self.table = np.frombuffer(self._at(size - 9 - 12 * frames, 12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.start, self.plain = np.r_[0, np.cumsum(self.table[:, 0])], np.r_[0, np.cumsum(self.table[:-1, 1])]
        index = self.frame(frames - 1)
        magic, self.width, n = struct.unpack("<4sIQ", index[:16])
        if magic != b"TIDX" or len(index) != 16 + 17 * n + 8:
            raise ValueError("broken index")
        self.doc_ids, self.null = np.frombuffer(index, "<i8", n, 16), np.frombuffer(index, np.uint8, n, 16 + 8 * n).astype(bool)
        self.first = np.frombuffer(index, "<u8", n + 1, 16 + 9 * n).astype(np.int64)
        self.held: tuple[int, bytes] = (-1, b"")

    def _at(self, start: int, n: int) -> bytes:
        self.source.seek(int(start))
        data = self.source.read(int(n))
        if len(data) != n:
            raise ValueError("the file breaks off")
        return data

    def frame(self, k: int) -> bytes:
        """The plain bytes of frame k, checked."""
        packed, size, check = self.table[k].tolist()
        plain = self.zstd.decompress(self._at(self.start[k], packed), max_output_size=size)
        if len(plain) != size or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return plain

    def ids(self, row: int) -> np.ndarray:
        """The ids of the document in row; only the frame that holds it is decompressed."""
        a, b = (self.first[row : row + 2] * self.width).tolist()
        k = int(np.searchsorted(self.plain, a, side="right")) - 1
        while k and a == b == self.plain[k]:
            k -= 1  # no ids: any frame does
        if self.held[0] != k:
            self.held = k, self.frame(k) if a < b else b""
        at = a - int(self.plain[k])
        return np.frombuffer(self.held[1][at : at + b - a], f"<u{self.width}")


#: What a tokenizer must do before its model for words to be encoded one by one (fixed values of the format): each step looks at single
#: words only, and white space goes.
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


class Encoder:
    """The tokenizers library behind a memory of words, where the tokenizer's file shows that it encodes each word by itself; other tokenizers get whole texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = (
            all(spec[k] == v for k, v in BY_WORD.items()) and spec["truncation"] is None and spec["padding"] is None and spec["model"]["type"] == "BPE" and not spec["model"]["dropout"]
            and all(t["content"].startswith("<|") and not _SPACE.search(t["content"]) and not (t["lstrip"] or t["rstrip"]) for t in spec["added_tokens"])
        )
        self.model = self.lib.model
        self.width = 2 if self.lib.get_vocab_size() <= 1 << 16 else 4
        self.kind, self.code = f"<u{self.width}", "H" if self.width == 2 else "I"
        self.symbols = str.maketrans(dict(enumerate(byte_symbols())))
        self.memo = R.Memo(self._word, MEMO_BYTES)

    def plain(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _word(self, word: str) -> bytes:
        # a word of plain letters goes to the library's model at once: once it is in lower case, neither normalizer nor pre-tokenizer changes it
        if word.isalpha():
            low = word.lower()
            if not low.strip(PLAIN_LETTERS) and max(word) < "\u0100":
                if low != word:
                    return self.memo[low]
                symbols = low if low.isascii() else low.encode().decode("latin-1").translate(self.symbols)
                return array(self.code, [t.id for t in self.model.tokenize(symbols)]).tobytes()
        elif "<|" not in word:
            # a run of marks at the end is a pre-token of its own
            core = word.rstrip(MARKS)
            if core and core != word and core[-1].isalnum() and core[-1] < "\u0100":
                return self.memo[core] + self.memo[word[len(core) :]]
        return self.plain(word)

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return self.plain(text)
        if _ODD.search(text):  # white space to Python, but not to the tokenizer
            return self.plain(text)
        return b"".join(map(self.memo.__getitem__, text.split()))


_ENCODERS: dict[str, Encoder] = {}
R.KEPT.append(_ENCODERS)


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


MANIFEST = T.StructType([T.StructField("part", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("path", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("docs", T.LongType()), T.StructField("ids", T.LongType())])


def _written(folder: str, path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        R.turn_to("token_files")
        task = TaskContext.get()
        e, fs_, rows, w, seq, name, sink = encoder(path), None, [], None, 0, "", None
        end = np.array([end_id], f"<u{e.width}").tobytes()

        def finish():
            w.close()
            sink.close()
            rows.append((task.partitionId(), seq, name, fs_.get_file_info(name).size, len(w.docs), w.first[-1]))

        for batch, data, off in R.row_slices(batches, "token_files"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), R.texts_of(data, off)):
                if w is None:
                    fs_, base = R.filesystem(folder)
                    fs_.create_dir(base, recursive=True)
                    name = f"{base}/ids-{task.partitionId():06d}-{seq:04d}-{task.taskAttemptId()}.tokz"  # a repeated task writes files of its own
                    sink = fs_.open_output_stream(name)
                    w = Writer(sink, e.width)
                w.add(doc_id, e.encode(text) + end)
                if w.plain >= FILE_BYTES:
                    finish()
                    w, seq = None, seq + 1
        if w is not None:
            finish()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], MANIFEST.names)

    return run


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write the ids of whole texts (doc_id, text) in ascending doc_id order; returns the manifest of files in that order.

    The order is by doc_id (nulls first), then by the text's hash. Null text has
    the end id only. Files that a lost or repeated task left are in no manifest.
    An empty table writes no file.
    """
    spark = docs.sparkSession
    folder = folder or R.shared_dir(spark)
    order = ["doc_id", "veilspark_tie"]
    # repeated rows may go to several tasks: which of them comes first makes no difference
    tied = R.picked(docs, "doc_id", "text").withColumns({"veilspark_tie": F.xxhash64("text"), "veilspark_salt": F.monotonically_increasing_id() % 64})
    ordered = tied.repartitionByRange(*order, "veilspark_salt").sortWithinPartitions(*order).select("doc_id", "text")
    return R.cut(ordered.mapInArrow(_written(folder, tokenizer, end_id), MANIFEST))


ROWS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*[batch.column(c).to_pylist() for c in ("path", "bytes", "start")]):
                fs_, _ = R.filesystem(folder)
                with fs_.open_input_file(path) as f:
                    r = Reader(f, size)
                    for i in range(0, len(r.doc_ids), 4096):
                        rows = range(i, min(i + 4096, len(r.doc_ids)))
                        crc = [zlib.crc32(r.ids(k).astype("<u4").tobytes()) for k in rows]
                        first = r.first[i : rows.stop + 1]
                        yield pa.RecordBatch.from_arrays([pa.array(r.doc_ids[i : rows.stop], mask=r.null[i : rows.stop]), pa.array(first[:-1] + start), pa.array(np.diff(first)), pa.array(crc, pa.int64())], ROWS.names)

    return run


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document in the manifest's files: where its ids start among all, their number and CRC-32, read back from the files.

    Repeated documents each give a row, a null doc_id stays null; an empty manifest gives no rows.
    """
    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)  # a row for each file, that is for FILE_BYTES of ids
    listed = manifest.select("path", "bytes", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))
    return listed.repartition(R.tasks_for(manifest)).mapInArrow(_read(folder), ROWS)


def documents_of(path: str, wanted: Iterable[int]) -> dict[int, np.ndarray]:
    """The ids of the wanted documents of a local file; other frames stay compressed."""
    with open(path, "rb") as f:
        r = Reader(f, os.path.getsize(path))
        rows = {int(d): k for k, d in enumerate(r.doc_ids) if not r.null[k]}
        return {d: r.ids(rows[d]) for d in wanted if d in rows}
