"""Benchmark decontamination: broadcast hash sets of normalised test n-grams.

The benchmark's n-grams are normalised once, cut into blocks of a fixed size
bound and broadcast block by block; each block's set is probed with the rolling
n-gram hashes of whole documents, and every hash hit is verified against the
words themselves. A benchmark beyond one block costs further scans, never a
larger broadcast.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import runtime as R

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes of normalised windows in one broadcast block, with what the tables of an entry take besides its characters.
BLOCK_BYTES, ENTRY_BYTES = 64 << 20, 400

_B = np.arange(256)
_UPPER = (_B >= 0x41) & (_B <= 0x5A)
_LOWER = np.where(_UPPER, _B + 32, _B).astype(np.uint8)
_IS_WORD = _UPPER | (_B >= 0x80) | ((_B >= 0x30) & (_B <= 0x39)) | ((_B >= 0x61) & (_B <= 0x7A))


def normal_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased; maximal runs of ASCII letters, digits and non-ASCII characters."""
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER.tobytes()))


def windows(words: list[bytes], n: int) -> list[bytes]:
    """The windows of an item: n consecutive words; fewer, but not none, are one window."""
    return [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []


class WindowSet:
    """One block of benchmark windows: by window length, sorted hashes with their windows and items."""

    def __init__(self, items: dict[bytes, set[str]]):
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, dict]] = {}
        grouped: dict[int, dict[bytes, set[str]]] = {}
        for w, ids in items.items():
            grouped.setdefault(w.count(b" ") + 1, {})[w] = ids
        for n, ws in grouped.items():
            keys = list(ws)
            hashes = np.array([self._hash(w) for w in keys], np.uint64)
            seen = np.zeros(1 << 20, bool)
            seen[hashes >> R.u64(44)] = True
            self.by_length[n] = np.unique(hashes), seen, ws

    @staticmethod
    def _hash(window: bytes) -> int:
        data = np.frombuffer(window, np.uint8)
        s, e = R.word_runs(_IS_WORD[data], np.array([0, len(data)]))
        return int(R.gram_hashes(R.run_hashes(data, s, e), len(s))[0])


def find_hits(data: np.ndarray, off: np.ndarray, windows_: WindowSet) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[set[str]]]:
    """(starts, ends, document of each word, whether it is hit, items of each document) of a slice of texts."""
    low = _LOWER[data]
    s, e = R.word_runs(_IS_WORD[data], off)
    doc = np.searchsorted(off, s, side="right") - 1
    hit, items = np.zeros(len(s), bool), [set() for _ in range(len(off) - 1)]
    if len(s):
        h = R.run_hashes(low, s, e)
        for n, (hashes, seen, table) in windows_.by_length.items():
            grams = R.gram_hashes(h, n)
            at = np.flatnonzero(seen[grams >> R.u64(44)])
            at = at[doc[at] == doc[at + n - 1]]
            g = grams[at]
            k = np.searchsorted(hashes, g)
            at = at[hashes[np.minimum(k, len(hashes) - 1)] == g]
            for i in at.tolist():
                ids = table.get(b" ".join(low[a:b].tobytes() for a, b in zip(s[i : i + n].tolist(), e[i : i + n].tolist())))
                if ids:
                    hit[i : i + n] = True
                    items[doc[i]] |= ids
    return s, e, doc, hit, items


def window_blocks(benchmark: DataFrame, n: int, block_bytes: int = BLOCK_BYTES) -> Iterator[WindowSet]:
    """Blocks of the benchmark's windows, streamed to the driver one partition at a time; each holds at most block_bytes of windows (one item at least)."""
    block, size = {}, 0
    for row in R.picked(benchmark, "item_id", "text").where("text IS NOT NULL").toLocalIterator():
        for w in set(windows(normal_words(row.text), n)):
            size += 0 if w in block else len(w) + ENTRY_BYTES
            block.setdefault(w, set()).add(str(row.item_id))
        if size > block_bytes:
            yield WindowSet(block)
            block, size = {}, 0
    if block or not size:
        yield WindowSet(block)


_SPANS = T.ArrayType(T.ArrayType(T.LongType()))
_HITS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", _SPANS)])


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last elements of the runs of consecutive numbers in at."""
    cut = np.flatnonzero(np.diff(at) > 1)
    return at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]]


def _united(s: np.ndarray, e: np.ndarray, doc: np.ndarray, hit: np.ndarray, off: np.ndarray, earlier: list | None) -> tuple[np.ndarray, list[list]]:
    """(hit words, spans of hit words) of each document, with the spans that earlier blocks found."""
    for k, found in enumerate(earlier or ()):
        for a, b in found:
            hit[np.searchsorted(s, off[k] + a) : np.searchsorted(e, off[k] + b, side="right")] = True
    n_hit = np.bincount(doc[hit], minlength=len(off) - 1)
    spans: list[list] = [[] for _ in range(len(off) - 1)]
    bounds = np.searchsorted(doc, np.arange(len(off)))
    for k in np.flatnonzero(n_hit).tolist():
        first, last = _runs(bounds[k] + np.flatnonzero(hit[bounds[k] : bounds[k + 1]]))
        spans[k] = (np.stack([s[first], e[last]], 1) - off[k]).tolist()
    return n_hit, spans


def _scan(windows_, carry: bool):
    """Arrow function: united with what earlier blocks found, the hits of one block; the text goes on if a block follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in R.row_slices(batches, "decontaminate"):
            s, e, doc, hit, items = find_hits(data, off, windows_.value)
            n = len(off) - 1
            earlier = None
            if "spans" in rows.schema.names:
                items = [x | set(y) for x, y in zip(items, rows.column("items").to_pylist())]
                earlier = rows.column("spans").to_pylist()
            n_hit, spans = _united(s, e, doc, hit, off, earlier)
            out = [rows.column("doc_id"), pa.array(np.bincount(doc, minlength=n)), pa.array(n_hit), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(out + [rows.column("text")] * carry, [*_HITS.names, *["text"] * carry])

    return run


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs (doc_id, text): n_words, n_hit, the items found (sorted strings) and the byte spans of hit words.

    Null or empty text has no words and no hits; repeated rows each give a row;
    an empty benchmark gives no hits, null item texts are ignored and a null
    item_id is the item "None". Texts are read whole, however long. A benchmark
    of several blocks sends the rows through one scan for each block.
    """
    out, held = R.picked(docs, "doc_id", "text"), None
    schema = T.StructType([*_HITS.fields, T.StructField("text", T.StringType())])
    for block, last in _each(window_blocks(benchmark, n, block_bytes)):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        if last:
            out = out.mapInArrow(_scan(sent, False), _HITS)
        else:
            out, held = _step(out.mapInArrow(_scan(sent, True), schema), sent, held)
    return out


def _each(blocks: Iterator[WindowSet]) -> Iterator[tuple[WindowSet, bool]]:
    """(block, whether it is the last): the driver holds one and the one after it."""
    block = next(blocks)
    for following in blocks:
        yield block, False
        block = following
    yield block, True


def _step(df: DataFrame, sent, held: str | None) -> tuple[DataFrame, str]:
    """df as a table, so that the block it was scanned with can be given up before the next one is sent; the table before goes too."""
    out, path = R.stored(df)
    sent.destroy()
    if held:
        R.drop(df.sparkSession, held)
    return out, path


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from hits(): a row for each row, nulls and repeats as there; no items give the digest of an empty string."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _clean(windows_, drop_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in R.row_slices(batches, "decontaminate"):
            s, _, doc, hit, _ = find_hits(data, off, windows_.value)
            n = len(off) - 1
            n_hit, n_words = np.bincount(doc[hit], minlength=n), np.bincount(doc, minlength=n)
            keep = (n_hit == 0) | (n_hit < drop_share * n_words)
            if n_hit.any():
                texts = rows.column("text").to_pylist()
                for k in np.flatnonzero((n_hit > 0) & keep).tolist():
                    texts[k] = remove_spans(data[off[k] : off[k + 1]].tobytes(), windows_.value)
                i = rows.schema.get_field_index("text")
                rows = rows.set_column(i, rows.schema.field(i), pa.array(texts, rows.schema.field(i).type))
                if (j := rows.schema.get_field_index("n_chars")) >= 0:
                    lengths = [m if c == 0 else len(t) for m, c, t in zip(rows.column(j).to_pylist(), n_hit, texts, strict=True)]
                    rows = rows.set_column(j, rows.schema.field(j), pa.array(lengths, rows.schema.field(j).type))
                rows = rows.filter(pa.array(keep))
            yield rows

    return run


def remove_spans(text: bytes, windows_: WindowSet) -> str:
    """text without its hit words and what stands between them, until no window occurs."""
    while True:
        data = np.frombuffer(text, np.uint8)
        s, e, _, hit, _ = find_hits(data, np.array([0, len(data)]), windows_)
        if not hit.any():
            return text.decode("utf-8", "surrogatepass")
        first, last = _runs(np.flatnonzero(hit))
        ends = [0, *e[last].tolist()]
        text = b"".join(text[a:b] for a, b in zip(ends, [*s[first].tolist(), len(text)]))


#: Columns that rows carry between the blocks of a larger benchmark: spans found, hit words, all words; whether the text may hold a window.
_FOUND, _N_HIT, _N_WORDS, _OPEN = "__spans", "__n_hit", "__n_words", "__open"
_MARKS = [T.StructField(_FOUND, _SPANS), T.StructField(_N_HIT, T.LongType()), T.StructField(_N_WORDS, T.LongType())]


def _mark(windows_):
    """Arrow function: the spans that one block hits join those of earlier blocks, in the rows that are open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in R.row_slices(batches, "decontaminate"):
            s, e, doc, hit, _ = find_hits(data, off, windows_.value)
            n = len(off) - 1
            hit &= np.array(rows.column(_OPEN).to_pylist(), bool)[doc]
            n_hit, spans = _united(s, e, doc, hit, off, rows.column(_FOUND).to_pylist())
            for name, values in ((_FOUND, pa.array(spans, pa.list_(pa.list_(pa.int64())))), (_N_HIT, pa.array(n_hit, pa.int64())), (_N_WORDS, pa.array(np.bincount(doc, minlength=n), pa.int64()))):
                i = rows.schema.get_field_index(name)
                rows = rows.set_column(i, rows.schema.field(i), values)
            yield rows

    return run


def _cut_marked(drop_share: float | None):
    """Arrow function: marked spans go, and documents with a share of hit words from drop_share on; rows that were cut stay open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in R.row_slices(batches, "decontaminate"):
            n_hit, n_words = (np.array(rows.column(c).to_pylist(), np.int64) for c in (_N_HIT, _N_WORDS))
            keep = (n_hit == 0) | (drop_share is None) | (n_hit < (drop_share or 0) * n_words)
            texts, found = rows.column("text").to_pylist(), rows.column(_FOUND).to_pylist()
            for k in np.flatnonzero((n_hit > 0) & keep).tolist():
                raw, ends = data[off[k] : off[k + 1]].tobytes(), [0, *[b for _, b in found[k]]]
                texts[k] = b"".join(raw[a:b] for a, b in zip(ends, [*[a for a, _ in found[k]], len(raw)])).decode("utf-8", "surrogatepass")
            new = {"text": texts, _FOUND: [[]] * len(texts), _OPEN: (n_hit > 0).tolist()}
            if (j := rows.schema.get_field_index("n_chars")) >= 0:
                new["n_chars"] = [m if c == 0 else len(t) for m, c, t in zip(rows.column(j).to_pylist(), n_hit, texts, strict=True)]
            for name, values in new.items():
                i = rows.schema.get_field_index(name)
                rows = rows.set_column(i, rows.schema.field(i), pa.array(values, rows.schema.field(i).type))
            yield rows.filter(pa.array(keep))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, drop_share: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without benchmark passages: a document with at least drop_share of its words hit goes, from others the hit spans go.

    All columns stay; n_chars, if there, follows the text. Documents without a
    hit, null and empty texts are untouched, repeated rows are treated alike, and an empty
    table or benchmark leaves docs as it is. The hits of several benchmark blocks are
    united before a document is dropped or cut; as cuts may bring the words of another window
    together, the cut texts are scanned again until no block hits them. One block at a time is broadcast.
    """
    sc = docs.sparkSession.sparkContext
    block, last = next(_each(window_blocks(benchmark, n, block_bytes)))
    if last:
        return docs.mapInArrow(_clean(sc.broadcast(block), drop_share), docs.schema)
    out = docs.withColumns({_FOUND: F.array().cast(_SPANS), _N_HIT: F.lit(0).cast("long"), _N_WORDS: F.lit(0).cast("long"), _OPEN: F.lit(True)})
    schema = T.StructType([*docs.schema.fields, *_MARKS, T.StructField(_OPEN, T.BooleanType())])
    share: float | None = drop_share
    held = None
    while True:
        for block in window_blocks(benchmark, n, block_bytes):
            sent = sc.broadcast(block)
            out, held = _step(out.mapInArrow(_mark(sent), schema), sent, held)
        marked = held
        out, held = R.stored(out.mapInArrow(_cut_marked(share), schema))
        R.drop(docs.sparkSession, marked)
        share = None
        if out.where(F.col(_OPEN)).isEmpty():
            return R.picked(out, *docs.columns)
