"""Exact removal of repeated strings by blockwise suffix sorting with a difference cover.

A byte goes if it lies in a string of `length` bytes that also starts in a
document of smaller doc_id, so suffixes are told apart by their first `length`
bytes. They are sorted by those bytes, one bucket at a time, never all at once:

1. Cover filter. In each document the positions whose residue modulo v lies in a
   difference cover are sampled. For any two positions some shift below v brings
   both into the sample, so two equal strings of `length` bytes share a sampled window
   of length - v + 1 bytes. Suffixes over no window that recurs elsewhere have no tie and are
   set aside; keys of windows only decide that, and a false recurrence costs time, never a byte.
2. Suffix buckets. Each other suffix belongs to the least-hashed gram of its first `length`
   bytes (its anchor), so neighbours share an anchor and travel as one run of text to
   the anchor's bucket, and equal suffixes meet there.
3. Sorting a bucket. The cover positions of the bucket's text are ranked first, as integers in
   byte order; its suffixes are then sorted by their first v bytes, and ties beyond v bytes
   are resolved by the ranks at the shift that brings both suffixes into the cover (ternary
   partition around pivots), so no tie is compared at any depth. Neighbours in the
   order are compared byte by byte; every tie learns the smallest doc_id that leads it.
4. Removal. The ties found cover bytes, and their runs are cut.

Documents are first stored in the shared folder as numbered blocks, which all
passes read by number. A block sends each distinct run once, however many of its
documents hold it. Answers come back as one bit a suffix through tables in the shared folder.
"""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import runtime as R

#: Difference covers by modulus (fixed values: perfect difference sets).
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14)}
#: Bytes of text in a block, in the blocks that one task reads, and in the blocks whose ranks stand in one folder.
BLOCK_BYTES, TASK_BYTES, FOLDER_BYTES = 2 << 20, 32 << 20, 128 << 20
#: Sampled windows, and bytes of text for each suffix bucket, from which on there are more buckets; the least number of buckets as a power of two.
BUCKET_KEYS, BUCKET_BYTES, LEAST_BITS = 1 << 22, 4 << 20, 8
#: Bytes of text for each partition of buckets, from which on there are more partitions than spark.sql.shuffle.partitions says.
PART_BYTES = 64 << 20
#: Bits beyond its share of the key space that tell a sampled window from others in its bucket; a false tie costs time only.
SPARE_BITS = 7
#: Bytes of an anchor, and of text whose anchors are looked for at once.
GRAM, STRETCH = 16, 256 << 10


@dataclass(frozen=True)
class Plan:
    length: int
    v: int
    bits: int  # sampled windows: buckets are the ranges of so many leading bits
    narrow: int  # bytes of a sampled window's key that are sent
    suffix_bits: int  # suffixes: likewise
    folders: int
    parts: int  # partitions of buckets
    block_bytes: int = BLOCK_BYTES

    @staticmethod
    def of(total: int, length: int, block_bytes: int = BLOCK_BYTES) -> Plan:
        if length < 2:
            raise ValueError("length must be 2 at least")
        v = max(x for x in COVERS if x <= max(1, length // 2))
        keys = total * len(COVERS[v]) // v
        bits = max(LEAST_BITS, (keys // BUCKET_KEYS).bit_length())
        narrow = min(8, -(-(max(1, keys >> bits).bit_length() + SPARE_BITS) // 8))
        return Plan(length, v, bits, narrow, max(LEAST_BITS, (total // BUCKET_BYTES).bit_length()), max(1, total // FOLDER_BYTES), max(1, total // PART_BYTES), block_bytes)

    @property
    def window(self) -> int:
        return self.length - self.v + 1

    @property
    def gram(self) -> int:
        return min(GRAM, -(-self.length // 3))


def cover_positions(v: int, n: int) -> np.ndarray:
    """The sampled positions below n."""
    return (np.arange(0, n, v)[:, None] + np.array(sorted(COVERS[v]))).ravel()[: n + v] if n > 0 else np.zeros(0, np.int64)


def cover_shifts(v: int) -> np.ndarray:
    """By two residues: the least shift that brings positions of both into the cover."""
    inside = np.isin(np.arange(v), COVERS[v])
    out = np.full((v, v), -1, np.int64)
    for d in range(v - 1, -1, -1):
        moved = inside[(np.arange(v) + d) % v]
        out[moved[:, None] & moved[None, :]] = d
    return out


# ------------------------------------------------------------------ bytes as words


def padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.zeros(8, np.uint8)])


def _views(buf: np.ndarray, kind: str) -> np.ndarray:
    """The 8 bytes from every position on as one integer; buf is padded()."""
    return np.ndarray((len(buf) - 7,), kind, buf, 0, (1,))


def _cuts(n: int) -> list[tuple[int, int]]:
    """(offset, bytes) of the words that cover n bytes."""
    return [(i, min(8, n - i)) for i in range(0, n, 8)]


def word(buf: np.ndarray, at: np.ndarray | slice, size: int) -> np.ndarray:
    """Big-endian integers of the `size` (at most 8) bytes from each position on."""
    return _views(buf, ">u8")[at].astype(np.uint64) >> R.u64(8 * (8 - size))


def hashes(buf: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n bytes from each position on."""
    out = np.full(1, n, np.uint64)
    for i, size in _cuts(n):
        out = R.combine(out, word(buf, at + i, size))
    return R.mix(out)


def all_hashes(buf: np.ndarray, end: int, n: int) -> np.ndarray:
    """hashes() at all positions below end."""
    out = np.full(1, n, np.uint64)
    for i, size in _cuts(n):
        out = R.combine(out, word(buf, slice(i, i + end), size))
    return R.mix(out)


def _same(buf: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Whether the n bytes from a on are those from b on."""
    out = np.ones(len(a), bool)
    for i, size in _cuts(n):
        out &= word(buf, a + i, size) == word(buf, b + i, size)
    return out


def _spread(at: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the ranges [at, end)."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, at, 1)
    np.subtract.at(step, end, 1)
    return np.cumsum(step, out=step)[:n] > 0


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each range, one range after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


# ------------------------------------------------------------------ stored blocks

BLOCKS = T.StructType([T.StructField("path", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("bytes", T.LongType())])
#: Bits of a piece's number in its block, and of a block's number in its task.
_PIECE_BITS, _SEQ_BITS = 19, 24


def _store(folder: str, most: int):
    """Arrow function: rows go to a file of blocks; a block is a record batch of about `most` bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done, sink, name = TaskContext.get(), [], None, ""
        held: list[pa.RecordBatch] = []
        size = 0

        def made() -> None:
            nonlocal held, size
            sink.write_batch(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            done.append((name, len(done), (task.partitionId() << _SEQ_BITS | len(done)) << _PIECE_BITS, size))
            held, size = [], 0

        for rows, data, _ in R.row_slices(batches, "suffix_dedup", most=min(most, R.SLICE_BYTES)):
            if sink is None:
                fs_, base = R.filesystem(folder)
                fs_.create_dir(base, recursive=True)
                name = posixpath.join(base, f"blocks-{task.partitionId():06d}-{task.taskAttemptId()}.arrow")  # a repeated task writes a file of its own
                out = fs_.open_output_stream(name)
                sink = pa.ipc.new_file(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1), use_threads=False))
            if held and len(data) >= 2 * most:
                made()  # a long text stands alone
            held.append(rows)
            size += len(data)
            if size >= most:
                made()
        if held:
            made()
        if sink is not None:
            sink.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), (pa.string(), pa.int32(), pa.int64(), pa.int64()))], BLOCKS.names)

    return run


@dataclass
class Piece:
    """A stretch of a block with its documents' bounds: the block, or a part of a long document that overlaps the next one by length - 1 bytes."""

    name: int
    base: int
    buf: np.ndarray
    off: np.ndarray
    doc_id: np.ndarray

    @property
    def n(self) -> int:
        return len(self.buf) - 8


@dataclass
class Block:
    number: int
    rows: pa.RecordBatch
    data: np.ndarray
    off: np.ndarray

    def pieces(self, plan: Plan) -> Iterator[Piece]:
        # a null doc_id counts as the smallest
        ids = np.array([-(1 << 63) if d is None else d for d in self.rows.column("doc_id").to_pylist()], np.int64)
        if len(ids) > 1 or len(self.data) < 2 * plan.block_bytes:
            yield Piece(self.number, 0, padded(self.data), self.off, ids)
            return
        for k, a in enumerate(range(0, len(self.data), plan.block_bytes)):
            part = self.data[a : a + plan.block_bytes + plan.length - 1]
            yield Piece(self.number + k, a, padded(part), np.array([0, len(part)]), ids)


def stored(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[Block]:
    """The blocks that the rows of the table of blocks name."""
    R.turn_to("suffix_dedup")
    fs_, _ = R.filesystem(folder)
    opened: tuple[str, pa.ipc.RecordBatchFileReader | None] = ("", None)
    for batch in batches:
        for path, place, number in zip(*[batch.column(c).to_pylist() for c in ("path", "place", "block")]):
            if opened[0] != path:
                opened = path, pa.ipc.open_file(fs_.open_input_file(path))
            rows = opened[1].get_batch(place)
            yield Block(number, rows, *R.text_views(rows.column("text")))
        R.trim()


# ------------------------------------------------------------------ cover filter


@dataclass
class Keys:
    """Distinct keys of a piece in order, with the place of each occurrence among them and whether several documents hold each."""

    key: np.ndarray
    place: np.ndarray
    shared: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, doc: np.ndarray) -> Keys:
        order = np.argsort(keys)
        key, owner = keys[order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        place = np.empty(len(key), np.int64)
        place[order] = np.cumsum(new) - 1
        if not len(key):
            return Keys(key, place, new)
        first = np.flatnonzero(new)
        return Keys(key[first], place, np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first))


def _buckets(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, end) of each run of equal buckets."""
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    return zip(bucket[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(bucket)])


def _packed(x: np.ndarray, width: int) -> bytes:
    """The low bytes of each integer, plane by plane (in sorted keys the upper planes compress well)."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpacked(raw: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


_SENT = T.StructType([T.StructField("block", T.LongType()), T.StructField("bucket", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("data", T.BinaryType())])
_RANKS = T.StructType([T.StructField("block", T.LongType()), T.StructField("bucket", T.LongType()), T.StructField("bits", T.BinaryType()), T.StructField("folder", T.IntegerType())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], _SENT.names)


def _sampled(piece: Piece, plan: Plan) -> tuple[np.ndarray, Keys]:
    """(sampled positions whose window fits its document, their keys)."""
    fits = np.maximum(np.diff(piece.off) - plan.window + 1, 0)
    at = cover_positions(plan.v, int(fits.max(initial=0)))
    count = np.searchsorted(at, fits)
    p = at[_ranges(np.zeros(len(fits), np.int64), count)] + np.repeat(piece.off[:-1], count)
    return p, Keys.of(hashes(piece.buf, p, plan.window), np.repeat(np.arange(len(fits)), count))


def _send_sample(plan: Plan, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = R.u64(max(0, 64 - plan.bits - 8 * plan.narrow))
        for block in stored(batches, folder):
            for piece in block.pieces(plan):
                _, keys = _sampled(piece, plan)
                bucket = (keys.key >> R.u64(64 - plan.bits)).astype(np.int64)
                short = keys.key >> shift
                yield _rows([(piece.name, b, j - i, _packed(short[i:j], plan.narrow)) for b, i, j in _buckets(bucket)])

    return run


def _answered(table: pa.Table, found: np.ndarray, ends: np.ndarray, plan: Plan) -> pa.Table:
    bits = [np.packbits(found[a:b]).tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
    names = table.column("block").to_numpy()
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary()), "folder": pa.array(_folder(names, plan), pa.int32())})


def _folder(names: np.ndarray, plan: Plan) -> np.ndarray:
    return (R.mix(names.astype(np.uint64)) % R.u64(plan.folders)).astype(np.int32)


def _rank_sample(plan: Plan):
    """Arrow function: sort one bucket of sampled windows; 1: the window is in several pieces."""

    def run(table: pa.Table) -> pa.Table:
        R.turn_to("suffix_dedup")
        keys = np.concatenate([_unpacked(x, plan.narrow) for x in table.column("data").to_pylist()])
        order = np.argsort(keys)
        same = np.zeros(len(keys) + 1, bool)
        same[1:-1] = keys[order][1:] == keys[order][:-1]
        found = np.empty(len(keys), bool)
        found[order] = same[1:] | same[:-1]
        del keys, order
        R.trim()
        return _answered(table, found, np.cumsum(table.column("n").to_numpy()), plan)

    return run


# ------------------------------------------------------------------ suffix buckets


def sort_suffixes(buf: np.ndarray, at: np.ndarray, length: int, v: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes `at` by their first `length` bytes, which places in it start another string).

    buf is padded() and holds `length` bytes from each suffix on. Ties of v
    bytes are resolved by the ranks of cover positions alone.
    """
    shifts, inside = cover_shifts(v), np.isin(np.arange(v), COVERS[v])
    near = _spread(at, at + v, len(buf))
    cover = np.flatnonzero(near & inside[np.arange(len(buf)) % v])
    del near
    # ranks of cover positions by `length` bytes of text; what lies beyond a run's end is never decisive, as its first `length` bytes are compared before
    text = np.concatenate([buf, np.zeros(length, np.uint8)])
    order, group = _sorted_by(text, cover, length)
    rank = np.zeros(len(buf), np.int32)
    rank[cover[order]] = group
    del cover, order, group, text
    order, group = _sorted_by(buf, at, v)
    slots = _open(group)
    g = group[slots]
    while len(slots):
        p = at[order[slots]]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        size = np.diff(np.r_[first, len(g)])
        pivot = np.repeat(p[first + size // 2], size)
        d = shifts[p % v, pivot % v]
        key = g.astype(np.int64) * 3 + 1 + np.sign(rank[p + d] - rank[pivot + d])
        by = np.argsort(key, kind="stable")
        order[slots] = order[slots][by]
        key = key[by]
        open_ = np.flatnonzero(key % 3 != 1)
        g = key[open_]
        open_ = open_[several := _open(g)]
        slots, g = slots[open_], np.cumsum(np.r_[0, g[several][1:] != g[several][:-1]]) if len(open_) else g[several]
    ordered = at[order]
    new = np.ones(len(ordered), bool)
    new[1:] = ~_same(buf, ordered[1:], ordered[:-1], length)
    return order, new


def _open(group: np.ndarray) -> np.ndarray:
    """The places of a sorted array of groups whose group has several members."""
    same = np.zeros(len(group) + 1, bool)
    same[1:-1] = group[1:] == group[:-1]
    return np.flatnonzero(same[1:] | same[:-1])


def _sorted_by(buf: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by the first n bytes, group of equals by place in the order): by the first word, then ties by the next one."""
    order, group = np.arange(len(at), dtype=np.int32), np.zeros(len(at), np.int32)
    slots = order.copy()
    for i, size in _cuts(n):
        if not len(slots):
            break
        own, g = order[slots], group[slots]
        w = word(buf, at[own] + i, size)
        by = np.lexsort((w, g)) if i else np.argsort(w)
        order[slots], w, g = own[by], w[by], g[by]
        new = np.zeros(len(group), bool)
        new[0] = True
        new[1:] = group[1:] != group[:-1]
        new[slots[1:]] |= (w[1:] != w[:-1]) | (g[1:] != g[:-1])
        group = np.cumsum(new, dtype=np.int32) - 1
        slots = slots[_open(group[slots])]
    return order, group


@dataclass
class Runs:
    """The runs of suffixes of a piece that share an anchor, and the distinct ones among them by bucket."""

    start: np.ndarray  # of each run in the piece
    size: np.ndarray  # its suffixes
    doc_id: np.ndarray
    which: np.ndarray  # its distinct run
    least: np.ndarray  # by distinct run: smallest doc_id
    sent: np.ndarray  # by distinct run: a run like it
    bucket: np.ndarray  # by distinct run, ascending


def _runs(piece: Piece, plan: Plan, ranks: np.ndarray, p: np.ndarray, keys: Keys) -> Runs:
    """Runs of the suffixes that may tie for `length` bytes."""
    n, length = piece.n, plan.length
    p = p[(ranks | keys.shared)[keys.place]]
    doc = np.searchsorted(piece.off, p, side="right") - 1
    open_ = _spread(np.maximum(p - plan.v + 1, piece.off[doc]), p + 1, n)
    open_ &= ~_spread(np.maximum(piece.off[1:] - length + 1, piece.off[:-1]), piece.off[1:], n)
    q = np.flatnonzero(open_)
    del open_, p, doc
    if not len(q):
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, none, none, none, none)
    anchor = _anchors(piece, plan, q)
    first = np.flatnonzero(np.r_[True, (np.diff(q) != 1) | (np.diff(anchor) != 0)])
    start, size = q[first], np.diff(np.r_[first, len(q)])
    doc_id = piece.doc_id[np.searchsorted(piece.off, start, side="right") - 1]
    bucket = (R.mix(hashes(piece.buf, anchor[first], plan.gram) + R.u64(0x9E3779B97F4A7C15)) >> R.u64(64 - plan.suffix_bits)).astype(np.int64)
    # equal runs: the first and the last suffix overlap or touch, so they tell runs of one size apart; hashes propose, bytes decide
    last = start + size - 1
    key = R.combine(R.combine(hashes(piece.buf, start, length), hashes(piece.buf, last, length)), size.astype(np.uint64))
    order = np.lexsort((start, key, bucket))
    new = np.r_[True, (key[order][1:] != key[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])]
    for _ in range(2):
        head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        a, b = order, order[head]
        new |= ~(_same(piece.buf, start[a], start[b], length) & _same(piece.buf, last[a], last[b], length) & (size[a] == size[b]))
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    return Runs(start, size, doc_id, which, np.minimum.reduceat(doc_id[order], heads), order[heads], bucket[order[heads]])


def _anchors(piece: Piece, plan: Plan, q: np.ndarray) -> np.ndarray:
    """Where the least-hashed gram of each suffix stands, the leftmost of equals; the text is gone through in stretches."""
    width, out = plan.length - plan.gram + 1, np.empty(len(q), np.int64)
    for a in range(0, piece.n, STRETCH):
        i, j = np.searchsorted(q, (a, a + STRETCH)).tolist()
        if i == j:
            continue
        end = int(q[j - 1]) + width  # of the grams of these suffixes
        least = all_hashes(piece.buf[a:], end - a, plan.gram)
        least &= R.u64(0xFFFFFFFF00000000)
        least |= np.arange(len(least), dtype=np.uint64)
        have = 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[: len(least) - step], least[step:])
            have += step
        out[i:j] = (least[q[i:j] - a] & R.u64(0xFFFFFFFF)).astype(np.int64) + a
    return out


def _bits_of(ranks: dict[int, bytes], sizes: list[tuple[int, int]]) -> np.ndarray:
    """The answers of all buckets, in order; sizes: (bucket, answers)."""
    return np.concatenate([np.unpackbits(np.frombuffer(ranks[b], np.uint8), count=n) for b, n in sizes] or [np.zeros(0, np.uint8)]).astype(bool)


class Answers:
    """What _stored_ranks() wrote, by piece; the rows of one folder are read for each piece that it holds."""

    def __init__(self, uri: str, plan: Plan):
        self.fs, self.path = R.filesystem(uri)
        self.plan = plan

    def of(self, name: int) -> dict[int, bytes]:
        path = f"{self.path}/folder={int(_folder(np.array([name]), self.plan)[0])}"
        if self.fs.get_file_info(path).type != pyarrow.fs.FileType.Directory:
            return {}
        found = pads.dataset(path, filesystem=self.fs, format="parquet").to_table(["bucket", "bits"], filter=pads.field("block") == name, use_threads=False)
        return dict(zip(found.column("bucket").to_pylist(), found.column("bits").to_pylist()))


def _piece_runs(piece: Piece, plan: Plan, sample: Answers) -> Runs:
    p, keys = _sampled(piece, plan)
    sizes = [(b, j - i) for b, i, j in _buckets((keys.key >> R.u64(64 - plan.bits)).astype(np.int64))]
    return _runs(piece, plan, _bits_of(sample.of(piece.name), sizes), p, keys)


def _send_suffixes(plan: Plan, folder: str, sample_ranks: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = Answers(sample_ranks, plan)
        for block in stored(batches, folder):
            for piece in block.pieces(plan):
                runs = _piece_runs(piece, plan, sample)
                rows = []
                for bucket, i, j in _buckets(runs.bucket):
                    sent = runs.sent[i:j]
                    size, least = runs.size[sent], runs.least[i:j]
                    base = int(least.min())
                    text = piece.buf[_ranges(runs.start[sent], size + plan.length - 1)]
                    head = np.int64(base).tobytes() + _packed(size, 4) + _packed(least.astype(np.uint64) - R.u64(base), 8)
                    rows.append((piece.name, bucket, j - i, zstandard.compress(head + text.tobytes(), 3)))
                yield _rows(rows)

    return run


def _received(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(sizes, doc_ids, text) of the runs of one row."""
    raw = zstandard.decompress(raw)
    base = int(np.frombuffer(raw, np.int64, 1)[0])
    size = _unpacked(raw[8 : 8 + 4 * n], 4).astype(np.int64)
    return size, (_unpacked(raw[8 + 4 * n : 8 + 12 * n], 8) + R.u64(base)).astype(np.int64), raw[8 + 12 * n :]


def _rank_suffixes(plan: Plan):
    """Arrow function: sort one bucket of suffixes; 1: a smaller doc_id than the row's own leads the tie.

    Runs that several pieces sent are held once, so the text of a bucket is that of its distinct runs.
    """

    def run(table: pa.Table) -> pa.Table:
        R.turn_to("suffix_dedup")
        place: dict[bytes, int] = {}
        run_of, docs, ends, total = [], [], [], 0
        for raw, n in zip(table.column("data"), table.column("n").to_pylist()):
            size, doc, text = _received(raw.as_py(), n)
            end = np.cumsum(size + plan.length - 1).tolist()
            run_of.append(np.array([place.setdefault(text[a:b], len(place)) for a, b in zip([0, *end], end)], np.int64))
            docs.append(doc)
            total += int(size.sum())
            ends.append(total)
        run_of, docs = np.concatenate(run_of), np.concatenate(docs)
        length = np.array([len(x) for x in place], np.int64)
        buf = padded(np.frombuffer(b"".join(place), np.uint8))
        del place
        size = length - plan.length + 1
        at = _ranges(np.cumsum(length) - length, size)
        least = np.full(len(length), np.iinfo(np.int64).max)
        np.minimum.at(least, run_of, docs)
        order, new = sort_suffixes(buf, at, plan.length, plan.v)
        del buf, at
        first = np.flatnonzero(new)
        own = np.repeat(least, size)
        leads = np.empty(len(order), np.int64)
        leads[order] = np.repeat(np.minimum.reduceat(own[order], first), np.diff(np.r_[first, len(order)]))
        del order, new, own
        found = np.empty(total, bool)
        begin, done = np.cumsum(size) - size, 0
        for i in range(0, len(run_of), 1 << 14):
            r = run_of[i : i + (1 << 14)]
            part = leads[_ranges(begin[r], size[r])] < np.repeat(docs[i : i + (1 << 14)], size[r])
            found[done : done + len(part)] = part
            done += len(part)
        R.trim()
        return _answered(table, found, np.array(ends), plan)

    return run


def _stored_ranks(sent: DataFrame, rank: Callable[[pa.Table], pa.Table], plan: Plan) -> str:
    """Answer every bucket; the folder's URI where a piece's answers are found again."""
    parts = max(int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions")), plan.parts)
    ranks = sent.repartition(parts, "bucket").groupBy("bucket").applyInArrow(rank, _RANKS)
    path = R.shared_dir(sent.sparkSession)
    with R.tidy(sent.sparkSession):
        ranks.repartition(plan.folders, "folder").sortWithinPartitions("folder", "block").write.partitionBy("folder").option("compression", "zstd").parquet(path)
    return path


# ------------------------------------------------------------------ removal


def _removed(block: Block, plan: Plan, sample: Answers, suffixes: Answers) -> np.ndarray:
    """Which bytes of the block go."""
    gone = np.zeros(len(block.data), bool)
    for piece in block.pieces(plan):
        runs = _piece_runs(piece, plan, sample)
        if not len(runs.start):
            continue
        size = runs.size[runs.sent]
        end = np.cumsum(size)
        bits = _bits_of(suffixes.of(piece.name), [(b, int(size[i:j].sum())) for b, i, j in _buckets(runs.bucket)])
        lost = bits[_ranges((end - size)[runs.which], runs.size)] | np.repeat(runs.doc_id > runs.least[runs.which], runs.size)
        q = _ranges(runs.start, runs.size)[lost]
        gone[piece.base : piece.base + piece.n] |= _spread(q, q + plan.length, piece.n)
    return gone


REPEATS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))])


def _report(plan: Plan, folder: str, *ranks: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = [Answers(r, plan) for r in ranks]
        for block in stored(batches, folder):
            gone, out = _removed(block, plan, *answers), []
            for a, b in zip(block.off.tolist(), block.off[1:].tolist()):
                own = gone[a:b]
                n = int(np.count_nonzero(own))
                spans = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8))).reshape(-1, 2).tolist() if n else []
                kept = block.data[a:b][~own] if n else block.data[a:b]
                out.append((b - a, n, len(spans), hashlib.sha256(kept.tobytes()).hexdigest(), spans))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([block.rows.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))))]], REPEATS.names)

    return run


def _cut(plan: Plan, folder: str, *ranks: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = [Answers(r, plan) for r in ranks]
        for block in stored(batches, folder):
            gone, rows = _removed(block, plan, *answers), block.rows
            if gone.any():
                texts, lengths = rows.column("text").to_pylist(), {}
                for k in np.flatnonzero(np.add.reduceat(np.r_[gone, False].astype(np.int64), block.off[:-1]) * (np.diff(block.off) > 0)).tolist():
                    a, b = block.off[k], block.off[k + 1]
                    texts[k] = block.data[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore")
                    lengths[k] = len(texts[k])
                rows = R.with_texts(rows, texts, lengths)
            yield rows

    return run


def _passes(docs: DataFrame, length: int, block_bytes: int) -> tuple[DataFrame, Plan, str, str, str]:
    spark = docs.sparkSession
    folder = R.shared_dir(spark)
    blocks = R.cut(docs.mapInArrow(_store(folder, block_bytes), BLOCKS))
    total = blocks.agg(F.sum("bytes")).head()[0] or 0
    plan = Plan.of(total, length, block_bytes)
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    blocks = blocks.repartitionByRange(tasks, "block").sortWithinPartitions("block")
    sample_ranks = _stored_ranks(blocks.mapInArrow(_send_sample(plan, folder), _SENT), _rank_sample(plan), plan)
    suffix_ranks = _stored_ranks(blocks.mapInArrow(_send_suffixes(plan, folder, sample_ranks), _SENT), _rank_suffixes(plan), plan)
    return blocks, plan, folder, sample_ranks, suffix_ranks


def repeats(docs: DataFrame, length: int = 50, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs (doc_id, text): bytes, removed bytes, maximal removed spans, their ends, and the SHA-256 of what is left.

    Null or empty text has no bytes. A null doc_id counts as the smallest; rows
    of one doc_id, repeated rows included, don't remove each other's bytes. Texts are taken
    whole, long ones in overlapping pieces; matches stay within a text. An empty
    table gives no rows.
    """
    docs, *rest = _passes(R.picked(docs, "doc_id", "text"), length, block_bytes)
    return docs.mapInArrow(_report(*rest), REPEATS)


def remove_repeats(docs: DataFrame, length: int = 50, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs, with all columns and rows, without the bytes that repeats() finds; a character cut in two goes, n_chars follows the text.

    Null and empty texts stay as they are; a text of repeats alone becomes empty.
    """
    schema = docs.schema
    docs, *rest = _passes(docs, length, block_bytes)
    return docs.mapInArrow(_cut(*rest), schema)
