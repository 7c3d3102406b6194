"""MinHash near-duplicates: SuperMinHash signatures, banding, exact verification, grouping.

1. Sketch. Each document's set of word shingles is hashed once. SuperMinHash
   gives every element a random permutation of the slots, drawn a place at a time: in
   round j all elements of a document offer rank j plus a fraction to one slot
   each, and a slot takes the least. A document stops as soon as its slots are full.
2. Classes. Documents with equal sets are one class from here on, known by their least doc_id.
3. Bands. Classes that share a band's key are compared, by one byte of each slot of their
   signatures, with the least of them; those that don't agree with it well enough
   are compared with all others that share the key, in blocks of bounded size. What then agrees
   makes candidate components, so that texts which share no more than a template don't.
4. Verification. A candidate component's texts meet in one task if they are few;
   a larger one is laid out on a grid of block pairs of bounded size. Links are
   found on full sets by search from one member to all those not yet reached.
5. The verified links' components are the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import runtime as R
from .components import components

#: At a similarity of 0.8 a pair shares none of 48 bands of 6 slots with a chance below 5e-7.
BANDS, ROWS = 48, 6
#: Slots of two signatures agree in a share of about their similarity; candidates have so many standard deviations less than the least similarity at most.
#: A pair that just has it falls short with a chance of about 1e-9.
DEVIATIONS = 6
#: Classes of one bucket that a task compares with as many others.
BUCKET_CLASSES = 4096
#: Shingles of one block of the verification grid; a task holds two blocks at most.
BLOCK_SHINGLES = 2_000_000
#: Rounds whose permutations are traced through the earlier draws; later rounds, of short documents only, keep them in a table.
TRACED = 8

_B = np.arange(256)
_LOWER = (np.where((_B >= 0x41) & (_B <= 0x5A), _B + 32, _B) + 1).astype(np.uint16)
_IS_WORD = ~((_B == 0x20) | ((_B >= 9) & (_B <= 0x0D)))


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; a text of fewer words has its whole sequence as one."""
    s, e = R.word_runs(_IS_WORD[data], off)
    h = R.run_hashes(_LOWER[data], s, e)
    grams = R.gram_hashes(h, k)
    at = np.searchsorted(s, off)
    out = []
    for a, b in zip(at.tolist(), at[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(R.mix(R.gram_hashes(h[a:b], b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _draw(x: np.ndarray, j: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Round j of each element: its place among the slots from j on, and its rank with the fraction, as one integer."""
    z = R.mix(x + R.u64((j + 1) * 0x9E3779B97F4A7C15))
    place = (R.mix(z) >> R.u64(32)) % R.u64(m - j) + R.u64(j)
    return place.astype(np.int64), (z >> R.u64(16)) | R.u64(j << 48)


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures (sets x m slots). The slots of an empty set stay at the largest integer."""
    n = np.array([len(s) for s in sets], np.int64)
    x = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), n)
    none = R.u64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(len(sets) * m, none, np.uint64)
    drawn: list[np.ndarray] = []
    table = None
    for j in range(m):
        if not len(x):
            break
        place, rank = _draw(x, j, m)
        if j < TRACED:
            slot = place.copy()
            for i in range(j - 1, -1, -1):
                slot = np.where(slot == drawn[i], i, slot)
            drawn.append(place)
        else:
            if table is None:
                table = np.tile(np.arange(m, dtype=np.int16), (len(x), 1))
                row = np.arange(len(x))
                for i, p in enumerate(drawn):
                    table[row, i], table[row, p] = table[row, p], table[row, i].copy()
            row = np.arange(len(x))
            slot = table[row, place].astype(np.int64)
            table[row, place] = table[row, j]
        np.minimum.at(sig, doc * m + slot, rank)
        live = (sig.reshape(-1, m) == none).any(1)[doc]
        if not live.all():
            x, doc, drawn = x[live], doc[live], [d[live] for d in drawn]
            table = table[live] if table is not None else None
    return sig.reshape(-1, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each signature and band."""
    cut = sig.reshape(len(sig), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), cut.shape[:2])
    for r in range(rows):
        h = R.combine(h, cut[:, :, r])
    return R.mix(h)


SKETCH = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("slots", T.BinaryType())])


def _sketched(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in R.row_slices(batches, "minhash"):
            sets = shingle_sets(data, off, k)
            sig = super_minhash(sets, bands * rows)
            keys = band_keys(sig, bands, rows).view(np.int64)
            slots = (R.mix(sig) >> R.u64(56)).astype(np.uint8)
            n = [len(s) for s in sets]
            sums = np.array([[s.sum(dtype=np.uint64), R.mix(s).sum(dtype=np.uint64)] for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            full = np.array(n) > 0
            keys, at = keys[full], np.r_[0, np.cumsum(full * bands)].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel())), pa.array([x.tobytes() for x in slots], pa.binary())], SKETCH.names)

    return run


def least_agreement(slots: int, percent: int) -> int:
    """Agreeing slots from which on two classes are candidates."""
    p = percent / 100
    return max(1, int(slots * p - DEVIATIONS * (slots * p * (1 - p)) ** 0.5))


def _slots(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.uint8)


def _agree(least: int):
    """Arrow function: whether the slots of u and v agree in so many places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        R.turn_to("minhash")
        for b in batches:
            near = np.zeros(b.num_rows, bool)
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                near[i : i + 4096] = (_slots(part.column("su")) == _slots(part.column("sv"))).sum(1) >= least
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array(near)], ["u", "v", "near"])

    return run


def _bucket_links(least: int):
    """Arrow function: a bucket's block of classes against a block of those that its least one doesn't agree with: (u, v) that span
    what agrees, fewer than there are classes. Those that agree with the least one are tied to it already, and so to each other."""

    def run(table: pa.Table) -> pa.Table:
        R.turn_to("minhash")
        node, slots, far, tied = (table.column(c).combine_chunks() for c in ("node", "slots", "far", "tied"))
        node, far, tied, slots = node.to_numpy(), far.to_numpy(zero_copy_only=False), tied.to_numpy(zero_copy_only=False), _slots(slots)
        _, first, which = np.unique(node, return_index=True, return_inverse=True)
        group = first[which]
        group[np.isin(group, group[tied])] = -1
        links = []
        for i in np.flatnonzero(far).tolist():
            near = np.flatnonzero((slots == slots[i]).sum(1) >= least)
            others, at = np.unique(group[near], return_index=True)
            for other, k in zip(others.tolist(), near[at].tolist()):
                if other != group[i]:
                    links.append(sorted((int(node[i]), int(node[k]))))
                    group[group == other] = group[i]
        return pa.table({"u": pa.array([b for _, b in links], pa.int64()), "v": pa.array([a for a, _ in links], pa.int64())})

    return run


def _candidates(real: DataFrame, nodes: DataFrame, slots: int, percent: int, block: int) -> DataFrame:
    """Edges (u, v) between classes that share a band's key and whose slots agree, spanning all such pairs."""
    least = least_agreement(slots, percent)
    own = real.join(nodes, ["doc_id", "h1", "h2"], "left_semi").select(F.col("doc_id").alias("node"), "bands", "slots")
    keyed = own.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key", "least")
    # rows of one doc_id and text give the same slots, so a repeated row makes a repeated edge
    tied = R.cut(keyed.join(shared, "key").select("key", "node", "least").distinct())
    pairs = tied.where("node > least").select(F.col("node").alias("u"), F.col("least").alias("v")).distinct()
    by = lambda name, s: own.select(F.col("node").alias(name), F.col("slots").alias(s))
    judged = R.cut(pairs.join(by("u", "su"), "u").join(by("v", "sv"), "v").select("u", "v", "su", "sv").mapInArrow(_agree(least), "u long, v long, near boolean"))
    near, far = judged.where("near").select("u", "v"), judged.where("NOT near").select(F.col("u").alias("node"), F.col("v").alias("least")).distinct()
    if far.isEmpty():
        return near
    # a class is far from the least one of a key, or tied to it (the least one is tied to itself)
    marked = tied.join(far.withColumn("far", F.lit(True)), ["node", "least"], "left").select("key", "node", F.coalesce("far", F.lit(False)).alias("far"))
    sizes = marked.groupBy("key").agg(F.count("*").alias("n"), F.count_if("far").alias("n_far")).where("n_far > 0")
    blocks = sizes.select("key", F.ceil(F.col("n") / block).cast("int").alias("m"), F.ceil(F.col("n_far") / block).cast("int").alias("f"))
    laid = marked.join(blocks, "key").withColumn("h", F.xxhash64("node"))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    others = laid.where("NOT far OR f > 1 OR m > 1").withColumn("i", F.pmod("h", "m").cast("int")).withColumn("j", each(F.col("f"))).select("key", "i", "j", "node", F.lit(False).alias("far"), (~F.col("far")).alias("tied"))
    sought = laid.where("far").withColumn("j", F.pmod("h", "f").cast("int")).withColumn("i", each(F.col("m"))).select("key", "i", "j", "node", F.lit(True).alias("far"), F.lit(False).alias("tied"))
    rows = others.unionByName(sought).join(own.select("node", "slots"), "node")
    found = rows.groupBy("key", "i", "j").applyInArrow(_bucket_links(least), "u long, v long")
    return near.unionByName(R.cut(found))


def linked(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (i, j) that span the components of "100 * intersection >= percent * union" among the sets, all pairs considered.

    A search goes from one set to all not yet reached; a set that is reached is
    searched from in turn, and drops out of later comparisons.
    """
    if len(sets) < 2:
        return []
    size = np.array([len(s) for s in sets], np.int64)
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.r_[0, np.cumsum(size)]
    mark = np.zeros(len(values) + 1, np.int32)
    rest = np.flatnonzero(size)  # not yet reached
    own, first, held = ids, start[:-1][rest], rest
    links = []
    while len(rest):
        wait, rest = [int(rest[0])], rest[1:]
        while wait and len(rest):
            x = wait.pop()
            if len(rest) * 2 < len(held) or held is not rest:
                own = np.concatenate([ids[start[r] : start[r + 1]] for r in rest.tolist()])
                first, held = np.cumsum(size[rest]) - size[rest], rest
            of_x = ids[start[x] : start[x + 1]]
            mark[of_x] = 1
            both = np.add.reduceat(mark[own], first)
            mark[of_x] = 0
            near = 100 * both >= percent * (size[x] + size[rest] - both)
            if near.any():
                found = rest[near].tolist()
                links += [(x, r) for r in found]
                wait += found
                rest = rest[~near]
    return links


def _verified(k: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        doc, (data, off) = table.column("node").to_pylist(), R.text_views(table.column("text"))
        sets: list[np.ndarray] = []
        for i, j in R.slices(off):
            sets += shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], k)
        links = linked(sets, percent)
        return pa.table({"u": pa.array([doc[a] for a, _ in links], pa.int64()), "v": pa.array([doc[b] for _, b in links], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, block_shingles: int = BLOCK_SHINGLES, bucket_classes: int = BUCKET_CLASSES) -> DataFrame:
    """Per row of docs (doc_id, text): n_shingles, component_id (least doc_id reachable over links) and kept.

    Two documents are linked if 100 * intersection >= percent * union of their
    sets of `shingle`-word shingles. Null, empty and blank texts have empty sets
    and no links. Equal sets are linked. Rows of one doc_id are one document, even if
    their texts differ. Rows with a null doc_id are linked with nothing and kept. Empty tables give
    no rows. The result has one row for each row of docs.
    """
    docs = R.picked(docs, "doc_id", "text")
    sketch = R.cut(docs.mapInArrow(_sketched(shingle, bands, rows), SKETCH))
    real = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = R.cut(real.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("node")))
    nodes = classes.select("h1", "h2", F.col("node").alias("doc_id"))
    candidates = R.cut(components(_candidates(real, nodes, bands * rows, percent, bucket_classes)))
    sized = candidates.join(classes.select("node", "n_shingles"), "node")
    blocks = sized.groupBy("component").agg(F.ceil(F.sum("n_shingles") / F.lit(block_shingles)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    laid = candidates.join(blocks, "component").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    laid = laid.select("node", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    held = laid.join(docs.select(F.col("doc_id").alias("node"), "text"), "node")
    links = R.cut(held.groupBy("component", "i", "j").applyInArrow(_verified(shingle, percent), "u long, v long"))
    # rows of one doc_id with several sets tie their classes together
    mine = real.join(classes, ["h1", "h2", "n_shingles"]).select("doc_id", "node")
    ties = mine.where("doc_id > node").select(F.col("doc_id").alias("u"), F.col("node").alias("v")).distinct()
    final = components(links.unionByName(ties))
    out = sketch.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs, with all their columns, less those that near_duplicates() doesn't keep: null, empty and blank texts and rows without a doc_id stay."""
    gone = near_duplicates(docs, **options).where("NOT kept").select(F.col("doc_id").alias("veilspark_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("veilspark_gone"), "left_anti")
