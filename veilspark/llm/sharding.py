"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

Rows are numbered by a range sort on their keys only. A keyed four-round Feistel
network over the next even power of two permutes the numbers, and cycle walking
brings values beyond the row count back into range; permuted number p goes to
shard p mod n at slot p div n, so both can be computed for any row number
without the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import runtime as R

#: Keys of the Feistel rounds.
ROUND_KEYS = (0x2545F491, 0x9E3779B9, 0x7F4A7C15, 0x94D049BB)
_MASK32 = 0xFFFFFFFF


def half_bits(n: int) -> int:
    """Bits of half a block: the smallest even-width domain that holds n numbers."""
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def feistel(x: int, n: int, seed: int = 0) -> int:
    """The permuted place of row number x among n, in plain integers."""
    h = half_bits(n)
    mask = (1 << h) - 1
    while True:
        left, right = x >> h, x & mask
        for key in ROUND_KEYS:
            f = (right + ((key ^ seed) & _MASK32)) * 0x9E3779B1 & _MASK32
            f ^= f >> 15
            f = f * 0x85EBCA6B & _MASK32
            f ^= f >> 13
            left, right = right, left ^ (f & mask)
        x = left << h | right
        if x < n:
            return x


def permute(x: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """feistel() of an array of row numbers below n; values that leave the range walk on until all are back."""
    h = R.u64(half_bits(n))
    mask, low = (R.u64(1) << h) - R.u64(1), R.u64(_MASK32)
    out = x.astype(np.uint64)
    at = np.arange(len(out))
    while len(at):
        left, right = out[at] >> h, out[at] & mask
        for key in ROUND_KEYS:
            f = (right + R.u64((key ^ seed) & _MASK32)) * R.u64(0x9E3779B1) & low
            f ^= f >> R.u64(15)
            f = f * R.u64(0x85EBCA6B) & low
            f ^= f >> R.u64(13)
            left, right = right, left ^ (f & mask)
        out[at] = left << h | right
        at = at[out[at] >= R.u64(n)]
    return out.astype(np.int64)


SHARDS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("size", T.LongType()), T.StructField("text_crc32", T.LongType()), T.StructField("law", T.StringType()), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType()), T.StructField("grown_shard", T.IntegerType())])


def _placed(base: dict[int, int], n: int, shards: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            own = rows.column("veilspark_row").to_numpy()
            first = np.array([base[p] for p in np.unique(own >> 33).tolist()], np.int64)
            number = first[np.unique(own >> 33, return_inverse=True)[1]] + (own & ((1 << 33) - 1)) if len(own) else own
            p = permute(number, n, seed)
            m = len(own)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("size"), rows.column("text_crc32"), pa.array(["rows"] * m, pa.string()), pa.array((p % shards).astype(np.int32)), pa.array(p // shards), pa.nulls(m, pa.int32())], SHARDS.names)

    return run


def shard(docs: DataFrame, shards: int = 24, seed: int = 0) -> DataFrame:
    """Per row of docs (doc_id, text): size, CRC-32 of the text, shard and slot, by the law "rows": shard sizes differ by one at most, slots have no gaps.

    Row numbers follow (doc_id, CRC-32, size), nulls first; rows equal in all
    three are interchangeable and are spread over tasks by a salt. Null text is
    empty. Only these keys are sorted and stored, never texts. An empty table
    gives no rows.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keys = R.picked(docs, "doc_id", "text").select("doc_id", (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    order = ["doc_id", "text_crc32", "size"]
    salted = keys.withColumn("veilspark_salt", F.monotonically_increasing_id() % 64)
    numbered = R.cut(salted.repartitionByRange(*order, "veilspark_salt").sortWithinPartitions(*order).drop("veilspark_salt").withColumn("veilspark_row", F.monotonically_increasing_id()))
    base, n = {}, 0
    for r in numbered.groupBy(F.shiftright("veilspark_row", 33).alias("part")).count().orderBy("part").collect():  # a row for each partition
        base[r.part] = n
        n += r["count"]
    return numbered.mapInArrow(_placed(base, n, shards, seed), SHARDS)
