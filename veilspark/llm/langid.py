"""Language identification: multinomial naive Bayes over hashed character n-grams.

A bounded sample of labelled rows is counted into (language, bucket) cells; the
log-probability matrix (buckets x languages) is broadcast, and whole texts are
scored by sparse gathers and segment sums in numpy.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import runtime as R

#: Hash buckets for n-grams of 1 to ORDERS characters.
BUCKETS, ORDERS = 1 << 16, 3
#: Bytes of the matrix that is broadcast: beyond 256 labels its buckets are halved until it fits, down to LEAST_BUCKETS (16,384 labels); every label is learned.
MATRIX_BYTES, LEAST_BUCKETS = 64 << 20, 1 << 10
#: Expected number of labelled rows sampled for each language (the bound of the training sample).
SAMPLE_ROWS = 2000
UNDETERMINED = "und"

_TABLES: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """By code point: itself if a letter, else 0."""
    if not _TABLES:
        t = np.arange(sys.maxunicode + 1, dtype=np.uint32)
        t[[not unicodedata.category(chr(c)).startswith("L") for c in range(sys.maxunicode + 1)]] = 0
        _TABLES.append(t)
    return _TABLES[0]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of n-grams, the text that each belongs to, letters in each text). An n-gram lies within a text and has a letter; what is no letter counts as a gap."""
    low = [t.lower() for t in texts]
    size = np.array([len(t) + 1 for t in low], np.int64)
    code = _letters()[np.frombuffer("\0".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    letter = code > 0
    buckets, owners, gram = [], [], code
    for n in range(1, ORDERS + 1):
        if n > 1:
            gram = R.combine(gram[:-1], code[n - 1 :])
        keep = letter if n == 1 else letter[:-1] | letter[1:] if n == 2 else letter[1 : len(letter) - n + 2]
        at = np.flatnonzero(keep[: len(gram)] & (owner[: len(gram)] == owner[n - 1 :]))
        buckets.append((R.mix(gram[at] + R.u64(n)) >> R.u64(48)).astype(np.int32))
        owners.append(owner[at])
    return np.concatenate(buckets), np.concatenate(owners), np.bincount(owner[letter], minlength=len(texts))


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray  # log, by language
    matrix: np.ndarray  # log-probabilities, buckets (a power of two) x languages

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text (the first in order of names on a tie) and its posterior probability."""
        if not self.languages or not texts:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        bucket, owner, letters = features(texts)
        bucket &= self.matrix.shape[0] - 1
        logs = np.tile(self.prior, (len(texts), 1))
        for k in range(len(self.languages)):
            logs[:, k] += np.bincount(owner, self.matrix[:, k][bucket], len(texts))
        best = logs.argmax(1)
        share = np.exp(logs - logs.max(1, keepdims=True))
        known = letters > 0
        return [self.languages[b] if k else UNDETERMINED for b, k in zip(best, known)], np.where(known, 1 / share.sum(1), 0.0)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the row serves for evaluation only: crc32(doc_id as text) mod 3 = 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in R.row_slices(batches, "langid"):
            bucket, owner, _ = features(R.texts_of(data, off))
            names, lang = np.unique(np.array(rows.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            cell, n = np.unique(lang[owner].astype(np.int64) * buckets + (bucket & (buckets - 1)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names[cell // buckets].tolist(), pa.string()), pa.array(cell % buckets), pa.array(n)], ["lang", "bucket", "n"])

    return run


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from text and non-null lang of the rows that aren't held out.

    About sample_rows rows of each label are taken, those whose hash of (doc_id,
    text length) is smallest; rows with equal hashes, repeated rows among them, come
    together. A label needs one text with a letter to be predicted; null and empty texts
    teach nothing. Without labelled rows the model predicts `und` only.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    sizes = usable.groupBy("lang").count().orderBy("lang").limit(MATRIX_BYTES // (4 * LEAST_BUCKETS) + 1).collect()
    if not sizes:
        return Model([], np.zeros(0), np.zeros((BUCKETS, 0), np.float32))
    buckets = BUCKETS
    while buckets * len(sizes) * 4 > MATRIX_BYTES:
        buckets //= 2
    if buckets < LEAST_BUCKETS:
        raise ValueError(f"more than {MATRIX_BYTES // (4 * LEAST_BUCKETS)} labels")
    spread = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30))
    bounds = docs.sparkSession.createDataFrame([(r.lang, int(min(1.0, sample_rows / r["count"]) * (1 << 30))) for r in sizes], "lang string, below long")
    chosen = usable.join(F.broadcast(bounds), "lang").where(spread < F.col("below")).select("text", "lang")
    cells = chosen.mapInArrow(_count(buckets), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted({r.lang for r in sizes} & set(cells.column("lang").unique().to_pylist()))
    counts = np.zeros((buckets, len(languages)), np.float32)
    place = {x: k for k, x in enumerate(languages)}
    counts[cells.column("bucket").to_numpy(), [place[x] for x in cells.column("lang").to_pylist()]] = cells.column("n").to_numpy()
    total = {r.lang: r["count"] for r in sizes}
    prior = np.log(np.array([total[x] for x in languages], float) / sum(total[x] for x in languages)) if languages else np.zeros(0)
    return Model(languages, prior, np.log((counts + 0.5) / (counts.sum(0, dtype=float) + 0.5 * buckets)).astype(np.float32))


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in R.row_slices(batches, "langid"):
            lang, score = model.value.score(R.texts_of(data, off))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs (doc_id, text): held_out, lang_pred and score in [0, 1].

    Texts that are null or have no letter are `und` with score 0. Repeated rows
    each give a row; null doc_ids count as not held out.
    """
    b = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return R.picked(docs, "doc_id", "text").withColumn("held_out", held_out()).mapInArrow(_predict(b), schema)


def _kept(model, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in R.row_slices(batches, "langid"):
            lang, score = model.value.score(R.texts_of(data, off))
            yield rows.filter(pa.array([x != UNDETERMINED and s >= least for x, s in zip(lang, score)], pa.bool_()))

    return run


def keep_identified(docs: DataFrame, model: Model, least_score: float = 0.4) -> DataFrame:
    """The rows of docs, with all their columns, whose language is determined with at least least_score.

    Null, empty and letterless texts go, as does every row if the model knows no
    language; repeated rows are judged alike.
    """
    return docs.mapInArrow(_kept(docs.sparkSession.sparkContext.broadcast(model), least_score), docs.schema)
