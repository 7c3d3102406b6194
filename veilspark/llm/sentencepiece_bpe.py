"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is cut into units at its word marks (no piece but runs of marks holds
one after its first symbol, which is checked when the vocabulary is loaded), and
each distinct unit is merged once by an agenda of adjacent symbol pairs ordered
by score, then by position. Symbols without a piece fall back to their bytes.
In every Arrow batch, the units met for the first time and one whole text are checked against the
sentencepiece library, the units encoded and decoded; a difference stops the job.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import runtime as R

MARK = "▁"
#: Bytes of units and ids in each of the two generations that a worker remembers.
MEMO_BYTES = 40 << 20
#: Of each slice, the first text that isn't longer is compared with the library as a whole.
WHOLE_CHARACTERS = 2000
#: Up to so many symbols the agenda is a flat list; beyond, a heap.
FLAT_SYMBOLS = 48
_UNIT = re.compile(f"{MARK}+[^{MARK}]*")


class Vocabulary:
    """Pieces and scores of a merge-type model file, and the library's processor to check against."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.vocab_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        special = {i for i in range(n) if lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) or lib.is_byte(i)}
        self.rank = {p: (-lib.get_score(i), i) for i, p in enumerate(self.pieces) if i not in special}
        self.cost = {p: r[0] for p, r in self.rank.items()}
        self.bos, self.eos = lib.bos_id(), lib.eos_id()
        if len(self.bytes) != 256 or any(MARK in p.lstrip(MARK) or (p[0] == MARK and p[:2] == MARK * 2 and p.strip(MARK)) for p in self.rank):
            raise ValueError("the vocabulary needs byte fallback and word marks only at the start of pieces")
        # byte values of what each id decodes to; control ids decode to nothing
        back = {i: bytes([b]) for b, i in self.bytes.items()}
        self.plain = [back.get(i, b"" if i in special else p.replace(MARK, " ").encode()) for i, p in enumerate(self.pieces)]
        self.memo = R.Memo(lambda word: array("I", self.merge(MARK + word)).tobytes(), MEMO_BYTES, listed=True)

    def merge(self, unit: str) -> list[int]:
        """Ids of one unit by the agenda: the best-scored adjacent pair is joined, the leftmost of equals first."""
        out: list[int] = []
        for s in (self._flat if len(unit) <= FLAT_SYMBOLS else self._heap)(list(unit)):
            out += [self.rank[s][1]] if s in self.rank else [self.bytes[b] for b in s.encode("utf-8", "surrogatepass")]
        return out

    def _flat(self, sym: list[str]) -> list[str]:
        cost, none = self.cost, math.inf
        agenda = [cost.get(a + b, none) for a, b in zip(sym, sym[1:])]
        while agenda and (best := min(agenda)) < none:
            i = agenda.index(best)
            sym[i] += sym.pop(i + 1)
            del agenda[i]
            if i:
                agenda[i - 1] = cost.get(sym[i - 1] + sym[i], none)
            if i < len(agenda):
                agenda[i] = cost.get(sym[i] + sym[i + 1], none)
        return sym

    def _heap(self, sym: list[str]) -> list[str]:
        left, right = list(range(-1, len(sym) - 1)), [*range(1, len(sym)), -1]
        agenda: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (joined := sym[i] + sym[j]) in self.cost:
                heapq.heappush(agenda, (self.cost[joined], i, j, joined))

        for i in range(len(sym) - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, joined = heapq.heappop(agenda)
            if not sym[i] or right[i] != j or sym[i] + sym[j] != joined:
                continue  # one of the two has been joined to another meanwhile
            sym[i], sym[j], right[i] = joined, "", right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [s for s in sym if s]

    def check(self) -> None:
        """Compare what was merged since the last call with the library, encoded and decoded."""
        fresh, self.memo.fresh = self.memo.fresh, []
        words = [w.replace(MARK, " ") for w, _ in fresh if w]
        theirs = self.lib.encode(words, num_threads=1)
        for word, (key, mine), ids in zip(words, [x for x in fresh if x[0]], theirs, strict=True):
            if mine != array("I", ids).tobytes() or self.decode(mine) != word:
                raise ValueError(f"{key!r}: {list(memoryview(mine).cast('I'))} here, {ids} from the library")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers, with begin and end ids."""
        get, head, tail = self.memo.__getitem__, array("I", [self.bos]).tobytes(), array("I", [self.eos]).tobytes()
        out = []
        for text in texts:
            if not text:
                words = []
            elif MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
                words = [u[1:] for u in _UNIT.findall(MARK + text.replace(" ", MARK))]
            else:
                words = text.split(" ")
            out.append(head + b"".join(map(get, words)) + tail)
        self.check()
        whole = next((k for k, t in enumerate(texts) if 0 < len(t) <= WHOLE_CHARACTERS), None)
        if whole is not None and self.lib.encode(texts[whole], add_bos=True, add_eos=True) != list(memoryview(out[whole]).cast("I")):
            raise ValueError(f"the library encodes {texts[whole]!r} in another way")
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces with marks as spaces, less the one that encoding puts before a text; bytes that are no UTF-8 become U+FFFD."""
        plain = self.plain
        raw = b"".join([plain[i] for i in memoryview(ids).cast("I")])
        return raw[raw[:1] == b" " :].decode("utf-8", "replace")


_VOCABULARIES: dict[str, Vocabulary] = {}
R.KEPT.append(_VOCABULARIES)


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in R.row_slices(batches, "sentencepiece_bpe"):
            ids = vocabulary(path).encode(R.texts_of(data, off))
            yield rows.append_column("ids", pa.array(ids, pa.binary()))

    return run


def _freed(df: DataFrame, name: str) -> DataFrame:
    """df without a column of that name: one that it has is renamed, as often as its new name is taken too."""
    other = f"{name}_before"
    while other in df.columns:
        other += "_before"
    return df.withColumnRenamed(name, other)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs with a column `ids`: the ids of the whole text as little-endian unsigned 32-bit integers.

    Null text counts as empty (begin and end ids only); other columns, repeated
    rows and nulls stay as they are; an own column named ids becomes `ids_before`.
    """
    docs = _freed(docs, "ids")
    return docs.mapInArrow(_encoded(path), T.StructType([*docs.schema.fields, T.StructField("ids", T.BinaryType())]))


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            text = [None if x is None else vocabulary(path).decode(x) for x in rows.column("ids").to_pylist()]
            yield rows.append_column("decoded", pa.array(text, pa.string()))

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with a column `decoded`, the text of its `ids`: null of null, empty of none; an own column of that name becomes `decoded_before`."""
    encoded = _freed(encoded, "decoded")
    return encoded.mapInArrow(_decoded(path), T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in R.row_slices(batches, "sentencepiece_bpe"):
            v = vocabulary(path)
            ids = v.encode(R.texts_of(data, off))
            sha = [hashlib.sha256(x).hexdigest() for x in ids]
            back = [hashlib.sha256(v.decode(x).encode()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(sha), pa.array(back)], DIGEST.names)

    return run


DIGEST = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row of docs (doc_id, text): number and SHA-256 of the ids, and SHA-256 of the text decoded from them; both steps in one pass, so that ids needn't go through the JVM.

    Null text counts as empty, repeated rows each give a row, texts are encoded whole, an empty table gives no rows.
    """
    return R.picked(docs, "doc_id", "text").mapInArrow(_digests(path), DIGEST)
