"""Token counts for byte-level BPE by rank-synchronous merging of ragged arrays.

A text is cut before every space that a non-space follows, which the
vocabulary's pre-tokenizer does as well; each distinct piece is pre-tokenized
once, and the distinct pre-tokens of a slice are merged together: they lie in one
ragged numpy array, and in each round every sequence applies its lowest-rank
pair at all its places. Counts are remembered in bounded memory.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import runtime as R

#: Bytes of pieces in each of the two generations that a worker remembers, of an entry besides its characters, and of the longest piece that is kept.
MEMO_BYTES, ENTRY_BYTES, LONGEST = 40 << 20, 150, 4096
#: The pre-tokenizer's pattern for byte-level vocabularies of this kind (a fixed value of the format).
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_ODD_SPACE = re.compile(r" (?=\s|$)")
_NONE = np.int64(1 << 40)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: itself if printable Latin-1, else the next one from U+0100 on."""
    printable = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Merges:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("a byte-level vocabulary without normalizer is needed")
        vocab, self.n = model["vocab"], 1 << 17
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = {a + b: r for r, (a, b) in enumerate(pairs)}
        if len(made) < len(pairs) or any(max(made.get(a, -1), made.get(b, -1)) >= r for r, (a, b) in enumerate(pairs)):
            raise ValueError("each symbol must come from one merge, after those of its parts")
        keys = np.array([vocab[a] * self.n + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.symbol = np.array([vocab[c] for c in byte_symbols()], np.int64)
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(special)) if special else None
        self.memo: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.size = 0

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def count(self, pre_tokens: list[bytes]) -> np.ndarray:
        """Surviving symbols of each pre-token (none may be empty)."""
        length = np.array([len(x) for x in pre_tokens], np.int64)
        out = length.copy()
        sym = self.symbol[np.frombuffer(b"".join(pre_tokens), np.uint8)]
        seq = np.arange(len(pre_tokens))
        start = np.cumsum(length) - length
        rank = np.full(len(sym), _NONE)
        if len(sym) > 1:
            rank[:-1] = self._rank(sym[:-1], sym[1:])
        rank[start + length - 1] = _NONE
        while len(seq):
            low = np.minimum.reduceat(rank, start)
            live = low < _NONE
            if not live.all():
                out[seq[~live]] = length[~live]
                keep = np.repeat(live, length)
                sym, rank, seq, length, low = sym[keep], rank[keep], seq[live], length[live], low[live]
                start = np.cumsum(length) - length
                if not len(seq):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, length))
            if len(hit) > 1 and (near := np.diff(hit) == 1).any():
                # a pair of equal symbols in a row of them: every other place, from the left
                first = np.r_[True, ~near]
                hit = hit[(hit - np.maximum.accumulate(np.where(first, hit, 0))) % 2 == 0]
            sym[hit] = self.result[rank[hit]]
            last = np.zeros(len(sym), bool)
            last[start + length - 1] = True
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            last[hit] |= last[hit + 1]
            length = length - np.bincount(np.searchsorted(start, hit, side="right") - 1, minlength=len(seq))
            place = np.cumsum(keep) - 1
            new = place[hit]
            sym, rank, last = sym[keep], rank[keep], last[keep]
            start = np.cumsum(length) - length
            again = np.union1d(new, np.maximum(new - 1, 0))
            open_ = again[~last[again]]
            rank[again] = _NONE
            rank[open_] = self._rank(sym[open_], sym[open_ + 1])
        return out

    def learn(self, pieces: set[str]) -> None:
        """Remember the counts of pieces (texts that are tokenized on their own)."""
        new = []
        if self.size >= MEMO_BYTES:
            self.memo, self.old, self.size = {}, self.memo, 0
        for x in pieces:
            if x not in self.memo:
                if (n := self.old.get(x)) is None:
                    new.append(x)
                else:
                    self.memo[x] = n
                    self.size += ENTRY_BYTES + len(x)
        split = [PRE_TOKEN.findall(x) for x in new]
        distinct = list({t for x in split for t in x})
        counts = dict(zip(distinct, self.count([t.encode("utf-8", "surrogatepass") for t in distinct]).tolist())) if distinct else {}
        self.memo.update((x, sum([counts[t] for t in s])) for x, s in zip(new, split))
        self.size += sum([ENTRY_BYTES + (len(x) if x.isascii() else 4 * len(x)) for x in new])

    def tokens(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts; an added token's string in a text is one token, as by the library's default."""
        cut: list[list[str]] = []
        extra = [0] * len(texts)
        for k, text in enumerate(texts):
            parts = [text]
            if self.special and self.special.search(text):
                parts = self.special.split(text)
                extra[k] = len(parts) - 1
            pieces: list[str] = []
            for part in parts:
                if _ODD_SPACE.search(part):
                    pieces += PRE_TOKEN.findall(part)
                elif part:
                    words = part.split(" ")
                    pieces += words[:1] if words[0] else []
                    pieces += [" " + w for w in words[1:]]
            cut.append(pieces)
        self.learn(set().union(*cut))
        get = self.memo.__getitem__
        out = [sum(map(get, x)) + n for x, n in zip(cut, extra)]
        for x in {x for pieces in cut for x in pieces if len(x) > LONGEST}:
            del self.memo[x]
            self.size -= ENTRY_BYTES + (len(x) if x.isascii() else 4 * len(x))
        return out


_MERGES: dict[str, Merges] = {}
R.KEPT.append(_MERGES)


def merges(path: str) -> Merges:
    if path not in _MERGES:
        _MERGES[path] = Merges(path)
    return _MERGES[path]


COUNTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Per row of docs (doc_id, text): UTF-8 bytes, tokens, and whether these exceed limit.

    Null text counts as empty: no bytes, no tokens. Repeated rows each give a
    row; whole texts are counted, however long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in R.row_slices(batches, "token_counts"):
            n = merges(path).tokens(R.texts_of(data, off))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(off)), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], COUNTS.names)

    return R.picked(docs, "doc_id", "text").mapInArrow(run, COUNTS)
