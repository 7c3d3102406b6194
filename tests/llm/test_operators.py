"""Every operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspark.llm import components, decontaminate, langid, media, minhash, runtime, sentencepiece_bpe, sharding, suffix_dedup, token_counts, token_files, warc

PIECES, BYTES, WORDS = (public_tokenizers.path(x) for x in ("piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "ids string, decoded int, n_tokens string, key double, node string, bands long, component string, bucket int, block string, html int, digest long, shard string, n_words string"


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}{'é' * r.randrange(2)}" for _ in range(n))


BENCH = [(1, "The quick brown fox, jumps over the lazy dog again TODAY okay"), (2, "short item"), (3, None), (4, ""), (5, "?!"), (10, "The quick brown fox jumps over the lazy dog again")]
LONG = words(20_000, 1, 5000)
TEXTS = [
    None, "", " ", "\n\t", "...", "a", "A", "one two", "Two  spaces  and\ttabs\r\n", LONG, LONG, LONG + " x", words(100, 2), words(100, 2), words(99, 2), words(60, 3) + " " + BENCH[0][1] + " " + words(60, 4),
    "THE QUICK brown-fox jumps; over the lazy dog again", "short item", "Item short ITEM", "▁mark ▁▁ <s> </s> <0x41> <|endoftext|> \x00\x1c\x85\xa0", "naïve ﬁ ①中文字\U0001F600", "x" * 3000, "ab" * 40 + words(30, 5), words(30, 6) + "ab" * 40,
]


def rows():
    out = [(i, t, ("en", "fr", None)[i % 3], "s", len(t or "")) for i, t in enumerate(TEXTS)]
    return [*out, out[12], out[9], (None, "nameless row", "en", None, None), (None, words(100, 2), None, None, None), (7, "a second text of document seven", "fr", None, None)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    df = spark.createDataFrame(rows(), SCHEMA)
    for name, kind in (c.split() for c in CLASH.split(", ")):
        df = df.withColumn(name, F.lit("7").cast(kind))
    path = str(tmp_path_factory.mktemp("docs"))
    df.repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def collected(df):
    return Counter(tuple(tuple(map(tuple, v)) if isinstance(v, list) and v and isinstance(v[0], list) else tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect())


def sha(x):
    return hashlib.sha256(x).hexdigest()


# decontamination


def brute_hits(text):
    low = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))]
    hit, items = set(), set()
    for item, t in BENCH:
        ws = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
        n = min(10, len(ws))
        for i in range(len(ws) - n + 1) if ws else ():
            for j in range(len(low) - n + 1):
                if low[j : j + n] == ws[i : i + n]:
                    hit |= set(range(j, j + n))
                    items.add(str(item))
    return len(low), len(hit), sorted(items)


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 1])
def test_decontaminate_hits(docs, bench, block_bytes):
    want = Counter((d, n, h, len(i), sha(",".join(i).encode()), h > 0) for d, t, *_ in rows() for n, h, i in [brute_hits(t)])
    assert collected(decontaminate.digest(decontaminate.hits(docs, bench, block_bytes=block_bytes))) == want


def test_decontaminate_removes_spans_and_documents(docs, bench):
    got = decontaminate.decontaminate(docs, bench)
    assert got.columns == docs.columns
    texts = {r.doc_id: r.text for r in got.collect()}
    assert not {16, 17, 18} & texts.keys()
    assert all(brute_hits(t)[1] == 0 for t in texts.values())
    assert texts[15].split() == (words(60, 3) + " " + words(60, 4)).split()
    assert texts[9] == LONG and texts[0] is None
    assert next(r.n_chars for r in got.collect() if r.doc_id == 15) == len(texts[15])


def test_decontaminate_is_the_same_in_blocks(spark):
    """Hits of 30 % and 30 % in two blocks drop a document as 60 % in one do, and a cut that joins a window of another block is cut again."""
    w = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    a, b, c = w(1, 12), w(2, 12), w(3, 12)
    bench = spark.createDataFrame([(1, a), (2, b), (3, c)], "item_id long, text string")
    docs = [(1, f"{a} {b} {w(4, 16)}", 1), (2, f"{a} {w(5, 40)} {b}", 2), (3, f"{w(6, 40)} {w(3, 6)} {a} " + c.split(" ", 6)[6], 3), (4, None, 4), (5, w(7, 5), 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    got = [{tuple(r) for r in decontaminate.decontaminate(df, bench, block_bytes=size).collect()} for size in (decontaminate.BLOCK_BYTES, 1)]
    assert got[0] == got[1]
    texts = {d: t for d, t, _ in got[1]}
    assert texts.keys() == {2, 3, 4, 5} and texts[2].split() == w(5, 40).split() and texts[3].split() == w(6, 40).split()


def test_decontaminate_empty(spark, docs, empty, bench):
    assert decontaminate.hits(empty, bench).count() == 0
    assert decontaminate.hits(docs, bench.limit(0)).where("n_hit > 0").count() == 0


# WARC

PAGES = [(1, "http://a/b c", "x" * 1500), (2, None, "x" * 1500), (3, "u", "x" * 999), (4, "u", "x" * 999), (5, "u", None), (6, "u", ""), (7, "u", "é" * 500), (8, "u", "é" * 500), (9, "u\r\nWARC-Type: evil", "<p>\r\n\r\nWARC/1.1\r\n</p>"), (7, "u", "é" * 500), (None, "n", "x" * 1500), (10, "big", "<b>" + LONG * 5)]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    folder = f"file://{tmp_path}"
    got = collected(warc.read(warc.write(pages, folder), folder).drop("url"))
    head = {}
    for p, _, h in PAGES:
        if h and len(h.encode()) >= 1000:
            head[h] = max(head.get(h, -1), -1 if p is None else p)
    want = Counter()
    for p, _, h in PAGES:
        b = (h or "").encode()
        again = h in head and p != head[h]
        want[(p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", head[h] if again else None)] += 1
    assert got == want
    assert warc.read(warc.write(pages.limit(0)), folder).count() == 0


def test_warc_reader_rejects_damage(tmp_path):
    import io

    sink = io.BytesIO()
    w = warc.Writer(sink)
    for i in range(300):
        w.add(warc.record_bytes(i, "u", b"p%d" % i * 50, hashlib.sha1(b"p%d" % i * 50).hexdigest(), None, False, "1970-01-01T00:00:00Z"))
    w.close()
    whole = sink.getvalue()
    assert [warc.page_of(r.headers["warc-record-id"]) for r in warc.read_archive(io.BytesIO(whole), 100)] == list(range(300))
    for bad in (whole[:-3], b"\0" * 8 + whole[8:], whole[:-40] + b"\x55" + whole[-39:]):
        with pytest.raises(Exception):  # noqa: B017
            list(warc.read_archive(io.BytesIO(bad)))
    good = warc.record_bytes(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None, False, "d")
    warc.parse_record(good)
    for a, b in ((b"abc\r\n", b"abd\r\n"), (b"WARC/1.1", b"WARC/9.1"), (b"Content-Length: 3", b"Content-Length: 4"), (b"WARC-Date: d\r\n", b"")):
        with pytest.raises(ValueError):
            warc.parse_record(good.replace(a, b))


# tokenizers


def library_pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_sentencepiece_matches_library(docs, empty):
    lib = library_pieces()
    want = Counter()
    for d, t, *_ in rows():
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        want[(d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(lib.decode(ids).encode()))] += 1
    assert collected(sentencepiece_bpe.digests(docs, PIECES)) == want
    both = sentencepiece_bpe.decode(sentencepiece_bpe.encode(docs, PIECES), PIECES)
    assert all(r.decoded == lib.decode(np.frombuffer(r.ids, "<u4").tolist()) for r in both.collect()) and both.count() == len(rows())
    assert sentencepiece_bpe.digests(empty, PIECES).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab  \n▁é<s>theing"), st.characters(exclude_categories=["Cs"])), max_size=120))
def test_sentencepiece_any_text(text):
    v, lib = sentencepiece_bpe.vocabulary(PIECES), sentencepiece_bpe.vocabulary(PIECES).lib
    ids = v.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == lib.encode(text, add_bos=True, add_eos=True)
    assert v.decode(ids) == lib.decode(np.frombuffer(ids, "<u4").tolist())


def test_sentencepiece_agendas_agree():
    v, r = sentencepiece_bpe.vocabulary(PIECES), random.Random(1)
    for _ in range(300):
        x = "".join(r.choice("thein gab▁") for _ in range(r.randrange(1, 90)))
        assert v._flat(list(x)) == v._heap(list(x))


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_token_counts_match_library(docs, empty):
    lib = library(BYTES)
    want = Counter((d, len((t or "").encode()), n, n > 512) for d, t, *_ in rows() for n in [len(lib.encode(t or "", add_special_tokens=False).ids)])
    assert collected(token_counts.token_counts(docs, BYTES)) == want
    assert token_counts.token_counts(empty, BYTES).count() == 0


_LIB7 = library(BYTES)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("ab  \n's'll<|endoftext|>theing"), st.characters(exclude_categories=["Cs"])), max_size=80), max_size=5))
def test_token_counts_any_text(texts):
    assert token_counts.merges(BYTES).tokens(texts) == [len(_LIB7.encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_counts_forget(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO_BYTES", 2000)
    m = token_counts.Merges(BYTES)
    texts = [words(20, k) for k in range(10)]
    for _ in range(2):
        assert [m.tokens([t])[0] for t in texts] == [len(_LIB7.encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_files(spark, docs, empty, tmp_path, monkeypatch):
    lib, folder = library(WORDS), f"file://{tmp_path}"
    manifest = token_files.write(docs, WORDS, 1, folder)
    got = token_files.read(manifest, folder).collect()
    want = Counter((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, t, *_ in rows() for ids in [[*lib.encode(t or "", add_special_tokens=False).ids, 1]])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: -1 if d is None else d)
    one = next(r.path for r in manifest.collect())
    ids = token_files.documents_of(one, [3, 9, 999])
    assert all(np.array_equal(v, [*lib.encode(TEXTS[k] or "", add_special_tokens=False).ids, 1]) for k, v in ids.items()) and 999 not in ids
    assert token_files.read(token_files.write(empty, WORDS, 1), folder).count() == 0


def test_token_file_frames_and_damage(tmp_path, monkeypatch):
    import io

    import zstandard

    monkeypatch.setattr(token_files, "FRAME_BYTES", 64)
    sink, r = io.BytesIO(), random.Random(3)
    docs = [(k if k % 7 else None, np.array([r.randrange(60000) for _ in range(r.choice([0, 1, 5, 200]))], "<u2")) for k in range(100)]
    w = token_files.Writer(sink, 2)
    for d, ids in docs:
        w.add(d, ids.tobytes())
    w.close()
    raw = sink.getvalue()
    reader = token_files.Reader(io.BytesIO(raw), len(raw))
    assert len(reader.table) > 20
    for k in r.sample(range(100), 100):
        assert np.array_equal(reader.ids(k), docs[k][1])
    stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True)
    assert stream.read().startswith(b"".join(i.tobytes() for _, i in docs))
    for at in (5, len(raw) - 3, len(raw) - 30):
        bad = raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :]
        with pytest.raises(Exception):  # noqa: B017
            reader = token_files.Reader(io.BytesIO(bad), len(bad))
            [reader.ids(k) for k in range(100)]


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aB.,  \n's!\x1c<|endoftext|>"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_word_encoder_any_text(text):
    e = token_files.encoder(WORDS)
    assert np.frombuffer(e.encode(text), "<u2").tolist() == e.lib.encode(text, add_special_tokens=False).ids


def test_token_files_with_another_tokenizer(docs):
    """A tokenizer that does not work word by word gets whole texts."""
    lib = library(BYTES)
    folder = runtime.shared_dir(docs.sparkSession)
    got = token_files.read(token_files.write(docs, BYTES, 1, folder), folder).collect()
    want = Counter((d, zlib.crc32(np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for d, t, *_ in rows())
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want and token_files.encoder(WORDS).by_word


def test_memories_are_bounded_in_bytes(monkeypatch):
    """Long words without spaces make no worker's memory grow beyond its two generations."""
    import tracemalloc

    r = random.Random(2)
    long_words = ["".join(r.choices("abcdefghijklmnop", k=300)) for _ in range(6000)]
    for make, module in ((lambda: sentencepiece_bpe.Vocabulary(PIECES).encode, sentencepiece_bpe), (lambda: token_files.Encoder(WORDS).encode, token_files), (lambda: token_counts.Merges(BYTES).tokens, token_counts)):
        monkeypatch.setattr(module, "MEMO_BYTES", 1 << 20)
        encode = make()
        tracemalloc.start()
        for i in range(0, len(long_words), 200):
            encode([" ".join(long_words[i : i + 200])] if module is not token_files else " ".join(long_words[i : i + 200]))
        held, _ = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert held < 4 << 20, (module.__name__, held)
    memo = runtime.Memo(lambda k: k.encode(), 1 << 20)
    assert memo["x" * 100_000] and not memo.size and memo["y"] == b"y" == memo["y"] and memo.size


# media


def test_media_round_trip(docs, empty):
    want = Counter()
    for d, t, *_ in rows():
        b = (t or "").encode()
        p = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        want[(d, len(b), len(p), sha(p), zlib.crc32(p[-32:]))] += 1
    got = media.read_features(media.store(docs))
    assert collected(got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")) == want
    assert got.select("payload_sha256").distinct().count() == got.select("media_sha256", "feature", "payload_sha256", "media_bytes").distinct().count()
    assert media.read_features(media.store(empty)).count() == 0


def scalar_dc(image):
    """Baseline Huffman decoding bit by bit: the DC values of the first component's blocks in scan order."""
    codes = {}
    for key, t in image.tables.items():
        code, k, table = 0, 16, {}
        for n in range(1, 17):
            for _ in range(t[n - 1]):
                table[(n, code)] = t[k]
                code, k = code + 1, k + 1
            code <<= 1
        codes[key] = table
    out = []
    for lane in re.split(rb"\xff[\xd0-\xd9]", image.body)[:-1]:
        bits = "".join(f"{b:08b}" for b in lane.replace(b"\xff\x00", b"\xff"))
        at, pred = 0, 0

        def symbol(table):
            nonlocal at
            n, code = 0, 0
            while (n, code) not in table:
                code, n, at = code << 1 | int(bits[at]), n + 1, at + 1
            return table[(n, code)]

        for _ in range(min(image.interval, 24)):
            s = symbol(codes[0])
            v = int(bits[at : at + s] or "0", 2)
            at += s
            pred += v if not s or v >= 1 << s - 1 else v - (1 << s) + 1
            out.append(pred)
            assert symbol(codes[0x10]) == 0
    return out


def test_media_against_scalar_decoder():
    r = np.random.default_rng(5)
    payload = r.integers(0, 256, 576 * 3, dtype=np.uint8)
    stored = media.encode(payload, np.array([0, 576, 576 * 3]))
    images = [media.parse(x)[0] for x in stored]
    assert [v + 128 for x in images for v in scalar_dc(x)] == payload.tolist()
    assert images[1].width == 192 and images[1].height == 8 * 48
    for bad in (stored[0][:-2], stored[0][2:], stored[0].replace(b"\xff\xc0", b"\xff\xc2", 1), stored[0][:400] + stored[0][402:]):
        with pytest.raises(ValueError):
            media.thumbnails(media.parse(bad))


def test_media_colour_with_ac():
    """A hand-made 16x16 image, 4:2:0, with AC coefficients and no restart markers."""
    bits = []
    dc = {0: "00", 3: "01"}
    ac = {0x00: "0", 0x11: "10", 0xF0: "110"}
    table_dc, table_ac = bytes([0, 2, *[0] * 14, 0, 3]), bytes([1, 1, 1, *[0] * 13, 0x00, 0x11, 0xF0])
    blocks = [(5, []), (4, [0x11]), (-6, [0xF0, 0x11]), (7, []), (0, []), (0, [0x11])]  # DC differences of Y Y Y Y Cb Cr
    for d, acs in blocks:
        size = 3 if d else 0
        bits += [dc[size], f"{d if d > 0 else d + 7:03b}" if size else ""]
        bits += [x for a in acs for x in (ac[a], "1" if a & 15 else "")] + [ac[0x00]]
    raw = "".join(bits)
    raw += "1" * (-len(raw) % 8)
    body = bytes(int(raw[i : i + 8], 2) for i in range(0, len(raw), 8)).replace(b"\xff", b"\xff\0")
    seg = media._segment
    data = b"\xff\xd8" + seg(0xDB, bytes([0, 16] + [1] * 63)) + seg(0xC0, bytes([8, 0, 16, 0, 16, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])) + seg(0xC4, bytes([0]) + table_dc) + seg(0xC4, bytes([0x10]) + table_ac) + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + body + b"\xff\xd9"
    assert media.thumbnails(media.parse(data))[0].tolist() == [[138, 146], [134, 148]]


# sharding


def test_sharding(docs, empty):
    got = sharding.shard(docs, 5).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows())
    by = Counter(r.shard for r in got)
    assert max(by.values()) - min(by.values()) <= 1 and len(by) == 5
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in by.items())
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    order = sorted(got, key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.text_crc32, r.size))
    places = Counter((r.doc_id, r.text_crc32, r.size, sharding.feistel(i, len(got)) % 5) for i, r in enumerate(order))
    assert Counter((r.doc_id, r.text_crc32, r.size, r.shard) for r in got) == places
    assert sharding.shard(empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 257, 5000])
def test_feistel_is_a_permutation(n):
    p = sharding.permute(np.arange(n), n, seed=9)
    assert sorted(p.tolist()) == list(range(n)) and [sharding.feistel(x, n, 9) for x in range(n)] == p.tolist()


# suffix dedup


def brute_repeats(table, length):
    first = {}
    for d, t in table:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            k = b[i : i + length]
            first[k] = min(first.get(k, d), d)
    out = Counter()
    for d, t in table:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        out[(d, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone) if not g)))] += 1
    return out


@pytest.mark.parametrize(("length", "block_bytes"), [(50, suffix_dedup.BLOCK_BYTES), (50, 2000), (50, 300), (14, 700), (5, 700)])
def test_suffix_dedup(spark, docs, tmp_path, length, block_bytes):
    r = random.Random(length)
    passages = [words(20, k) for k in range(4)]
    extra = [(100 + k, " ".join(r.choice([words(15, 1000 + k), r.choice(passages), r.choice(passages)[7:90], "", "aa" * 40]) for _ in range(4))) for k in range(40)]
    table = [(d, t) for d, t, *_ in rows() if t is None or len(t) < 10_000] + extra
    spark.createDataFrame(table, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/t")
    got = collected(suffix_dedup.repeats(spark.read.parquet(f"{tmp_path}/t"), length, block_bytes).drop("spans"))
    want = brute_repeats([(-(1 << 63) if d is None else d, t) for d, t in table], length)
    assert got == Counter({(None if k[0] < 0 else k[0], *k[1:]): n for k, n in want.items()})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab\0", max_size=130), min_size=1, max_size=6), st.sampled_from([(2, 1), (7, 3), (14, 7), (26, 13), (50, 21)]))
def test_suffixes_of_a_bucket_are_sorted_by_their_bytes(texts, shape):
    """Every string starts exactly one class, though ties beyond v bytes are resolved by ranks of the cover alone."""
    length, v = shape
    data = "".join(texts).encode()
    at = np.array([i + sum(map(len, texts[:k])) for k, t in enumerate(texts) for i in range(len(t) - length + 1)], np.int64)
    if not len(at):
        return
    order, new = suffix_dedup.sort_suffixes(suffix_dedup.padded(np.frombuffer(data, np.uint8)), at, length, v)
    got = [data[i : i + length] for i in at[order].tolist()]
    assert sorted(order.tolist()) == list(range(len(at))) and got == sorted(got)
    assert [g for g, n in zip(got, new.tolist()) if n] == sorted(set(got))


def test_equal_hashes_remove_nothing(monkeypatch):
    """With one hash for all strings, runs and suffixes are still told apart by their bytes."""
    texts = [words(30, 1), words(12, 2) + " " + words(30, 1), words(30, 3), words(30, 1)]
    plan = suffix_dedup.Plan.of(1000, 50)
    ids = np.array([5, 3, 9, 8])
    off = np.cumsum([0, *[len(t.encode()) for t in texts]])
    piece = suffix_dedup.Piece(0, 0, suffix_dedup.padded(np.frombuffer("".join(texts).encode(), np.uint8)), off, ids)
    monkeypatch.setattr(suffix_dedup, "hashes", lambda buf, at, n: np.zeros(len(at), np.uint64))
    monkeypatch.setattr(suffix_dedup, "all_hashes", lambda buf, end, n: np.zeros(end, np.uint64))
    p, keys = suffix_dedup._sampled(piece, plan)
    assert len(keys.key) == 1 and keys.shared.all()
    runs = suffix_dedup._runs(piece, plan, np.ones(1, bool), p, keys)
    content = [piece.buf[a : a + n + 49].tobytes() for a, n in zip(runs.start.tolist(), runs.size.tolist())]
    assert len(set(zip(content, runs.which.tolist()))) == len(runs.sent) >= len(set(content))  # runs that are one are equal
    text = b"".join(content[k] for k in runs.sent.tolist())
    n = len(runs.sent)
    raw = np.int64(0).tobytes() + suffix_dedup._packed(runs.size[runs.sent], 4) + suffix_dedup._packed(runs.least, 8) + text
    table = pa.Table.from_batches([suffix_dedup._rows([(0, 0, n, suffix_dedup.zstandard.compress(raw))])])
    (answer,) = suffix_dedup._rank_suffixes(plan)(table).to_pylist()
    bits = np.unpackbits(np.frombuffer(answer["bits"], np.uint8), count=int(runs.size[runs.sent].sum())).tolist()
    strings = [(content[k][i : i + 50], int(d)) for k, d in zip(runs.sent.tolist(), runs.least) for i in range(int(runs.size[k]))]
    least = {}
    for x, d in strings:
        least[x] = min(least.get(x, d), d)
    assert bits == [int(least[x] < d) for x, d in strings] and any(bits)


def test_suffix_buckets_are_bounded():
    for total in (10**5, 860_000_000, 51 * 10**9, 10**14):
        plan = suffix_dedup.Plan.of(total, 50)
        assert total >> plan.suffix_bits < suffix_dedup.BUCKET_BYTES and (total * 5 // 21) >> plan.bits <= suffix_dedup.BUCKET_KEYS
        assert 2 ** (8 * plan.narrow + plan.bits) >= total


def test_suffix_dedup_keeps_rows_and_columns(docs, empty):
    got = suffix_dedup.remove_repeats(docs.where("doc_id IS NOT NULL").repartition(2), block_bytes=50_000)
    assert got.columns == docs.columns and got.count() == docs.where("doc_id IS NOT NULL").count()
    texts = {r.doc_id: (r.text, r.n_chars) for r in got.collect()}
    assert texts[10] == ("", 0) and texts[9][0] == LONG and texts[0][0] is None
    assert suffix_dedup.repeats(empty).count() == 0


def test_covers():
    for v, cover in suffix_dedup.COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


# language ID


def test_langid_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict(docs, langid.fit(docs)).join(docs, "doc_id").where("held_out AND lang IS NOT NULL")
    assert got.where("lang = lang_pred").count() >= 0.98 * got.count() > 0


def test_langid_edges(spark, docs, empty):
    model = langid.fit(docs)
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows())
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.lang_pred in {"en", "fr", "und"}
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {0, 1, 2, 3, 4}
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and not {r.doc_id for r in kept.collect()} & {0, 1, 2, 3, 4}
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(empty)).collect()} == {"und"}


def test_langid_learns_every_label(spark):
    """A hundred labels, each with an alphabet of its own, and fewer buckets where the matrix would be too large."""
    r = random.Random(4)
    table = [(i, "".join(chr(0x4E00 + 40 * (i % 100) + r.randrange(40)) for _ in range(60)), f"l{i % 100:02}") for i in range(1200)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.languages) == 100 and model.matrix.shape == (langid.BUCKETS, 100)
    names, _ = model.score([t for _, t, _ in table])
    assert names == [x for _, _, x in table]


def test_langid_matrix_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "MATRIX_BYTES", 4 * 3 * (1 << 12))
    table = [(i, ("abc", "xyz", "mno")[i % 3] * 20, ("a", "x", "m")[i % 3]) for i in range(30)]
    model = langid.fit(spark.createDataFrame(table, "doc_id long, text string, lang string"))
    assert model.matrix.shape == (1 << 12, 3) and model.score(["abcabc", "zyxxyz", "nom"])[0] == ["a", "x", "m"]


def test_langid_score_is_the_posterior():
    m = langid.Model(["a", "b"], np.log([0.5, 0.5]), np.log(np.random.default_rng(1).dirichlet(np.ones(langid.BUCKETS), 2).T).astype(np.float32))
    b, o, _ = langid.features(["Héy you", "", "12"])
    s = [m.prior[k] + sum(float(m.matrix[x, k]) for x, t in zip(b, o) if t == 0) for k in (0, 1)]
    lang, score = m.score(["Héy you", "", "12"])
    assert lang[0] == "ab"[int(np.argmax(s))] and lang[1:] == ["und", "und"]
    assert abs(score[0] - 1 / (1 + np.exp(min(s) - max(s)))) < 1e-6


# MinHash


def brute_components(table, k, percent):
    sets = []
    for d, t in table:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    up = {d: d for d, _ in table if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, _) in enumerate(table):
        for j, (b, _) in enumerate(table[:i]):
            if a is not None and b is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return Counter((d, len(s), None if d is None else root(d), d is None or root(d) == d) for (d, _), s in zip(table, sets))


def chains():
    """Near copies in a chain and around a base, borderline pairs and short texts."""
    r, out = random.Random(4), []
    base = words(60, 50).split()
    chain = list(base)
    for k in range(30):
        chain[r.randrange(60)] = f"c{k}"
        copy = list(base)
        for p in r.sample(range(60), r.choice([1, 3, 4, 5, 8])):
            copy[p] = f"v{k}{p}"
        out += [" ".join(chain), " ".join(copy)]
    out += ["a b c d e f", "a b c d e f g", "A B c d e", "a b", "b a", "x", "X", "x\ny"]
    r.shuffle(out)
    return [(200 + k, t) for k, t in enumerate(out)]


@pytest.mark.parametrize(("k", "block"), [(2, minhash.BLOCK_SHINGLES), (2, 700), (5, 300)])
def test_minhash_components(spark, docs, k, block):
    table = [(d, t) for d, t, *_ in rows()] + chains()
    got = minhash.near_duplicates(spark.createDataFrame(table, "doc_id long, text string").repartition(3), shingle=k, block_shingles=block)
    assert collected(got) == brute_components(table, k, 80)


def test_minhash_keeps_one(docs, empty):
    got = minhash.keep_one(docs)
    ids = Counter(r.doc_id for r in got.collect())
    assert got.columns == docs.columns
    assert ids[9] == 2 and ids[10] == ids[11] == ids[13] == ids[14] == 0 and ids[12] == 2 and ids[None] == 2 and ids[0] == ids[1] == 1
    assert minhash.near_duplicates(empty).count() == 0


def test_super_minhash_is_the_definition():
    """Against the algorithm as published: an explicit permutation for each element and all rounds."""
    m, r = 40, np.random.default_rng(2)
    sets = [np.unique(r.integers(1, 1 << 60, n).astype(np.uint64)) for n in (1, 2, 5, 30, 300)]
    want = []
    for s in sets:
        sig = [2**64 - 1] * m
        for x in s:
            p = list(range(m))
            for j in range(m):
                place, rank = minhash._draw(np.array([x]), j, m)
                k = int(place[0])
                p[j], p[k] = p[k], p[j]
                sig[p[j]] = min(sig[p[j]], int(rank[0]))
        want.append(sig)
    assert minhash.super_minhash([*sets, np.zeros(0, np.uint64)], m)[:-1].tolist() == want


def test_super_minhash_estimates_similarity():
    r = np.random.default_rng(3)
    errors = []
    for _ in range(30):
        x = r.integers(1, 1 << 60, 150).astype(np.uint64)
        a, b = minhash.super_minhash([x[:120], x[30:]], 288)
        errors.append((a == b).mean() - 90 / 150)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < (0.6 * 0.4 / 288) ** 0.5 * 1.2


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=25))
def test_linked_sets_span_components(edges):
    sets = [np.unique(np.array([hash((a // 2, b)) & 0xFFFF for b in range(a, a + 9)], np.uint64)) for a, _ in edges]
    links = minhash.linked(sets, 80)
    up = list(range(len(sets)))
    find = lambda x: x if up[x] == x else find(up[x])
    for a, b in links:
        up[find(a)] = find(b)
    own = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                n = len(np.intersect1d(a, b))
                if 100 * n >= 80 * (len(a) + len(b) - n):
                    own[i] = own[j] = min(own[i], own[j])
    assert all((find(i) == find(j)) == (own[i] == own[j]) for i in range(len(sets)) for j in range(len(sets)))


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1064)] + [(5, 5)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    up = {}
    for a, b in edges:
        up.setdefault(a, a), up.setdefault(b, b)
    for _ in range(100):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: up[x] for x in touched}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# plumbing


def test_gram_hashes_depend_on_content_only():
    x = np.random.default_rng(0).integers(0, 1 << 60, 200).astype(np.uint64)
    for n in (1, 2, 3, 10, 50):
        h = runtime.gram_hashes(x, n)
        assert len(h) == 201 - n and all(h[i] == runtime.gram_hashes(x[i : i + n], n)[0] for i in range(0, 201 - n, 17))
    assert len(runtime.gram_hashes(x[:3], 5)) == 0


def test_slices_are_whole_rows():
    off = np.array([0, 5, 5, 100, 103, 104])
    assert list(runtime.slices(off, 10)) == [(0, 2), (2, 3), (3, 5)]
    data, at = runtime.text_views(pa.array(["é", None, "", "ab"])[1:])
    assert data.tobytes() == b"ab" and at.tolist() == [0, 0, 0, 2]


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB", 3)
    r = random.Random(9)
    edges = [(0, k) for k in range(1, 40)] + [(500, k) for k in range(501, 530)] + [(3, 503)] + [(r.randrange(600, 640), r.randrange(600, 640)) for _ in range(25)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    up = {n: n for e in edges for n in e}
    for _ in range(60):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {n: c for n, c in up.items() if any(n in e and e[0] != e[1] for e in edges)}


def template_sets(n, seed=11):
    """Texts that share a third of their shingles with each other: far from duplicates."""
    r = random.Random(seed)
    base = words(100, seed).split()
    return [(k, " ".join(base + [f"t{k}x{r.randrange(10**6)}" for _ in range(100)])) for k in range(n)]


def test_templates_are_no_candidates(spark, monkeypatch):
    """Texts of one template share bands here and there, but are never verified against each other; true links among them are found all the same."""
    table = template_sets(300)
    table += [(1000 + k, t.replace("t", "T", 1)) for k, t in table[:20]] + [(2000 + k, t + " more words") for k, t in table[:20]]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    sketch = runtime.cut(docs.mapInArrow(minhash._sketched(2, minhash.BANDS, minhash.ROWS), minhash.SKETCH))
    nodes = sketch.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"))
    edges = {(r.u, r.v) for r in minhash._candidates(sketch, nodes, 288, 80, 7).collect()}
    assert {tuple(sorted((a % 1000, b % 1000))) for a, b in edges} == {(k, k) for k in range(20)}
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, shingle=2, bucket_classes=7).collect()}
    assert got == {d: d % 1000 if d >= 1000 else d for d, _ in table}


def test_classes_far_from_the_least_one_of_a_bucket():
    """One task: what agrees with another class is tied to it, once for all that are tied already."""
    base = np.arange(288, dtype=np.uint8)
    other = (base + 7).astype(np.uint8)
    rows = [(1, base, False, True), (2, base, False, True), (5, other, True, False), (6, other, True, False), (8, np.r_[base[:250], other[250:]], True, False), (9, (base + 99).astype(np.uint8), True, False)]
    table = pa.table({"node": pa.array([x[0] for x in rows]), "slots": pa.array([x[1].tobytes() for x in rows]), "far": pa.array([x[2] for x in rows]), "tied": pa.array([x[3] for x in rows])})
    got = minhash._bucket_links(190)(table).to_pylist()
    assert {(x["u"], x["v"]) for x in got} == {(6, 5), (8, 1)}
    many = pa.table({"node": pa.array(range(2, 302)), "slots": pa.array([other.tobytes()] * 300), "far": pa.array([True] * 300), "tied": pa.array([False] * 300)})
    assert minhash._bucket_links(190)(many).num_rows == 299  # copies of each other don't make all pairs


# the shared folder


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: default), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_dir(session)


def test_a_local_session_gets_a_folder():
    from types import SimpleNamespace

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: default), sparkContext=SimpleNamespace(master="local[4]"))
    assert runtime.base_dir(session).startswith("file:///") and runtime.base_dir(session) == runtime.base_dir(session)


def test_rounds_leave_one_table(spark, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(runtime, "base_dir", lambda s: str(tmp_path))  # without a scheme: on the default file system
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "u long, v long")
    assert {r.component for r in components.components(edges).collect()} == {0}
    (folder,) = os.listdir(tmp_path)
    assert len(os.listdir(tmp_path / folder)) == 1
    assert runtime.shared_dir(spark).startswith(f"file://{tmp_path}/{folder}/")


def test_nothing_is_left_when_the_driver_ends(tmp_path):
    """A driver of its own writes tables and ends; its folder is gone, the shared one stays."""
    import os
    import subprocess
    import sys
    import time

    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "{tmp_path}/shared").getOrCreate()
import os
from veilspark.llm import runtime
assert runtime.cut(spark.range(3)).count() == 3 and len(os.listdir("{tmp_path}/shared")) >= 1
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.getcwd(), timeout=300)
    left = lambda: [x for x in os.listdir(tmp_path / "shared") if x.startswith("veilspark-")]
    for _ in range(60):  # the JVM ends a little later than Python
        if not left():
            break
        time.sleep(0.5)
    assert not left()


def test_invalid_bytes_in_a_string_column(spark):
    """A string column may hold bytes that are no UTF-8; they count as U+FFFD where a text is needed."""
    docs = spark.sql("SELECT 1 AS doc_id, CAST(X'61FF62' AS STRING) AS text, 'en' AS lang")
    assert docs.select("doc_id").dtypes == [("doc_id", "int")]
    assert token_counts.token_counts(docs, BYTES).head().n_tokens == len(_LIB7.encode("a�b", add_special_tokens=False).ids)
    assert minhash.near_duplicates(docs).head().doc_id == 1 and suffix_dedup.repeats(docs).head().n_bytes == 3
