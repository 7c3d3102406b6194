"""The registered queries opN_<name>: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, langid, media, minhash, sentencepiece_bpe, sharding, suffix_dedup, token_counts, token_files, warc
from .runtime import shared_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_register
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


ORACLE_SQL["op1_decontaminate"] = r"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM item WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
gram AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM low, lens WHERE len(w) >= n)),
found AS (SELECT doc_id, item_id, win.n AS n, i FROM gram JOIN win ON gram.g = win.g AND gram.n = win.n),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM found),
nh AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
ni AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id)
"""


@_register
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_register
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_register
def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_features(media.store(table(spark, sf_dir, "documents")))


@_register
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def _feistel_sql(x: str, source: str) -> str:
    """SQL: the rows of source with y, one pass of the Feistel network over x in a domain of 2 * h bits."""
    out = f"SELECT *, CAST({x} >> h AS UBIGINT) AS l0, CAST({x} & ((1 << h) - 1) AS UBIGINT) AS r0 FROM {source}"
    for k, key in enumerate(sharding.ROUND_KEYS):
        out = f"SELECT *, ((r{k} + {key}) & 4294967295) * 2654435761 & 4294967295 AS a{k} FROM ({out})"
        out = f"SELECT *, xor(a{k}, a{k} >> 15) * 2246822507 & 4294967295 AS b{k} FROM ({out})"
        out = f"SELECT *, r{k} AS l{k + 1}, xor(l{k}, xor(b{k}, b{k} >> 13) & CAST((1 << h) - 1 AS UBIGINT)) AS r{k + 1} FROM ({out})"
    return f"SELECT doc_id, size, crc, n, h, CAST((l4 << h) | r4 AS BIGINT) AS y FROM ({out})"


ORACLE_SQL["op5_sharding"] = f"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) AS c FROM range(256) r(i))),
byte AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) + 8 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM documents),
key AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295) AS crc FROM byte, tab),
row AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, crc, size) - 1 AS x, count(*) OVER () AS n FROM key),
num AS (SELECT *, greatest(1, (length(bin(greatest(n, 2) - 1)) + 1) // 2) AS h FROM row),
walk AS ({_feistel_sql("x", "num")} UNION ALL {_feistel_sql("y", "(SELECT * FROM walk WHERE y >= n)")})
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, CAST(y % 24 AS INTEGER) AS shard, y // 24 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM walk WHERE y < n
"""


@_register
def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


@_register
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    return token_files.read(token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1, folder), folder)


@_register
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    return warc.read(warc.write(table(spark, sf_dir, "pages"), folder), folder).drop("url")


ORACLE_SQL["op2_warc"] = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
h AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS head FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> head THEN head END AS refers_to
FROM h
"""


@_register
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


ORACLE_SQL["op10_minhash"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach(d, r) AS (SELECT x, y FROM edge UNION SELECT reach.d, edge.y FROM reach JOIN edge ON reach.r = edge.x),
least AS (SELECT d, min(r) AS r FROM reach GROUP BY d)
SELECT documents.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(documents.doc_id, coalesce(r, documents.doc_id)) AS component_id,
       documents.doc_id = least(documents.doc_id, coalesce(r, documents.doc_id)) AS kept
FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id LEFT JOIN least ON d = documents.doc_id
"""


@_register
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents")).drop("spans")


ORACLE_SQL["op6_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
s AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS k FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
lead AS (SELECT k, min(doc_id) AS m FROM s GROUP BY k HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i FROM s JOIN lead USING (k) WHERE doc_id > m),
gap AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS new FROM hit),
run AS (SELECT doc_id, i, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM gap),
span AS (SELECT doc_id, r, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, r),
piece AS (
  SELECT span.doc_id, a, substr(x, 2 * coalesce(lag(b) OVER w, 0) + 1, 2 * (a - coalesce(lag(b) OVER w, 0))) AS kept, b, x, n
  FROM span JOIN d ON d.doc_id = span.doc_id WINDOW w AS (PARTITION BY span.doc_id ORDER BY a)),
done AS (
  SELECT doc_id, string_agg(kept, '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept, count(*) AS n_spans FROM piece GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, CAST(d.n - strlen(coalesce(kept, x)) // 2 AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN done ON done.doc_id = d.doc_id
"""
