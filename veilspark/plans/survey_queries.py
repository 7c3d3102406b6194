"""Further registered queries: operators of mapping, evaluation, layout and triggers that no other query exercises by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels as N
from ..functions import text as X
from ..operators import candidates as CAND
from ..operators import evaluate as E
from ..operators import layout as L
from ..operators import mapping as M
from ..operators import mask as MASK
from ..streaming import triggers as T
from . import fixtures as X0
from .catalog import _SQL_BOXES, _SQL_JUDGED, _SQL_OFFSETS, _boxes, _judged, _outputs, _truth, _words, query
from .fixtures import SQL_ENTITIES, table

# --- mapping --------------------------------------------------------------------------------------------


@query("SELECT o_custkey AS entity_id, o_orderpriority AS data_type, CAST(min(o_orderkey) AS VARCHAR) AS value, 'P' || CAST(min(o_orderkey) AS VARCHAR) AS replacement FROM orders GROUP BY o_custkey, o_orderpriority")
def q_first_value(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderpriority").alias("data_type"), k.cast("string").alias("value"), F.concat(F.lit("P"), k.cast("string")).alias("replacement"), k.alias("at"))
    return M.first_value_wins(rows, "at")


@query("SELECT 'MEDICATION' AS data_type, p_name AS original_value, 'S' || CAST(p_partkey AS VARCHAR) AS replacement_value FROM part WHERE p_size % 2 = 0")
def q_strict_table(spark, d):
    p = table(spark, d, "part")
    rows = p.select(F.lit("MEDICATION").alias("data_type"), F.col("p_name").alias("value"), F.when(F.col("p_size") % 2 == 0, "KEEP").otherwise("PSEUDONYMIZE").alias("expected_action"), F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("strict_replacement"))
    return M.strict_table(rows)


@query("SELECT DISTINCT trim(p_type) AS key FROM part WHERE length(trim(p_type)) >= 3")
def q_evidence(spark, d):
    return M.evidence_values(table(spark, d, "part").select(F.concat(F.lit("  "), F.col("p_type"), F.lit(" ")).alias("Detection")))


@query("SELECT c_name AS original_value, 'G' || CAST(c_custkey AS VARCHAR) AS replacement_value FROM customer UNION ALL SELECT 'k' || CAST(c_custkey AS VARCHAR), c_mktsegment FROM customer")
def q_generated_rows(spark, d):
    k = F.col("c_custkey").cast("string")
    pairs = F.map_from_arrays(F.array(F.col("c_name"), F.concat(F.lit("k"), k)), F.array(F.concat(F.lit("G"), k), F.col("c_mktsegment")))
    return M.generated_rows(table(spark, d, "customer").select(F.to_json(pairs).alias("json")))


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 3 < 2 AND c_custkey % 2 = 0 THEN upper('Anna-' || CAST(c_custkey AS VARCHAR)) ELSE 'Anna-' || CAST(c_custkey AS VARCHAR) END AS replacement FROM customer""")
def q_cased(spark, d):
    k = F.col("c_custkey")
    dtype = F.when(k % 3 == 0, "FIRST_NAME").when(k % 3 == 1, "LAST_NAME").otherwise("EMAIL")
    value = F.when(k % 2 == 0, F.upper("c_name")).otherwise(F.col("c_name"))
    return table(spark, d, "customer").select(k.alias("k"), MASK.cased(dtype, value, F.concat(F.lit("Anna-"), k.cast("string"))).alias("replacement"))


@query(r"SELECT page_id, substr(sha256(html), 1, 16) AS print, length(regexp_replace(url, '[^\p{L}]', '', 'g')) <= 2 AS numeric FROM pages WHERE html IS NOT NULL AND url IS NOT NULL")
def q_fingerprint(spark, d):
    p = table(spark, d, "pages").where("html IS NOT NULL AND url IS NOT NULL")
    return p.select("page_id", X.fingerprint(F.col("html").cast("binary")).alias("print"), X.numeric_like(F.col("url")).alias("numeric"))


# --- documents and their evaluation ---------------------------------------------------------------------


@query("SELECT CAST(page_id // 10 AS VARCHAR) AS file, 'word/embeddings/' || CAST(page_id AS VARCHAR) AS name, 'dropped' AS status FROM pages WHERE page_id % 3 <> 0 AND page_id % 4 = 0")
def q_dropped_members(spark, d):
    k = F.col("page_id")
    p = table(spark, d, "pages").select("page_id", F.floor(k / 10).cast("string").alias("file"), F.concat(F.when(k % 3 == 0, "word/media/").otherwise("word/embeddings/"), k.cast("string")).alias("name"))
    return E.dropped_members(p, p.where("page_id % 4 <> 0"))


@query("""SELECT o_custkey AS file, o_orderstatus AS zone, count(*) AS n_before, count(*) FILTER (o_orderkey % 3 <> 0) AS n_after, count(*) FILTER (o_orderkey % 3 <> 0) > 0 AS survived FROM orders GROUP BY o_custkey, o_orderstatus""")
def q_zones_kept(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderstatus").alias("zone"), "o_orderkey")
    return E.zones_kept(o, o.where("o_orderkey % 3 <> 0"))


@query("""WITH m AS (SELECT DISTINCT user_id AS page, event_type AS value FROM events WHERE event_id % 3 = 0)
SELECT user_id AS page, event_type AS value, 'T' || CAST(min(event_id) % 5 AS VARCHAR) AS dtype, 'R' || CAST(min(event_id) AS VARCHAR) AS replacement FROM events WHERE (user_id, event_type) NOT IN (SELECT page, value FROM m) GROUP BY user_id, event_type""")
def q_safety_net(spark, d):
    k = F.col("event_id")
    e = table(spark, d, "events").select(F.col("user_id").alias("page"), F.col("event_type").alias("value"), k.alias("s"), F.concat(F.lit("T"), (k % 5).cast("string")).alias("dtype"), F.concat(F.lit("R"), k.cast("string")).alias("replacement"))
    return CAND.safety_net(e, e.where("s % 3 = 0"))


@query("""SELECT c_name AS path, CAST(c_custkey % 5 AS INTEGER) AS text_replacements, CAST((c_custkey % 4) * (c_custkey % 3) AS INTEGER) AS image_replacements, c_acctbal AS seconds FROM customer""")
def q_run_summary(spark, d):
    k = F.col("c_custkey").cast("int")
    images = F.array_repeat(F.struct(F.array_repeat(F.lit("x"), k % 3).alias("replacements")), k % 4)
    return E.run_summary(table(spark, d, "customer").select(F.col("c_name").alias("path"), F.array_repeat(F.lit("x"), k % 5).alias("log"), images.alias("images"), F.col("c_acctbal").alias("seconds")))


@query("""SELECT l_orderkey AS document, l_linenumber AS name, CASE WHEN l_linenumber % 2 = 1 THEN min(l_linestatus) ELSE 'not logged' END AS status FROM lineitem GROUP BY l_orderkey, l_linenumber""")
def q_embedded_log(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("name"), F.col("l_linestatus").alias("status")).groupBy("document", "name").agg(F.min("status").alias("status"))
    return E.embedded_against_log(rows.drop("status"), rows.where("name % 2 = 1"))


@query(f"WITH {_SQL_JUDGED} SELECT document, printf('%09d', k) || '-' || data_type AS gt_id, data_type, value FROM judged WHERE leaked")
def q_leak_list(spark, d):
    return E.leaks(_judged(spark, d)).select("document", "gt_id", "data_type", "value")


@query("""WITH a AS (SELECT unnest(string_split(text, ' ')) AS token FROM documents WHERE doc_id % 2 = 0), b AS (SELECT unnest(string_split(text, ' ')) AS token FROM documents WHERE doc_id % 2 = 1),
m AS (SELECT token FROM a EXCEPT ALL SELECT token FROM b), n AS (SELECT token FROM b EXCEPT ALL SELECT token FROM a),
bags AS (SELECT 'missing' AS side, token, count(*) AS n FROM m GROUP BY token UNION ALL SELECT 'added', token, count(*) FROM n GROUP BY token)
SELECT side, token, n FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY token) AS r FROM bags) WHERE r <= 20""")
def q_fidelity_examples(spark, d):
    tokens = lambda r: table(spark, d, "documents").where(F.pmod("doc_id", F.lit(2)) == r).select(F.explode(F.split("text", " ")).alias("token"))
    return E.fidelity_examples(E.token_bags(tokens(0), tokens(1)))


@query("""SELECT doc_id AS document, CASE WHEN doc_id % 3 <> 0 THEN round_even(CAST(length(coalesce(text, '')) + 1 AS DOUBLE) / greatest(1, length(coalesce(text, ''))), 3) END AS text_length_ratio,
 CASE WHEN doc_id % 3 <> 0 AND doc_id % 2 = 0 THEN doc_id % 4 = 0 END AS pages_equal, CAST(CASE WHEN doc_id % 3 <> 0 THEN doc_id % 7 END AS INTEGER) AS tables_in, CAST(doc_id % 5 AS INTEGER) AS tables_out FROM documents""")
def q_integrity(spark, d):
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    stats = lambda n: F.create_map(F.lit("tables"), (k % n).cast("int"))
    docs = table(spark, d, "documents")
    before = docs.where("doc_id % 3 <> 0").select(k.alias("document"), text.alias("text"), F.array(F.lit("1"), F.lit("2")).alias("pages"), stats(7).alias("stats"))
    pages = F.when(k % 4 == 0, F.array(F.lit("1"), F.lit("2"))).when(k % 2 == 0, F.array(F.lit("1")))
    after = docs.select(k.alias("document"), F.concat(text, F.lit("x")).alias("text"), pages.alias("pages"), stats(5).alias("stats"))
    out = E.integrity(before, after)
    return out.select("document", "text_length_ratio", "pages_equal", F.element_at("inbound", "tables").alias("tables_in"), F.element_at("output", "tables").alias("tables_out"))


@query(f"""WITH {SQL_ENTITIES}, e AS (SELECT CAST(c_nationkey AS VARCHAR) AS document, k, iban FROM entities), r AS (SELECT document, iban, row_number() OVER (PARTITION BY document ORDER BY iban) AS n FROM e WHERE k % 4 = 0)
SELECT document, string_agg(iban, ',' ORDER BY iban) AS examples FROM r WHERE n <= 10 GROUP BY document""")
def q_decoy_examples(spark, d):
    e = X0.entities(spark, d, dealt=True).select(F.col("c_nationkey").cast("string").alias("document"), "k", "iban")
    outputs = e.groupBy("document").agg(F.concat_ws(" | ", F.array_sort(F.collect_list(F.when(F.col("k") % 4 != 0, F.col("iban"))))).alias("text"))
    return E.decoy_examples(outputs, e.select("document", F.col("iban").alias("value"))).select("document", F.array_join("decoys_modified_examples", ",").alias("examples"))


@query(f"""WITH {_SQL_JUDGED}, t AS (SELECT document, value, section, printf('%09d', k) || '-' || data_type AS gt_id, present FROM judged WHERE must_hide UNION ALL SELECT document, value, 'OTHER', printf('%09d', k) || '-' || data_type, present FROM judged WHERE must_hide AND k % 4 = 0),
g AS (SELECT document, value, string_agg(DISTINCT section, ',' ORDER BY section) AS surfaces, count(DISTINCT section) AS n, min(gt_id) AS first, bool_or(present) AS present FROM t GROUP BY document, value)
SELECT document, value, surfaces FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY first, value) AS r FROM g WHERE n >= 2 AND present) WHERE r <= 6""")
def q_surface_examples(spark, d):
    truth = _truth(spark, d)
    more = truth.where("expected_action = 'PSEUDONYMIZE' AND CAST(split(gt_id, '-')[0] AS BIGINT) % 4 = 0").withColumn("section", F.lit("OTHER"))
    out = E.surface_examples(truth.unionByName(more), E.judged(truth, _outputs(spark, d)))
    return out.select("document", "value", F.array_join("surfaces", ",").alias("surfaces"))


# --- layout ---------------------------------------------------------------------------------------------


@query("""WITH w AS (SELECT l_orderkey AS file, l_linenumber % 2 + 1 AS scale, CASE WHEN l_linenumber % 3 = 0 THEN 6 ELSE 11 END AS psm, l_suppkey % 2 AS block, l_partkey % 3 AS word, *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2, l_linenumber % 3 = 0, l_suppkey % 2, l_partkey % 3 ORDER BY l_linenumber, l_partkey, l_quantity, l_suppkey) AS n FROM lineitem)
SELECT file, CAST(scale AS VARCHAR) || '/' || CAST(psm AS VARCHAR) AS pass, CAST(scale AS VARCHAR) || '/' || CAST(psm AS VARCHAR) || '/' || CAST(block AS VARCHAR) || '/1/1' AS line_id, word, CAST(l_partkey // scale AS INTEGER) AS x, CAST(l_suppkey // scale AS INTEGER) AS y,
 CAST(ceil(l_partkey % 97 / scale) AS INTEGER) AS w, CAST(ceil(l_suppkey % 23 / scale) AS INTEGER) AS h, CAST(l_quantity AS DOUBLE) AS conf, l_returnflag AS text FROM w WHERE n = 1""")
def q_ocr_union(spark, d):
    n, p, s = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    one = F.lit(1)
    words = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("file"), (n % 2 + 1).alias("scale"), F.when(n % 3 == 0, 6).otherwise(11).alias("psm"), (s % 2).alias("block"), one.alias("par"), one.alias("line"), (p % 3).alias("word"), F.struct(n, p, "l_quantity", s).alias("seq"),
        p.alias("left"), s.alias("top"), (p % 97).alias("width"), (s % 23).alias("height"), F.col("l_quantity").cast("double").alias("conf"), F.concat(F.lit(" "), "l_returnflag", F.lit(" ")).alias("text"),
    )
    return L.ocr_union(words)


@query(f"""{_SQL_BOXES.replace("x AS x0", "conf, length(text) AS n, x AS x0")}, p AS (SELECT a.file, a.box_id, b.box_id AS word_id, b.x0, b.x1, a.x0 AS bx0, a.x1 AS bx1, greatest(12, 1.2 * (a.y1 - a.y0)) AS reach FROM b a JOIN b ON a.file = b.file AND a.box_id % 13 = 0 AND b.conf >= 75 AND b.n >= 2
  AND (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / greatest(1, least(a.y1 - a.y0, b.y1 - b.y0)) >= 0.6),
u AS (SELECT * FROM p UNION ALL SELECT DISTINCT file, box_id, NULL, bx0, bx1, bx0, bx1, reach FROM p),
f AS (SELECT *, CASE WHEN x0 - max(x1) OVER (PARTITION BY file, box_id ORDER BY x0, x1, word_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > reach THEN 1 ELSE 0 END AS far FROM u),
g AS (SELECT *, sum(far) OVER (PARTITION BY file, box_id ORDER BY x0, x1, word_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS part FROM f),
h AS (SELECT *, max(CASE WHEN word_id IS NULL THEN part END) OVER (PARTITION BY file, box_id) AS home FROM g)
SELECT file, box_id, word_id FROM h WHERE part = home AND word_id IS NOT NULL AND NOT (x1 > bx0 + 2 AND x0 < bx1 - 2)""")
def q_run_growth(spark, d):
    words = _words(spark, d).select("file", "conf", F.length("text").alias("n"), (F.col("line") * 10 + F.col("x") / 50).cast("long").alias("word_id"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))
    boxes = words.where("word_id % 13 = 0").select("file", F.col("word_id").alias("box_id"), "x0", "y0", "x1", "y1")
    return L.run_growth(boxes, words.where("conf >= 75 AND n >= 2").drop("conf", "n"))


@query(f"""{_SQL_BOXES}, i AS (SELECT file, box_id // 10 AS line, box_id AS item_id, x0, y0, x1, y1, lag(x1) OVER (PARTITION BY file, box_id // 10 ORDER BY x0, box_id) AS l FROM b WHERE box_id % 5 <> 2),
n AS (SELECT *, CASE WHEN l IS NOT NULL AND (x0 - l < 0 OR x0 - l > greatest(10, 0.8 * (y1 - y0)) OR EXISTS (SELECT 1 FROM b v WHERE v.file = i.file AND v.box_id % 5 = 2 AND v.box_id // 10 BETWEEN i.line - 1 AND i.line + 1 AND v.x0 >= i.l - 2 AND v.x1 <= i.x0 + 2
  AND (least(i.y1, v.y1) - greatest(i.y0, v.y0)) / greatest(1, least(i.y1 - i.y0, v.y1 - v.y0)) >= 0.6)) THEN 1 ELSE 0 END AS new FROM i)
SELECT file, line, item_id, CAST(sum(new) OVER (PARTITION BY file, line ORDER BY x0, item_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chain FROM n""")
def q_linked_chains(spark, d):
    b = _boxes(spark, d)
    items = b.where("box_id % 5 <> 2").select("file", F.floor(F.col("box_id") / 10).alias("line"), F.col("box_id").alias("item_id"), "x0", "y0", "x1", "y1")
    return L.linked_chains(items, b.where("box_id % 5 = 2").drop("box_id")).select("file", "line", "item_id", "chain")


@query(f"""{_SQL_BOXES}, i AS (SELECT file, box_id // 10 AS chain, box_id AS item_id, x0, x1, x1 - x0 + box_id % 7 * 5 AS width, 480 AS free FROM b),
g AS (SELECT *, coalesce(greatest(0, x0 - lag(x1) OVER w), 0) AS gap, coalesce(lag(width) OVER w, 0) AS before FROM i WINDOW w AS (PARTITION BY file, chain ORDER BY x0, item_id)),
t AS (SELECT *, sum(gap + before) OVER (PARTITION BY file, chain ORDER BY x0, item_id ROWS UNBOUNDED PRECEDING) AS taken FROM g),
p AS (SELECT *, taken + max(x0 - taken) OVER (PARTITION BY file, chain ORDER BY x0, item_id ROWS UNBOUNDED PRECEDING) AS px FROM t),
e AS (SELECT *, min(x0) OVER c AS first, max(px + width) OVER c AS stop, max(free) OVER c AS room FROM p WINDOW c AS (PARTITION BY file, chain)),
s AS (SELECT *, CASE WHEN stop - first > room - first THEN CAST(room - first AS DOUBLE) / (stop - first) ELSE 1.0 END AS scale FROM e)
SELECT file, item_id, round(first + (px - first) * scale, 6) AS x, round(scale, 9) AS scale FROM s""")
def q_chain_layout(spark, d):
    b = _boxes(spark, d).withColumn("chain", F.floor(F.col("box_id") / 10))
    items = b.select("file", "chain", F.col("box_id").alias("item_id"), "x0", "x1", (F.col("x1") - F.col("x0") + F.col("box_id") % 7 * 5).alias("width"), F.lit(480).alias("free"))
    return L.chain_layout(items).select("file", "item_id", F.round("x", 6).alias("x"), F.round("scale", 9).alias("scale"))


@query(f"""{_SQL_BOXES}, s AS (SELECT file AS page, box_id, x0 - 20 AS x0, y0 - 10 AS y0, x1 + 60 AS x1, y1 + 10 AS y1 FROM b WHERE box_id % 31 = 0), o AS (SELECT file AS page, CASE WHEN box_id % 2 = 0 THEN 'curve' ELSE 'image' END AS kind, x0, y0, x1, y1 FROM b WHERE box_id % 4 < 2),
n AS (SELECT s.page, s.box_id, kind, count(*) AS n FROM s JOIN o ON s.page = o.page AND least(s.x1, o.x1) > greatest(s.x0, o.x0) AND least(s.y1, o.y1) > greatest(s.y0, o.y0) GROUP BY ALL)
SELECT s.page, s.box_id, kind, coalesce(n, 0) AS n FROM s LEFT JOIN n ON s.page = n.page AND s.box_id = n.box_id""")
def q_residuals(spark, d):
    b = _boxes(spark, d).withColumnRenamed("file", "page")
    areas = b.where("box_id % 31 = 0").select("page", "box_id", (F.col("x0") - 20).alias("x0"), (F.col("y0") - 10).alias("y0"), (F.col("x1") + 60).alias("x1"), (F.col("y1") + 10).alias("y1"))
    return L.residuals(areas, b.where("box_id % 4 < 2").withColumn("kind", F.when(F.col("box_id") % 2 == 0, "curve").otherwise("image")))


@query("""SELECT file, page, x0, y0, value, line FROM (SELECT l_orderkey AS file, 1 AS page, l_suppkey + 0.25 AS x0, CAST(l_linenumber % 2 AS DOUBLE) AS y0, l_returnflag AS value, l_linenumber AS line,
 row_number() OVER (PARTITION BY l_orderkey, l_suppkey, l_linenumber % 2, l_returnflag ORDER BY 1 + l_linenumber % 2, l_linenumber) AS r FROM lineitem) WHERE r = 1""")
def q_first_match(spark, d):
    n = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.lit(1).alias("page"), (F.col("l_suppkey") + 0.25).alias("x0"), (n % 2).cast("double").alias("y0"), F.col("l_returnflag").alias("value"), (1 + n % 2).alias("n"), n.alias("line"))
    return L.first_match(rows).select("file", "page", "x0", "y0", "value", "line")


@query(f"""{_SQL_OFFSETS} SELECT file, line, s, CAST(s + length(text) AS INTEGER) AS e FROM off WHERE length(text) >= 5 AND NOT (s < 15 AND s + length(text) > 6)""")
def q_uncovered(spark, d):
    words = L.word_offsets(_words(spark, d))
    covered = words.select("file", "line").distinct().select("file", "line", F.lit(6).alias("s"), F.lit(15).alias("e"))
    return L.uncovered(words.where(F.length("text") >= 5).select("file", "line", "s", "e"), covered)


@query("""WITH c AS (SELECT DISTINCT p_brand AS image, p_size AS cluster, p_size * 2 AS median, p_size % 3 = 0 AS numeric FROM part)
SELECT a.image, a.cluster, a.median, a.numeric, coalesce(max(b.median), a.median) AS size FROM c a LEFT JOIN c b ON a.image = b.image AND a.numeric AND NOT b.numeric AND b.median < a.median AND a.median <= b.median * 1.35 GROUP BY a.image, a.cluster, a.median, a.numeric""")
def q_snapped_numeric(spark, d):
    s = F.col("p_size")
    return L.snapped_numeric(table(spark, d, "part").select(F.col("p_brand").alias("image"), s.alias("cluster"), (s * 2).alias("median"), (s % 3 == 0).alias("numeric")).distinct())


@query(f"""{_SQL_BOXES.replace("x AS x0", "conf, text, x AS x0")}, w AS (SELECT *, 1 AS pass FROM b WHERE conf >= 30 AND length(text) >= 2 UNION ALL SELECT file, box_id, conf, t, x0 + 1, y0, x1 + 1, y1, 2 FROM (SELECT *, CASE WHEN box_id % 3 = 0 THEN text || 'qq' WHEN box_id % 3 = 1 THEN text || 'q' ELSE text END AS t FROM b) WHERE conf >= 30 AND length(t) >= 2)
SELECT file, pass, box_id AS word_id FROM w a WHERE conf >= 75 OR EXISTS (SELECT 1 FROM w v WHERE v.file = a.file AND v.pass <> a.pass AND v.box_id // 10 BETWEEN a.box_id // 10 - 1 AND a.box_id // 10 + 1
 AND greatest(0, least(a.x1, v.x1) - greatest(a.x0, v.x0)) * greatest(0, least(a.y1, v.y1) - greatest(a.y0, v.y0)) > 0.5 * (a.x1 - a.x0) * (a.y1 - a.y0)
 AND levenshtein(replace(translate(lower(a.text), 'ς', 'σ'), 'ß', 'ss'), replace(translate(lower(v.text), 'ς', 'σ'), 'ß', 'ss')) <= 1)""")
def q_trusted_words(spark, d):
    k = F.col("word_id")
    one = _words(spark, d).select("file", (F.col("line") * 10 + F.col("x") / 50).cast("long").alias("word_id"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"), "conf", "text")
    # both passes come from each word where it is: a union would deal all words anew
    two = one.withColumn("pass", F.explode(F.array(F.lit(1), F.lit(2))))
    first = F.col("pass") == 1
    shift = {c: F.when(first, F.col(c)).otherwise(F.col(c) + 1) for c in ("x0", "x1")}
    text = F.when(first | (k % 3 == 2), F.col("text")).when(k % 3 == 0, F.concat("text", F.lit("qq"))).otherwise(F.concat("text", F.lit("q")))
    return L.trusted_words(two.withColumns(shift | {"text": text})).select("file", "pass", "word_id")


@query(rf"""WITH {SQL_ENTITIES} SELECT k, array_to_string(regexp_extract_all('Konto ' || iban || ' bis, XX00 1234 5678 9012', '{L.LOOSE_IBAN.replace("(?:[ ]", "(?:[ ]")}')[1:1], '|') AS ibans, ahv AS ahvs FROM entities""")
def q_loose_shapes(spark, d):
    e = X0.entities(spark, d)
    line = F.concat(F.lit("Konto "), "iban", F.lit(" bis, XX00 1234 5678 9012"))
    return e.select("k", F.array_join(L.loose_ibans(line), "|").alias("ibans"), F.array_join(L.loose_ahv(F.concat(F.lit("Nr "), F.replace("ahv", F.lit("."), F.lit(". ")), F.lit(" x"))), "|").alias("ahvs"))


@query("SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN '| 7| 7 CHF' WHEN 1 THEN '|12' WHEN 2 THEN '' WHEN 3 THEN '| ABCD' ELSE '| 1| 1 2345' END AS tails FROM customer")
def q_iban_tails(spark, d):
    k = F.col("c_custkey")
    rest = F.when(k % 5 == 0, " 7 CHF 500").when(k % 5 == 1, "12 AB").when(k % 5 == 2, ", end").when(k % 5 == 3, " ABCD").otherwise(" 1 23456")
    return table(spark, d, "customer").select(k.alias("k"), F.array_join(L.with_tails(rest), "|").alias("tails"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'cobo' WHEN 1 THEN 'tiit' WHEN 2 THEN 'hebi' ELSE 'helv' END AS code, CAST(2 * p_size + 1 AS DOUBLE) AS x, CAST(p_size - 3 AS DOUBLE) AS y FROM part""")
def q_fonts_and_points(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size").cast("double")
    name = F.when(k % 4 == 0, "AB+Courier-Bold").when(k % 4 == 1, "Times-Italic").when(k % 4 == 2, "Sans Serif Black").otherwise(F.lit(None))
    x, y = N.affine_point((2.0, 0.0, 1.0, 0.0, 1.0, -3.0), s, s)
    return table(spark, d, "part").select("p_partkey", N.pdf_font(name, F.when(k % 4 == 2, 2)).alias("code"), x.alias("x"), y.alias("y"))


# --- triggers -------------------------------------------------------------------------------------------


def _measure(path: str, content: bytes) -> str:
    if int(path) % 7 == 0:
        raise ValueError(path)
    return str(len(content))


@query("SELECT CAST(page_id AS VARCHAR) AS path, page_id % 7 <> 0 AS ok, CASE WHEN page_id % 7 = 0 THEN 'ValueError: ' || CAST(page_id AS VARCHAR) END AS error, CASE WHEN page_id % 7 <> 0 THEN CAST(strlen(coalesce(html, '')) AS VARCHAR) END AS summary FROM pages")
def q_worked(spark, d):
    files = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.coalesce("html", F.lit("")).cast("binary").alias("content"))
    return T.worked(files, _measure).select("path", "ok", "error", "summary")
