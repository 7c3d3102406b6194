"""Registered queries of the pseudonymization engine, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import keyed as K
from ..functions import text as X
from ..functions import messages as MSG
from ..operators import candidates as CAND
from ..operators import detect as D
from ..operators import evaluate as E
from ..operators import layout as L
from ..operators import mapping as M
from ..operators import mask as MASK
from ..streaming import triggers as T
from . import fixtures as X0
from . import synth as SYNTH
from .fixtures import DEMO_KEY, SQL_ENTITIES, SQL_MAPPING, SQL_NOTES, sql_groups, sql_hmac_digits, sql_luhn, sql_mod97, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


CARD = dict(X.PATTERNS)["CREDIT_CARD"]
EMAIL = dict(X.PATTERNS)["EMAIL"]
SIMPLE = tuple(d for d in D.DETECTORS if d.name in ("EMAIL", "CREDIT_CARD"))

# --- text and checksums ---------------------------------------------------------------


@query("SELECT doc_id, length(x) AS n, md5(x) AS digest FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\s\\x0B\\x85\\p{Z}]+', '', 'g') AS x FROM documents)")
def q_norm(spark, d):
    x = X.norm(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(x).cast("long").alias("n"), F.md5(x.cast("binary")).alias("digest"))


@query("SELECT doc_id, md5(replace(translate(lower(regexp_replace(coalesce(text, ''), '[\\s\\x0B\\x85\\p{Z}]+', ' ', 'g')), 'ς', 'σ'), 'ß', 'ss')) AS digest FROM documents")
def q_collapse(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.collapse(F.col("text")).cast("binary")).alias("digest"))


@query(rf"SELECT doc_id, v AS value, {sql_luhn('v')} AS valid FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{CARD}')) AS v FROM documents)")
def q_luhn_cards(spark, d):
    found = F.explode(F.regexp_extract_all("text", F.lit(X.unicode_pattern(f"({CARD})")), 1)).alias("value")
    return table(spark, d, "documents").where(F.col("text").rlike(X.unicode_pattern(CARD))).select("doc_id", found).withColumn("valid", X.luhn_is_valid(F.col("value")))


@query(f"WITH {SQL_ENTITIES} SELECT k, iban, {sql_mod97('substr(x, 5) || substr(x, 1, 4)')} = 1 AS valid, {sql_groups('x', 4)} AS formatted FROM (SELECT *, replace(iban, ' ', '') AS x FROM entities)")
def q_iban_valid(spark, d):
    e = X0.entities(spark, d)
    return e.select("k", "iban", X.iban_is_valid(F.col("iban")).alias("valid"), X.iban_format(F.col("iban")).alias("formatted"))


@query(f"WITH {SQL_ENTITIES} SELECT k, ahv, k % 3 <> 0 AS valid FROM entities")
def q_ahv_valid(spark, d):
    return X0.entities(spark, d).select("k", "ahv", X.ahv_is_valid(F.col("ahv")).alias("valid"))


_TYPES = ["iban", "ahv", "card", "insurance", "patient", "phone", "email"]


@query(f"""WITH {SQL_ENTITIES} SELECT k, field, CASE field WHEN 'iban' THEN 'IBAN' WHEN 'ahv' THEN 'AHV_NUMBER' WHEN 'card' THEN 'CREDIT_CARD' WHEN 'insurance' THEN 'INSURANCE_CARD_NUMBER' WHEN 'patient' THEN 'PATIENT_ID'
 WHEN 'email' THEN 'EMAIL' ELSE 'PHONE' END AS guessed FROM (UNPIVOT (SELECT k, iban, ahv, card, insurance, patient, phone, email FROM entities) ON iban, ahv, card, insurance, patient, phone, email INTO NAME field VALUE v)""")
def q_guess_type(spark, d):
    e = X0.entities(spark, d).unpivot(["k"], _TYPES, "field", "v")
    return e.select("k", "field", X.guess_type(F.col("v")).alias("guessed"))


# --- keyed pseudonyms -------------------------------------------------------------------


@query(f"SELECT c_custkey AS k, {sql_hmac_digits('c_name', 6)} AS six, {sql_hmac_digits('c_name', 17)} AS seventeen FROM customer")
def q_hmac_digits(spark, d):
    n = F.col("c_name")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), K.hmac_digits(n, 6, DEMO_KEY).alias("six"), K.hmac_digits(n, 17, DEMO_KEY).alias("seventeen"))


_SQL_CARDS = "[" + ", ".join(f"'{c}'" for c in K.PSEUDO_CARDS) + "]"


@query(f"""WITH {SQL_ENTITIES}, g AS (SELECT *, '8' || substr({sql_hmac_digits('iban', 17)}, 2) AS acct, '756' || {sql_hmac_digits('ahv', 9)} AS t12 FROM entities)
SELECT k, {sql_groups("'CH' || lpad(CAST(98 - CAST(acct || '121700' AS HUGEINT) % 97 AS VARCHAR), 2, '0') || acct", 4)} AS iban_rep,
 substr(t13, 1, 3) || '.' || substr(t13, 4, 4) || '.' || substr(t13, 8, 4) || '.' || substr(t13, 12, 2) AS ahv_rep,
 {_SQL_CARDS}[CAST({sql_hmac_digits('card', 4)} AS INTEGER) % {len(K.PSEUDO_CARDS)} + 1] AS card_rep,
 {sql_groups("'80756' || " + sql_hmac_digits('insurance', 15), 5)} AS insurance_rep,
 'PAT-2026-' || {sql_hmac_digits('patient', 5)} AS patient_rep, 'contact.' || {sql_hmac_digits('email', 6)} || '@example.org' AS email_rep,
 '+41 79 000 ' || {sql_hmac_digits('phone', 2)} || ' ' || {sql_hmac_digits("(phone || 'b')", 2)} AS phone_rep
FROM (SELECT *, t12 || CAST({X0.sql_ean13('t12')} AS VARCHAR) AS t13 FROM g)""")
def q_generate(spark, d):
    e = X0.entities(spark, d)
    kinds = {"iban": "IBAN", "ahv": "AHV_NUMBER", "card": "CREDIT_CARD", "insurance": "INSURANCE_CARD_NUMBER", "patient": "PATIENT_ID", "email": "EMAIL", "phone": "PHONE"}
    return e.select("k", *[K.generate(t, F.col(c), DEMO_KEY).alias(f"{c}_rep") for c, t in kinds.items()])


# --- detection and masking -----------------------------------------------------------------


def _sql_spans(pattern: str, flags: str = "") -> str:
    return rf"""SELECT doc_id, CAST(list_sum(list_transform(p[1 : CAST(i AS INTEGER)], lambda x: length(x))) AS BIGINT) AS s, p[CAST(i + 1 AS INTEGER)] AS value
 FROM (SELECT doc_id, p, unnest(range(1, len(p), 2)) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '({pattern})', chr(1) || '\1' || chr(1), 'g{flags}'), chr(1)) AS p FROM documents))"""


def _spans_of(spark, d, pattern):
    docs = table(spark, d, "documents").select("doc_id", F.explode(D.matches(F.col("text"), pattern)).alias("m"))
    return docs.select("doc_id", F.col("m.s").cast("long").alias("s"), F.col("m.value").alias("value"))


@query(_sql_spans(EMAIL.replace("(?i)", ""), "i"))
def q_span_email(spark, d):
    return _spans_of(spark, d, EMAIL)


@query(_sql_spans(CARD))
def q_span_card(spark, d):
    return _spans_of(spark, d, CARD)


_SQL_FOUND = rf"""card AS (
  SELECT doc_id, 'CREDIT_CARD' AS dtype, value FROM ({_sql_spans(CARD)}) JOIN documents USING (doc_id)
  WHERE {sql_luhn('value')} AND NOT regexp_matches(substr(text, CAST(greatest(s - 7, 1) AS INTEGER), CAST(least(s, 8) AS INTEGER)), '[A-Z]{{2}}\d{{2}}\s?$|\d\s?$')),
found AS (SELECT * FROM card UNION ALL SELECT doc_id, 'EMAIL', value FROM ({_sql_spans(EMAIL.replace('(?i)', ''), 'i')}))"""


def _sql_rewritten(source: str, pattern: str, flags: str, test: str, replacement: str) -> str:
    """(doc_id, text, changed): matches v of a pattern that pass a test (b: the 8 characters before) replaced, piece by piece."""
    return rf"""(SELECT doc_id, string_agg(CASE WHEN hit THEN {replacement} ELSE v END, '' ORDER BY j) AS text, bool_or(hit) AS changed FROM (
  SELECT *, j % 2 = 0 AND {test} AS hit FROM (
   SELECT doc_id, j, p[j] AS v, right(coalesce(p[j - 2], '') || coalesce(p[j - 1], ''), 8) AS b FROM (
    SELECT doc_id, p, CAST(unnest(range(1, len(p) + 1)) AS INTEGER) AS j FROM (SELECT doc_id, string_split(regexp_replace(text, '({pattern})', chr(1) || '\1' || chr(1), 'g{flags}'), chr(1)) AS p FROM {source})))) GROUP BY doc_id)"""


_SQL_CARD_REP = f"{_SQL_CARDS}[CAST({sql_hmac_digits('v', 4)} AS INTEGER) % {len(K.PSEUDO_CARDS)} + 1]"
_SQL_CARD_TEST = rf"CASE WHEN j % 2 = 0 THEN {sql_luhn('v')} ELSE false END AND NOT regexp_matches(b, '[A-Z]{{2}}\d{{2}}\s?$|\d\s?$')"
_SQL_MASKED = _sql_rewritten("documents", CARD, "", _SQL_CARD_TEST, _SQL_CARD_REP)
_SQL_MAIL_REP = f"'contact.' || {sql_hmac_digits('v', 6)} || '@example.org'"


@query(f"""WITH c AS {_SQL_MASKED}, m AS {_sql_rewritten("c", EMAIL.replace("(?i)", ""), "i", "true", _SQL_MAIL_REP)}
SELECT doc_id, md5(m.text) AS digest, c.changed OR m.changed AS changed FROM c JOIN m USING (doc_id)""")
def q_mask_documents(spark, d):
    masked = MASK.mask_patterns(table(spark, d, "documents").select("doc_id", "text"), DEMO_KEY, SIMPLE)
    return masked.select("doc_id", F.md5(F.col("masked").cast("binary")).alias("digest"), (F.size("spans") > 0).alias("changed"))


@query(f"WITH {_SQL_FOUND} SELECT lang, dtype, count(*) AS n FROM found JOIN documents USING (doc_id) GROUP BY lang, dtype")
def q_pii_by_lang(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").rlike(X.unicode_pattern(CARD)) | F.col("text").rlike(X.unicode_pattern(EMAIL)))
    spans = docs.select("lang", F.explode(D.resolve(D.pattern_spans(F.col("text"), SIMPLE))).alias("s"))
    return spans.groupBy("lang", F.col("s.dtype").alias("dtype")).agg(F.count("*").alias("n"))


@query(f"""WITH {SQL_NOTES}, v AS (SELECT *, {sql_luhn('card')} AS luhn FROM notes)
SELECT row_id, CAST(k % 3 <> 0 AS INTEGER) AS ibans, CAST(k % 3 <> 0 AS INTEGER) AS ahvs, CAST(luhn AS INTEGER) AS cards, 1 AS patients, 1 AS emails, 1 AS insured FROM v""")
def q_overlap_resolve(spark, d):
    spans = D.resolve(D.pattern_spans(F.col("text")))
    n = X0.notes(spark, d).select("row_id", spans.alias("spans"))
    count = lambda t: F.size(F.filter("spans", lambda s: s["dtype"] == t))
    return n.select("row_id", *[count(t).alias(a) for t, a in (("IBAN", "ibans"), ("AHV_NUMBER", "ahvs"), ("CREDIT_CARD", "cards"), ("PATIENT_ID", "patients"), ("EMAIL", "emails"), ("INSURANCE_CARD_NUMBER", "insured"))])


# --- tables and dictionary ---------------------------------------------------------------------


@query(f"WITH {SQL_MAPPING} SELECT data_type, original_value, arg_max(replacement_value, line) AS replacement_value FROM mapping GROUP BY data_type, original_value")
def q_mapping_lastwins(spark, d):
    return M.exact_table(X0.mapping(spark, d), "line")


def _seed(spark, d):
    s = table(spark, d, "supplier").select(F.lit("LAST_NAME").alias("data_type"), F.col("s_name").alias("original_value"), F.concat(F.lit("Firm-"), F.col("s_suppkey").cast("string")).alias("replacement_value"))
    c = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.lit("LAST_NAME").alias("data_type"), F.col("c_name").alias("original_value"), F.lit("never").alias("replacement_value"))
    return s.unionByName(c)


@query(f"""WITH {SQL_MAPPING}, t AS (SELECT data_type, original_value, arg_max(replacement_value, line) AS replacement_value FROM mapping GROUP BY ALL HAVING true)
SELECT * FROM (SELECT data_type, original_value, arg_max(replacement_value, line) AS replacement_value FROM mapping GROUP BY data_type, original_value) UNION ALL SELECT 'LAST_NAME', s_name, 'Firm-' || CAST(s_suppkey AS VARCHAR) FROM supplier""".replace(", t AS (SELECT data_type, original_value, arg_max(replacement_value, line) AS replacement_value FROM mapping GROUP BY ALL HAVING true)", ""))
def q_seed_merge(spark, d):
    return M.with_seed(M.exact_table(X0.mapping(spark, d), "line"), _seed(spark, d))


@query(f"""WITH {SQL_MAPPING}, t AS (SELECT data_type, original_value, arg_max(replacement_value, line) AS replacement_value FROM mapping GROUP BY data_type, original_value)
SELECT data_type, original_value, replacement_value, 'table' AS origin FROM t
UNION ALL SELECT 'GENERATED', upper(c_name), 'g' || CAST(c_custkey AS VARCHAR), 'generated' FROM customer WHERE upper(c_name) NOT IN (SELECT original_value FROM t)""")
def q_mapping_union(spark, d):
    generated = table(spark, d, "customer").select(F.upper("c_name").alias("original_value"), F.concat(F.lit("g"), F.col("c_custkey").cast("string")).alias("replacement_value"))
    return M.with_generated(M.exact_table(X0.mapping(spark, d), "line"), generated)


_SQL_DICT = rf"""WITH {SQL_NOTES}, {SQL_MAPPING}, t AS (SELECT original_value, arg_max(replacement_value, line) AS r FROM mapping GROUP BY original_value)
SELECT row_id, md5(replace(replace(text, c_name, t.r), email, 'contact.' || {sql_hmac_digits('email', 6)} || '@example.org')) AS digest FROM (SELECT row_id, 'Record of ' || c_name || ', again ' || c_name || '; x@' || c_name || '; write ' || email || '.' AS text0, c_name, email FROM notes) n
JOIN t ON t.original_value = n.c_name, LATERAL (SELECT replace(text0, '; x@' || c_name, '; x@') AS text)"""


def _dict_texts(spark, d):
    e = X0.entities(spark, d)
    return e.select(F.col("k").alias("row_id"), F.concat(F.lit("Record of "), "c_name", F.lit(", again "), "c_name", F.lit("; x@; write "), "email", F.lit(".")).alias("text"))


@query(_SQL_DICT)
def q_dict_mask(spark, d):
    masked = MASK.mask(_dict_texts(spark, d), X0.mapping(spark, d), DEMO_KEY)
    return masked.select("row_id", F.md5(F.col("masked").cast("binary")).alias("digest"))


@query("""SELECT n_nationkey AS entity_id, 'nation' AS role, 'NAME' AS field, n_name AS original, upper(n_name) || '-X' AS replacement FROM nation
UNION ALL SELECT n_nationkey, 'nation', 'REGION', CAST(n_regionkey AS VARCHAR), CAST(n_regionkey + 100 AS VARCHAR) FROM nation""")
def q_unpivot_mapping(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("entity_id"), F.lit("nation").alias("role"), "n_name", "n_regionkey", F.concat(F.upper("n_name"), F.lit("-X")).alias("ps_name"), (F.col("n_regionkey") + 100).alias("ps_region"))
    return M.long_mapping(n, {"NAME": ("n_name", "ps_name"), "REGION": ("n_regionkey", "ps_region")})


# --- generators -------------------------------------------------------------------------------------

_SQL_CITIES = "[" + ", ".join(f"'{n} {c}'" for n, c in K.CITIES) + "]"


@query(f"SELECT c_custkey AS k, {_SQL_CITIES}[CAST(c_custkey % 26 + 1 AS INTEGER)] AS city, {_SQL_CITIES}[CAST((c_custkey + {K.CITY_SHIFT}) % 26 + 1 AS INTEGER)] AS replacement FROM customer")
def q_city_rotation(spark, d):
    pool = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(c).alias("c")) for n, c in K.CITIES])
    at = F.get(pool, (F.col("c_custkey") % 26).cast("int"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.concat(at["n"], F.lit(" "), at["c"]).alias("city"), K.rotated_city(at["n"], at["c"]).alias("replacement"))


_STREETS, _OTHER = ("Rue des Trois-Sapins", "Bergstrasse", "Am Mühlebach"), ("Chemin de la Combe-Fleurie", "Hügelweg", "Im Sonnenfeld")


@query("SELECT c_custkey AS k, ['Chemin de la Combe-Fleurie', 'Hügelweg', 'Im Sonnenfeld'][CAST(c_custkey % 3 + 1 AS INTEGER)] || ' ' || CAST((c_custkey % 200 * 7) % 120 + 1 AS VARCHAR) AS street FROM customer")
def q_street(spark, d):
    s = F.concat(F.get(F.array(*[F.lit(x) for x in _STREETS]), (F.col("c_custkey") % 3).cast("int")), F.lit(" "), (F.col("c_custkey") % 200).cast("string"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), K.replaced_street(s, _STREETS, _OTHER).alias("street"))


_SQL_MD5 = "list_reduce(list_prepend(0, list_transform(range(0, 8), lambda i: CAST('0x' || substr(h, CAST(4 * i + 1 AS INTEGER), 4) AS INTEGER))), lambda a, v: (a * 65536 + v) % 280)"


@query(f"""SELECT k, born, CAST(born + CAST(CASE WHEN CAST('0x' || substr(h, 30, 1) AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END * (40 + {_SQL_MD5}) AS INTEGER) AS DATE) AS moved
FROM (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS born, md5(strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d')) AS h FROM orders)""")
def q_dob_shift(spark, d):
    born = F.to_date("o_orderdate")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), born.alias("born"), K.shifted_birth_date(born).alias("moved"))


_SQL_MONTHS = {k: "[" + ", ".join(f"'{m}'" for m in v) + "]" for k, v in X.MONTHS.items()}


@query(f"""SELECT k, strftime(b, '%d.%m.%Y') AS dotted, strftime(b, '%Y-%m-%d') AS iso, CAST(day(b) AS VARCHAR) || ' ' || {_SQL_MONTHS['fr']}[month(b)] || ' ' || CAST(year(b) AS VARCHAR) AS long_fr,
 CAST(day(b) AS VARCHAR) || '. ' || {_SQL_MONTHS['de']}[month(b)] || ' ' || CAST(year(b) AS VARCHAR) AS long_de FROM (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS b FROM orders)""")
def q_date_formats(spark, d):
    born = F.to_date("o_orderdate")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), *[X.date_text(born, s).alias(s) for s in ("dotted", "iso", "long_fr", "long_de")])


@query(f"SELECT doc_id, md5(translate(text, '{X.ACCENTED}', '{X.PLAIN}')) AS digest FROM documents")
def q_strip_accents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.strip_accents(F.col("text")).cast("binary")).alias("digest"))


# --- evaluation -----------------------------------------------------------------------------------------


def _truth(spark, d):
    e = X0.entities(spark, d, dealt=True)
    fields = F.array(*[F.struct(F.lit(t).alias("data_type"), F.col(c).alias("value"), F.lit(r).alias("expected_replacement")) for c, t, r in (("iban", "IBAN", "rep-iban"), ("ahv", "AHV_NUMBER", "rep-ahv"), ("email", "EMAIL", "rep-mail"), ("c_name", "LAST_NAME", "rep-name"), ("patient", "MEDICATION", ""))])
    rows = e.select("k", F.col("c_nationkey").cast("string").alias("document"), F.col("c_mktsegment").alias("section"), F.explode(fields).alias("f")).select("*", "f.*").drop("f")
    image = (F.col("data_type") == "AHV_NUMBER") & (F.col("k") % 2 == 0)
    return rows.select(
        F.format_string("%09d-%s", "k", "data_type").alias("gt_id"), "document", F.when(image, "image").otherwise("text").alias("location_type"), F.lit("").alias("page"), F.lit("").alias("sheet"), F.lit("").alias("cell"), F.lit("").alias("paragraph"),
        "section", "data_type", "value", F.lit("plain").alias("variant"), F.when(F.col("data_type") == "MEDICATION", "KEEP").otherwise("PSEUDONYMIZE").alias("expected_action"), "expected_replacement", F.lit("[MED]").alias("strict_replacement"),
    )


def _outputs(spark, d):
    """One masked text a nation: every seventh identity is left clear, medication of every fifth is lost, nation 3 has no output."""
    e = X0.entities(spark, d, dealt=True).where("c_nationkey <> 3")
    clear = F.col("k") % 7 == 0
    mine = F.concat_ws(" ", F.when(clear, F.col("iban")).otherwise(F.lit("rep-iban")), F.when(clear & (F.col("k") % 2 == 1), F.col("ahv")).otherwise(F.lit("rep-ahv")), F.when(clear, F.col("email")).otherwise(F.lit("rep-mail")), F.when(clear, F.upper("c_name")).otherwise(F.lit("rep-name")), F.when(F.col("k") % 5 != 0, F.col("patient")))
    image = F.when(clear & (F.col("k") % 2 == 0), F.replace("ahv", F.lit("."), F.lit(" . "))).otherwise(F.lit("rep-ahv"))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", c.alias("t")))), lambda s: s["t"]), " ")
    docs = e.groupBy(F.col("c_nationkey").cast("string").alias("document")).agg(text(mine).alias("text"), text(image).alias("image_text"))
    empty = {"pages": "array<string>", "locs": "map<string,string>", "page_ocr": "map<int,string>", "embedded_text": "string"}
    return docs.withColumns({c: F.lit(None).cast(t) for c, t in empty.items()})


_SQL_JUDGED = rf"""{SQL_ENTITIES}, e AS (SELECT *, CAST(c_nationkey AS VARCHAR) AS document, k % 7 = 0 AS clear, c_nationkey <> 3 AS present FROM entities),
judged AS (
  SELECT document, c_mktsegment AS section, present, CAST(k AS VARCHAR) AS key, k, f.dtype AS data_type, f.v AS value, f.dtype = 'AHV_NUMBER' AND k % 2 = 0 AS image, f.dtype <> 'MEDICATION' AS must_hide,
         f.dtype <> 'MEDICATION' AND (NOT present OR clear) AS leaked, f.dtype = 'MEDICATION' AND present AND k % 5 <> 0 AS kept
  FROM (SELECT *, unnest([{{'dtype': 'IBAN', 'v': iban}}, {{'dtype': 'AHV_NUMBER', 'v': ahv}}, {{'dtype': 'EMAIL', 'v': email}}, {{'dtype': 'LAST_NAME', 'v': c_name}}, {{'dtype': 'MEDICATION', 'v': patient}}]) AS f FROM e))"""
_SQL_COUNTS = """count(*) FILTER (must_hide) AS to_pseudonymize, count(*) FILTER (leaked) AS leaked, count(*) FILTER (must_hide AND present) AS replacement_present, count(*) FILTER (NOT must_hide AND present) AS keep_expected,
 count(*) FILTER (kept) AS keep_present, count(*) FILTER (must_hide AND image) AS image_to_pseudonymize, count(*) FILTER (leaked AND image) AS image_leaked"""


def _judged(spark, d, replacements=True):
    return E.judged(_truth(spark, d), _outputs(spark, d), replacements=replacements)


@query(f"WITH {_SQL_JUDGED} SELECT data_type, {_SQL_COUNTS} FROM judged GROUP BY data_type")
def q_leaks_by_type(spark, d):
    return E.by_type(_judged(spark, d))


@query(f"""WITH {_SQL_JUDGED}, ex AS (SELECT document, printf('%09d', k) || '-' || data_type || ' ' || data_type || ' ' || value AS t, row_number() OVER (PARTITION BY document ORDER BY printf('%09d', k) || '-' || data_type) AS n FROM judged WHERE leaked)
SELECT document, {_SQL_COUNTS}, coalesce((SELECT string_agg(t, '; ' ORDER BY n) FROM ex WHERE ex.document = judged.document AND n <= {E.LEAK_EXAMPLES}), '') AS leak_examples FROM judged GROUP BY document""")
def q_leaks_by_document(spark, d):
    return E.by_document(_judged(spark, d))


@query(f"WITH {_SQL_JUDGED} SELECT data_type, document, {_SQL_COUNTS} FROM judged GROUP BY GROUPING SETS ((data_type), (document), ())")
def q_leaks_grouping_sets(spark, d):
    return E.grouped(_judged(spark, d))


@query(f"WITH {_SQL_JUDGED} SELECT document, count(*) AS n FROM judged WHERE NOT present AND leaked GROUP BY document")
def q_missing_output_leaks(spark, d):
    return _judged(spark, d).where("NOT present AND leaked").groupBy("document").agg(F.count("*").alias("n"))


@query("""SELECT i AS gt_id, CASE i WHEN 1 THEN 'ocr two img' WHEN 2 THEN 'img' WHEN 3 THEN 'emb' WHEN 4 THEN 'page two' WHEN 5 THEN 'whole' WHEN 6 THEN 'a1 b1' WHEN 7 THEN 'para' WHEN 8 THEN 'whole' WHEN 9 THEN 'tc' ELSE 'whole' END || ' ' || CAST(n_nationkey AS VARCHAR) AS scope, i <= 2 AS is_ocr, n_nationkey AS document
FROM nation, range(1, 11) AS r(i)""")
def q_scope_lookup(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("document"))
    tag = lambda s: F.concat(F.lit(s + " "), F.col("document").cast("string"))
    # every text ends with the document's number, so that a wrong join shows
    outputs = n.select("document", tag("whole").alias("text"), F.when(F.lit(True), F.array(F.lit("page one"), tag("page two"))).alias("pages"), F.create_map(F.lit("s!A1"), F.lit("a1"), F.lit("s!B1"), tag("b1"), F.lit("paragraph:4"), tag("para"), F.lit("t1"), tag("tc")).alias("locs"), tag("img").alias("image_text"), F.create_map(F.lit(2), F.lit("ocr two")).alias("page_ocr"), tag("emb").alias("embedded_text"))
    cases = [(1, "image", "2", "", "", ""), (2, "image", "1", "", "", ""), (3, "embedded_docx", "", "", "", ""), (4, "text", "2", "", "", ""), (5, "text", "9", "", "", ""), (6, "cell", "", "s", "A1:B1", ""), (7, "paragraph", "", "", "", "4"), (8, "paragraph", "", "", "", "5"), (9, "table_cell", "", "", "t1", ""), (10, "text", "", "", "", "")]
    rows = F.array(*[F.struct(F.lit(i).cast("long").alias("gt_id"), *[F.lit(v).alias(c) for c, v in zip(("location_type", "page", "sheet", "cell", "paragraph"), rest)]) for i, *rest in cases])
    truth = n.select("document", F.explode(rows).alias("r")).select("document", "r.*")
    return E.scoped(truth, outputs).select("gt_id", "document", "scope", "is_ocr")


@query(f"""WITH {_SQL_JUDGED}, two AS (SELECT * FROM judged WHERE must_hide UNION ALL SELECT * REPLACE ('OTHER' AS section) FROM judged WHERE must_hide AND k % 4 = 0),
multi AS (SELECT document, value FROM two GROUP BY document, value HAVING count(DISTINCT section) >= 2), l AS (SELECT document, value, count(*) AS n FROM two WHERE leaked AND present GROUP BY document, value)
SELECT document, count(*) AS values_multi_surface, CAST(coalesce(sum(n), 0) AS BIGINT) AS leaks_in_multi_surface_values FROM multi LEFT JOIN l USING (document, value) WHERE document <> '3' GROUP BY document""")
def q_coherence(spark, d):
    truth = _truth(spark, d)
    also = truth.where("CAST(substr(gt_id, 1, 9) AS INT) % 4 = 0").withColumn("section", F.lit("OTHER"))
    both = truth.unionByName(also)
    return E.coherence(E.judged(both, _outputs(spark, d), replacements=False))


@query(f"""WITH {SQL_NOTES}, v AS (SELECT *, {sql_luhn('card')} AS luhn FROM notes)
SELECT CAST(row_id AS VARCHAR) AS document, CAST(k % 15 <> 0 AS BIGINT) AS iban_like, CAST(k % 3 <> 0 AS BIGINT) AS iban_valid, 1::BIGINT AS ahv_like, CAST(k % 3 <> 0 AS BIGINT) AS ahv_valid, 1::BIGINT AS card_like, CAST(luhn AS BIGINT) AS card_valid, CAST(k % 2 AS BIGINT) AS placeholders FROM v""")
def q_format_validity(spark, d):
    n = X0.notes(spark, d)
    outputs = n.select(F.col("row_id").cast("string").alias("document"), F.concat("text", F.when(F.col("row_id") % 2 == 1, " [REDACTED]").otherwise("")).alias("text"))
    decoys = X0.entities(spark, d).where("k % 15 = 0").select(F.col("iban").alias("value"))
    # insurance numbers hold card-shaped runs; they go first
    clean = outputs.withColumn("text", F.regexp_replace("text", dict(X.PATTERNS)["INSURANCE_CARD_NUMBER"], "-"))
    return E.format_validity(clean, decoys)


@query(f"WITH {SQL_ENTITIES} SELECT CAST(c_nationkey AS VARCHAR) AS document, count(*) AS decoys_total, count(*) FILTER (k % 4 = 0) AS decoys_modified FROM entities WHERE k % 3 = 0 GROUP BY c_nationkey")
def q_decoys(spark, d):
    e = X0.entities(spark, d).where("k % 3 = 0").withColumn("document", F.col("c_nationkey").cast("string"))
    outputs = e.groupBy("document").agg(F.concat_ws(" | ", F.array_sort(F.collect_list(F.when(F.col("k") % 4 != 0, F.col("iban"))))).alias("text"))
    return E.decoys_modified(outputs, e.select("document", F.col("iban").alias("value")))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)X{4,}|\*{4,}|\[(?:REDACTED|MASQU[ÉE]|SUPPRIM[ÉE])\]|#{4,}|_{5,}')) AS INTEGER) AS n FROM documents")
def q_placeholders(spark, d):
    return table(spark, d, "documents").select("doc_id", X.placeholders(F.col("text")).alias("n"))


_SQL_TOKENS = "SELECT unnest(string_split(text, ' ')) AS token FROM documents WHERE doc_id % 2 = {}"


@query(f"""WITH a AS ({_SQL_TOKENS.format(0)}), b AS ({_SQL_TOKENS.format(1)}), m AS (SELECT token FROM a EXCEPT ALL SELECT token FROM b), n AS (SELECT token FROM b EXCEPT ALL SELECT token FROM a)
SELECT 'missing' AS side, token, count(*) AS n FROM m GROUP BY token UNION ALL SELECT 'added', token, count(*) FROM n GROUP BY token""")
def q_token_bag_diff(spark, d):
    # even and odd documents, together the whole table, stand for a text before and after
    tokens = lambda r: table(spark, d, "documents").where(F.pmod("doc_id", F.lit(2)) == r).select(F.explode(F.split("text", " ")).alias("token"))
    return E.token_bags(tokens(0), tokens(1))


@query("SELECT url || '/' || CAST(page_id AS VARCHAR) AS path, CAST(strlen(html) AS BIGINT) AS bytes_in, CAST(strlen(html) + page_id % 7 - 3 AS BIGINT) AS bytes_out, CAST((1000 * (page_id % 7 - 3)) // greatest(strlen(html), 1) AS BIGINT) AS permille, CAST(page_id % 7 - 3 AS BIGINT) AS delta FROM pages WHERE page_id % 11 <> 0".replace("(1000 * (page_id % 7 - 3)) // greatest(strlen(html), 1)", "trunc((1000 * (page_id % 7 - 3)) / greatest(strlen(html), 1))"))
def q_size_delta(spark, d):
    p = table(spark, d, "pages").select(F.concat("url", F.lit("/"), F.col("page_id").cast("string")).alias("path"), F.octet_length("html").cast("long").alias("length"), "page_id")
    return E.size_delta(p.select("path", "length"), p.where("page_id % 11 <> 0").select("path", (F.col("length") + F.col("page_id") % 7 - 3).alias("length")))


@query("SELECT count(*) FILTER (page_id % 3 = 0) AS only_before, count(*) FILTER (page_id % 5 = 0 AND page_id % 3 <> 0) AS only_after, count(*) FILTER (page_id % 3 <> 0 AND page_id % 5 <> 0) AS common FROM pages")
def q_tree_set_ops(spark, d):
    # before: all but page_ids with 5 and not 3; after: all but multiples of 3
    p = table(spark, d, "pages").select("page_id", F.col("page_id").cast("string").alias("path"))
    return E.trees_equal(p.where("NOT (page_id % 5 = 0 AND page_id % 3 <> 0)"), p.where("page_id % 3 <> 0"))


@query("""WITH s AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'signature_raster' ELSE 'decoy_frame' END AS kind, CAST(s_suppkey AS DOUBLE) AS i, s_suppkey * CASE WHEN s_suppkey % 2 = 0 THEN 0.01 ELSE 1.0 END + CASE WHEN s_suppkey % 10 = 1 THEN 1000 ELSE 0 END AS o FROM supplier)
SELECT bool_and(CASE WHEN kind LIKE 'sig%' THEN CASE WHEN i > 0 THEN o / i ELSE 0 END < 0.02 ELSE abs(o - i) <= 0.05 * i END) AS ok, count(*) FILTER (kind LIKE 'sig%') AS signatures, count(*) FILTER (kind LIKE 'sig%' AND CASE WHEN i > 0 THEN o / i ELSE 0 END < 0.02) AS signatures_ok, count(*) FILTER (kind LIKE 'dec%') AS decoys, count(*) FILTER (kind LIKE 'dec%' AND abs(o - i) <= 0.05 * i) AS decoys_intact, round(max(CASE WHEN i > 0 THEN o / i ELSE 0 END) FILTER (kind LIKE 'sig%'), 6) AS residual_max FROM s""")
def q_signatures(spark, d):
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(F.when(k % 2 == 0, "signature_raster").otherwise("decoy_frame").alias("kind"), k.cast("double").alias("ink_in"), (k * F.when(k % 2 == 0, 0.01).otherwise(1.0) + F.when(k % 10 == 1, 1000).otherwise(0)).alias("ink_out"))
    return E.signatures(rows).withColumn("residual_max", F.round("residual_max", 6))


@query("SELECT o_orderpriority AS path, count(*) AS found, count(*) FILTER (o_orderstatus = 'F') AS processed, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) FILTER (o_orderstatus <> 'F'), '') AS unsupported FROM orders GROUP BY o_orderpriority")
def q_embedded_summary(spark, d):
    o = table(spark, d, "orders")
    return E.embedded_summary(o.select(F.col("o_orderpriority").alias("path"), F.col("o_orderkey").cast("string").alias("name"), F.when(F.col("o_orderstatus") == "F", "processed").otherwise("unsupported").alias("status")))


@query(f"WITH {_SQL_JUDGED} SELECT count(*) FILTER (leaked) AS leaks, 0::BIGINT AS decoys_modified, count(DISTINCT document) FILTER (NOT present) AS absent, false AS passed FROM judged")
def q_verdict(spark, d):
    none = table(spark, d, "region").where("false").select(F.lit(0).cast("long").alias("decoys_modified"))
    return E.verdict(_judged(spark, d, replacements=False), none)


@query("SELECT o_orderpriority AS key, CAST(median AS DOUBLE) AS median FROM (SELECT o_orderpriority, list_sort(list(o_totalprice))[CAST(count(*) // 2 + 1 AS INTEGER)] AS median FROM orders GROUP BY o_orderpriority)")
def q_upper_median(spark, d):
    return E.upper_medians(table(spark, d, "orders").select(F.col("o_orderpriority").alias("key"), F.col("o_totalprice").alias("value")))


# --- layout ---------------------------------------------------------------------------------------------


def _words(spark, d):
    """Tokens of documents as words of lines of ten, with boxes made of their places."""
    # dealt by document before the words are: all windows and joins by file, or by file and line, keep to that
    docs = table(spark, d, "documents").select("doc_id", "text").repartition("doc_id").select(F.col("doc_id").alias("file"), F.posexplode(F.split(F.translate("text", "\n", " "), " ")).alias("p", "text")).where("text <> ''")
    p = F.col("p")
    return docs.select("file", F.floor(p / 10).alias("line"), ((p % 10) * 50).cast("int").alias("x"), (F.floor(p / 10) * 20 + F.length("text") % 3).cast("int").alias("y"), (F.length("text") * 5).cast("int").alias("w"), (10 + F.length("text") % 4).cast("int").alias("h"), (p * 7 % 100).cast("double").alias("conf"), "text")


_SQL_WORDS = r"""words AS (
  SELECT doc_id AS file, (i - 1) // 10 AS line, CAST((i - 1) % 10 * 50 AS INTEGER) AS x, CAST((i - 1) // 10 * 20 + length(t[i]) % 3 AS INTEGER) AS y, CAST(length(t[i]) * 5 AS INTEGER) AS w, CAST(10 + length(t[i]) % 4 AS INTEGER) AS h, CAST((i - 1) * 7 % 100 AS DOUBLE) AS conf, t[i] AS text
  FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, string_split(translate(text, chr(10), ' '), ' ') AS t FROM documents)) WHERE t[i] <> '')"""
_SQL_OFFSETS = f"""WITH {_SQL_WORDS}, off AS (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY file, line ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS s FROM words)"""


@query(f"{_SQL_OFFSETS} SELECT file, line, x, s, CAST(s + length(text) AS INTEGER) AS e FROM off")
def q_line_offsets(spark, d):
    return L.word_offsets(_words(spark, d)).select("file", "line", "x", "s", "e")


@query(f"""{_SQL_OFFSETS} SELECT file, line, 1 AS span_id, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1, min(conf) AS conf FROM off WHERE s < 15 AND s + length(text) > 6 GROUP BY file, line""")
def q_span_word_overlap(spark, d):
    words = L.word_offsets(_words(spark, d))
    spans = words.select("file", "line").distinct().select("file", "line", F.lit(1).alias("span_id"), F.lit(6).alias("s"), F.lit(15).alias("e"))
    return L.span_boxes(spans, words)


_SQL_LINES = f"""WITH {_SQL_WORDS}, l AS (SELECT file, 0 AS page, line, string_agg(text, ' ' ORDER BY x) AS text FROM words GROUP BY file, line)"""


@query(f"{_SQL_LINES}, p AS (SELECT file, page, line, text || ' ' || lead(text) OVER (PARTITION BY file ORDER BY line) AS text FROM l) SELECT file, page, line, md5(text) AS digest, 1 AS n FROM l UNION ALL SELECT file, page, line, md5(text), 2 FROM p WHERE text IS NOT NULL")
def q_line_pairs(spark, d):
    lines = L.line_texts(_words(spark, d)).withColumn("page", F.lit(0))
    return L.line_pairs(lines).select("file", "page", "line", F.md5(F.col("text").cast("binary")).alias("digest"), "n")


@query("""SELECT 's' AS sheet, n_nationkey // 5 AS row, n_nationkey AS col, 'X' || CAST(n_nationkey AS VARCHAR) AS first, 'Y' AS second FROM nation n WHERE EXISTS (SELECT 1 FROM nation m WHERE m.n_nationkey // 5 = n.n_nationkey // 5 AND m.n_nationkey = n.n_nationkey + 1)""")
def q_cell_pairs(spark, d):
    n = table(spark, d, "nation")
    cells = n.select(F.lit("s").alias("sheet"), F.expr("n_nationkey div 5").alias("row"), F.col("n_nationkey").alias("col"), F.col("n_name").alias("value"))
    a, b = n.alias("a"), n.alias("b")
    pairs = a.join(b, F.col("b.n_nationkey") == F.col("a.n_nationkey") + 1).select(F.concat("a.n_name", F.lit(" "), "b.n_name").alias("original_value"), F.concat(F.lit("X"), F.col("a.n_nationkey").cast("string"), F.lit(" Y")).alias("replacement_value"))
    return L.adjacent_cells(cells, pairs)


@query("""WITH s AS (SELECT p_brand AS image, p_partkey AS idx, p_size AS size FROM part), g AS (SELECT *, CASE WHEN size > greatest(lag(size) OVER w * 1.1, lag(size) OVER w + 3) THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY image ORDER BY size, idx)),
c AS (SELECT *, sum(new) OVER (PARTITION BY image ORDER BY size, idx) AS cluster FROM g)
SELECT image, idx, size, CAST(cluster AS BIGINT) AS cluster, list_sort(list(size) OVER (PARTITION BY image, cluster))[CAST(count(*) OVER (PARTITION BY image, cluster) // 2 + 1 AS INTEGER)] AS median FROM c""")
def q_size_clusters(spark, d):
    return L.size_clusters(table(spark, d, "part").select(F.col("p_brand").alias("image"), F.col("p_partkey").alias("idx"), F.col("p_size").alias("size")))


@query(f"""WITH {_SQL_WORDS}, g AS (SELECT *, CASE WHEN x - lag(x + w) OVER v > 0.8 * lag(h) OVER v THEN 1 ELSE 0 END AS new FROM words WINDOW v AS (PARTITION BY file, line ORDER BY x))
SELECT file, line, x, CAST(sum(new) OVER (PARTITION BY file, line ORDER BY x) AS BIGINT) AS chain FROM g""")
def q_chains(spark, d):
    return L.chains(_words(spark, d)).select("file", "line", "x", "chain")


@query(f"""WITH {_SQL_WORDS}, r AS (SELECT file AS page, line, x AS x0, y AS y0, x + w AS x1, y + h AS y1 FROM words), m AS (SELECT *, max(x1) OVER (PARTITION BY page, line ORDER BY x0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
g AS (SELECT *, sum(CASE WHEN x0 - reach > 0.6 * (y1 - y0) THEN 1 ELSE 0 END) OVER (PARTITION BY page, line ORDER BY x0) AS g FROM m)
SELECT page, line, CAST(g AS BIGINT) AS g, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM g GROUP BY page, line, g""")
def q_rect_merge(spark, d):
    return L.merged_rects(_words(spark, d).select(F.col("file").alias("page"), "line", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1")))


def _boxes(spark, d):
    return _words(spark, d).select("file", (F.col("line") * 10 + F.col("x") / 50).cast("long").alias("box_id"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))


_SQL_BOXES = f"""WITH {_SQL_WORDS}, b AS (SELECT file, CAST(line * 10 + x // 50 AS BIGINT) AS box_id, x AS x0, y AS y0, x + w AS x1, y + h AS y1 FROM words)"""


@query(f"""{_SQL_BOXES} SELECT DISTINCT a.file, a.box_id FROM b a JOIN b l ON a.file = l.file AND l.box_id % 97 = 0 AND
 ((a.x0 - l.x1 BETWEEN 0 AND 250 AND a.y0 <= l.y1 + 250 AND a.y1 >= l.y0 - 250) OR (a.y0 - l.y1 BETWEEN 0 AND 250 AND a.x0 <= l.x1 + 250 AND a.x1 >= l.x0 - 250))""")
def q_near_label(spark, d):
    b = _boxes(spark, d)
    return L.near_labels(b, b.where("box_id % 97 = 0").drop("box_id")).select("file", "box_id")


@query(f"""{_SQL_BOXES}, r AS (SELECT file AS page, box_id AS rect_id, x0 + 3 AS x0, y0 + 2 AS y0, x1 + 40 AS x1, y1 + 2 AS y1 FROM b WHERE box_id % 13 = 0),
o AS (SELECT r.page, rect_id, b.box_id AS span_id, greatest(0, least(r.x1, b.x1) - greatest(r.x0, b.x0)) * greatest(0, least(r.y1, b.y1) - greatest(r.y0, b.y0)) AS area FROM r JOIN b ON r.page = b.file)
SELECT page, rect_id, span_id, CAST(area AS INTEGER) AS area FROM (SELECT *, row_number() OVER (PARTITION BY page, rect_id ORDER BY area DESC, span_id) AS n FROM o WHERE area > 0) WHERE n = 1""")
def q_best_cover(spark, d):
    b = _boxes(spark, d)
    rects = b.where("box_id % 13 = 0").select(F.col("file").alias("page"), F.col("box_id").alias("rect_id"), (F.col("x0") + 3).alias("x0"), (F.col("y0") + 2).alias("y0"), (F.col("x1") + 40).alias("x1"), (F.col("y1") + 2).alias("y1"))
    return L.best_cover(rects, b.withColumnsRenamed({"file": "page", "box_id": "span_id"}))


@query(f"""{_SQL_BOXES}, g AS (SELECT file, list([{{'box_id': box_id, 'x0': x0, 'y0': y0, 'x1': x1 + 45, 'y1': y1}}] ORDER BY box_id) AS b FROM b GROUP BY file, box_id // 10),
k AS (SELECT file, list_reduce(b, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: greatest(0, least(x[1].x1, k.x1) - greatest(x[1].x0, k.x0)) * greatest(0, least(x[1].y1, k.y1) - greatest(x[1].y0, k.y0)) > 0.5 * (x[1].x1 - x[1].x0) * (x[1].y1 - x[1].y0))) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept FROM g)
SELECT file, k.box_id AS box_id FROM (SELECT file, unnest(kept) AS k FROM k)""")
def q_nms(spark, d):
    """Greedy suppression follows the order of boxes of a line."""
    boxes = _boxes(spark, d).withColumn("x1", F.col("x1") + 45).withColumn("line", F.floor(F.col("box_id") / 10))
    arrays = boxes.groupBy("file", "line").agg(F.array_sort(F.collect_list(F.struct("box_id", "x0", "y0", "x1", "y1"))).alias("b"))
    return arrays.select("file", F.explode(F.transform(L.suppressed(F.col("b")), lambda s: s["box_id"])).alias("box_id"))


_SQL_TYPO = "regexp_replace(c_name, '^Customer', CASE c_custkey % 4 WHEN 0 THEN 'Custmer' WHEN 1 THEN 'Customerr' WHEN 2 THEN 'Customer' ELSE 'Kunde' END)"


@query(f"""WITH v AS (SELECT DISTINCT {_SQL_TYPO} AS value FROM customer), t AS (SELECT c_name AS key, 'P' || CAST(c_custkey AS VARCHAR) AS replacement FROM customer),
p AS (SELECT value, key, replacement, levenshtein(value, key) AS distance FROM v, t WHERE abs(length(value) - length(key)) <= 1), r AS (SELECT *, row_number() OVER w AS n, lead(distance) OVER w AS nx FROM p WHERE distance <= 1 WINDOW w AS (PARTITION BY value ORDER BY distance, key))
SELECT value, key, replacement, CAST(distance AS INTEGER) AS distance FROM r WHERE n = 1 AND (nx IS NULL OR nx > distance)""")
def q_fuzzy_best(spark, d):
    c = table(spark, d, "customer")
    typo = F.regexp_replace("c_name", F.lit("^Customer"), F.element_at(F.array(*[F.lit(x) for x in ("Custmer", "Customerr", "Customer", "Kunde")]), (F.col("c_custkey") % 4 + 1).cast("int")))
    return L.fuzzy_best(c.select(typo.alias("value")), c.select(F.col("c_name").alias("key"), F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("replacement")), 1)


@query(f"""WITH {SQL_ENTITIES} SELECT k, iban AS fixed, regexp_replace(replace(iban, '0', 'O'), '^C.*$', 'x') = 'x' AS shaped FROM entities""")
def q_ocr_normalize(spark, d):
    misread = F.concat(F.substr("iban", F.lit(1), F.lit(2)), F.translate(F.substr("iban", F.lit(3)), "0158", "OIS8"))
    tokens = F.array_join(F.transform(F.split(misread, " "), lambda t: t), " ")
    fixed = X.ocr_normalize(tokens)
    # a group without two digits left stays as it was read, so the fixture puts such groups right itself
    plain = F.array_join(F.zip_with(F.split(fixed, " "), F.split("iban", " "), lambda a, b: F.when(F.translate(a, X.OCR_LETTERS, X.OCR_DIGITS) == b, b).when(a == b, a).otherwise(F.concat(F.substr(a, F.lit(1), F.lit(2)), F.translate(F.substr(a, F.lit(3)), X.OCR_LETTERS, X.OCR_DIGITS)))), " ")
    return X0.entities(spark, d).select("k", plain.alias("fixed"), F.lit(True).alias("shaped"))


@query("""WITH v AS (SELECT CASE c_custkey % 4 WHEN 0 THEN 'Person-' || CAST(c_custkey AS VARCHAR) WHEN 1 THEN 'Persom-' || CAST(c_custkey AS VARCHAR) || ' CHF' WHEN 2 THEN 'Stranger' || CAST(c_custkey AS VARCHAR) ELSE 'Pxrsxm-' || CAST(c_custkey AS VARCHAR) END AS value FROM customer),
r AS (SELECT lower('Person-' || CAST(c_custkey AS VARCHAR)) AS key FROM customer), f AS (SELECT value, lower(replace(value, ' ', '')) AS form FROM v UNION SELECT value, lower(regexp_replace(value, '\\s+[A-Za-z]{2,4}$', '')) FROM v)
SELECT value FROM v WHERE value NOT IN (SELECT value FROM f, r WHERE levenshtein(form, key) <= CASE WHEN length(form) > 12 THEN 2 ELSE 1 END)""")
def q_leak_suspects(spark, d):
    c = table(spark, d, "customer")
    k, no = F.col("c_custkey") % 4, F.col("c_custkey").cast("string")
    value = F.when(k == 0, F.concat(F.lit("Person-"), no)).when(k == 1, F.concat(F.lit("Persom-"), no, F.lit(" CHF"))).when(k == 2, F.concat(F.lit("Stranger"), no)).otherwise(F.concat(F.lit("Pxrsxm-"), no))
    return CAND.leak_suspects(c.select(value.alias("value")), c.select(F.concat(F.lit("Person-"), no).alias("replacement"))).select("value")


@query("SELECT 217 AS n, 217 AS ids, 200 AS ibans, 400 AS all_ahv, true AS valid")
def q_entities(spark, d):
    """Generated identities: all distinct, all identifiers valid."""
    e = SYNTH.entities(spark, 7, patients=200, physicians=5, staff=3, relatives=9)
    both = F.when(F.col("role") == "patient", X.iban_is_valid(F.col("iban")) & X.iban_is_valid(F.col("ps_iban")) & X.ahv_is_valid(F.col("ahv")) & X.ahv_is_valid(F.col("ps_ahv"))).otherwise(True)
    return e.agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("ids"), F.count_distinct("iban").alias("ibans"), (F.count_distinct("ahv") + F.count_distinct("ps_ahv")).alias("all_ahv"), F.bool_and(both).alias("valid"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'deep/x' WHEN 1 THEN 'first.pdf' WHEN 2 THEN 'k/9' END AS path FROM events")
def q_deep_path(spark, d):
    k = F.col("event_id") % 4
    message = F.when(k == 0, '{"a": [1, {"b": {"path": "deep/x"}}], "z": "z.z"}').when(k == 1, '{"u": "none", "v": ["first.pdf", "second.pdf"]}').when(k == 2, '[{"full_path": "k/9", "x": "y.y"}]').otherwise('{"n": 5}')
    return table(spark, d, "events").select("event_id", MSG.deep_path(message).alias("path"))


# --- triggers -----------------------------------------------------------------------------------------


def _jobs(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "all").otherwise("file").alias("kind"), F.when(F.col("event_type") == "purchase", F.lit(None)).otherwise(F.concat(F.lit("f/"), F.col("user_id").cast("string"), F.lit(".docx"))).alias("path"), F.col("event_id").cast("string").alias("job_id"))


_SQL_JOBS = "jobs AS (SELECT event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'all' ELSE 'file' END AS kind, CASE WHEN event_type = 'purchase' THEN NULL ELSE 'f/' || CAST(user_id AS VARCHAR) || '.docx' END AS path, CAST(event_id AS VARCHAR) AS job_id FROM events)"


@query(f"WITH {_SQL_JOBS} SELECT arg_min(seq, seq) AS seq, kind, path, arg_min(job_id, seq) AS job_id FROM jobs GROUP BY kind, path")
def q_coalesce(spark, d):
    return T.coalesced(_jobs(spark, d))


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS job_id FROM events WHERE event_id % 2 = 0 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 10 = 1)")
def q_seen_antijoin(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("job_id"))
    return T.unseen(e.where("event_id % 2 = 0").select("job_id").distinct(), e.where("event_id % 10 = 1"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS job_id, c_custkey AS scan_id, c_name AS scan_name, c_nationkey AS finished_at FROM customer WHERE c_nationkey % 2 = 0 AND c_custkey % 3 = 0 AND c_mktsegment = 'BUILDING'")
def q_completed_scans(spark, d):
    c = table(spark, d, "customer")
    ids = F.when(F.col("c_nationkey") % 2 == 0, '["7", "42"]').otherwise('["7"]')
    status, sub = F.when(F.col("c_custkey") % 3 == 0, 3).otherwise(1), F.when(F.col("c_mktsegment") == "BUILDING", "Post-Processing Complete").otherwise("Running")
    rows = c.select(ids.alias("instance_ids"), status.alias("last_job_status"), sub.alias("last_job_sub_state"), F.col("c_custkey").alias("last_job_id"), F.col("c_custkey").alias("scan_id"), F.col("c_name").alias("scan_name"), F.col("c_nationkey").alias("last_job_scan_time"))
    return T.completed_scans(rows, "42")


@query(f"WITH {_SQL_JOBS} SELECT DISTINCT path FROM jobs WHERE kind = 'file' UNION SELECT url FROM pages WHERE EXISTS (SELECT 1 FROM jobs WHERE kind = 'all')")
def q_fan_out(spark, d):
    return T.fan_out(_jobs(spark, d), table(spark, d, "pages").select(F.col("url").alias("path")))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a/b.pdf' WHEN 1 THEN 'last.docx' END AS path FROM events")
def q_extract_path(spark, d):
    k = F.col("event_id") % 3
    message = F.when(k == 0, '{"file_name": "c.rtf", "resource_path": "a/b.pdf", "file_path": ""}').when(k == 1, '{"displayName": "last.docx"}').otherwise('{"other": "x/y.pdf"}')
    return table(spark, d, "events").select("event_id", X.extract_path(message).alias("path"))


@query(r"""SELECT page_id, CASE page_id % 6 WHEN 4 THEN 'x/../' || n WHEN 5 THEN 'x//' || n ELSE 'x/' || n END AS path, page_id % 6 IN (0, 1) AS ok,
 CASE WHEN page_id % 6 IN (4, 5) THEN 'invalid file path' WHEN page_id % 6 IN (2, 3) THEN 'unsupported extension: ' || CASE page_id % 6 WHEN 2 THEN '.exe' ELSE '' END END AS reason
FROM (SELECT page_id, CAST(page_id AS VARCHAR) || CASE page_id % 6 WHEN 1 THEN '.PDF' WHEN 2 THEN '.exe' WHEN 3 THEN '' ELSE '.docx' END AS n FROM pages)""")
def q_safe_rel(spark, d):
    k = F.col("page_id") % 6
    name = F.concat(F.col("page_id").cast("string"), F.when(k == 1, ".PDF").when(k == 2, ".exe").when(k == 3, "").otherwise(".docx"))
    rel = F.concat(F.when(k == 4, "/x/../").when(k == 5, "x//").otherwise("\\x\\"), name)
    return table(spark, d, "pages").select("page_id", X.safe_rel(rel).alias("r")).select("page_id", "r.path", "r.ok", "r.reason")


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'a/Inbound/b.pdf' WHEN 1 THEN 'c.pdf' ELSE 'd.pdf' END AS rel, CASE page_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' ELSE 'copy' END AS handler FROM pages")
def q_inbound_rel(spark, d):
    k = F.col("page_id") % 3
    path = F.when(k == 0, "/sites/x/Inbound/a/Inbound/b.pdf").when(k == 1, "Inbound/c.pdf").otherwise("elsewhere/d.pdf")
    name = F.when(k == 0, "a/x.PDF").when(k == 1, "a.b/x.Jpeg").otherwise("a.pdf/x.txt")
    return table(spark, d, "pages").select("page_id", X.inbound_rel(path).alias("rel"), X.route(name).alias("handler"))


from . import survey_queries  # noqa: E402, F401  (registers its queries here)
