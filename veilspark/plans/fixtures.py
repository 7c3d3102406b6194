"""Fixtures derived from the driver's tables by plain expressions, in Spark and as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

#: Key of the registered queries; a fixture, not a default of the library.
DEMO_KEY = b"fixture-key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """One fictional identity a customer; every third key has wrong check digits.

    dealt: customers are dealt by key first, since a file of one row group is read by one task, which would make all identities.
    """
    k = F.col("c_custkey")
    bban = F.concat(F.lit("8"), F.lpad((k * 7919 % 10**12).cast("string"), 16, "0"))
    check = X.iban_check_digits(F.lit("CH"), bban)
    wrong = F.lpad((check.cast("int") % 97 + 1).cast("string"), 2, "0")
    twelve = F.concat(F.lit("756"), F.lpad((k * 7919 % 10**9).cast("string"), 9, "0"))
    digit = X.ean13_check_digit(twelve)
    bad = ((digit.cast("int") + 1) % 10).cast("string")
    spoiled = k % 3 == 0
    customers = table(spark, sf_dir, "customer")
    customers = customers.repartition("c_custkey") if dealt else customers
    return customers.select(
        k.alias("k"), "c_name", "c_nationkey", "c_mktsegment",
        X.iban_format(F.concat(F.lit("CH"), F.when(spoiled, wrong).otherwise(check), bban)).alias("iban"),
        F.regexp_replace(F.concat(twelve, F.when(spoiled, bad).otherwise(digit)), r"^(...)(....)(....)(..)$", "$1.$2.$3.$4").alias("ahv"),
        X.groups_of(F.concat(F.lit("4"), F.lpad((k * 104729 % 10**14).cast("string"), 14, "0"), (k % 10).cast("string")), 4).alias("card"),
        X.groups_of(F.concat(F.lit("80756"), F.lpad((k * 31337 % 10**12).cast("string"), 15, "0")), 5).alias("insurance"),
        F.concat(F.lit("PAT-2026-"), F.lpad((k % 100000).cast("string"), 5, "0")).alias("patient"),
        F.concat(F.lit("+41 79 "), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(" "), F.lpad((k % 97).cast("string"), 2, "0"), F.lit(" "), F.lpad((k % 89).cast("string"), 2, "0")).alias("phone"),
        F.concat(F.lit("user"), k.cast("string"), F.lit("@mail.example.com")).alias("email"),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, nation, text): a sentence of each identity's values; the IBAN stands without spaces for even keys."""
    e = entities(spark, sf_dir)
    iban = F.when(F.col("k") % 2 == 0, F.replace("iban", F.lit(" "), F.lit(""))).otherwise(F.col("iban"))
    text = F.concat(F.lit("Record of "), "c_name", F.lit(": account "), iban, F.lit("; AHV "), "ahv", F.lit("; card "), "card", F.lit("; insured "), "insurance", F.lit("; file "), "patient", F.lit("; call "), "phone", F.lit("; write "), "email", F.lit("."))
    return e.select(F.col("k").alias("row_id"), F.col("c_nationkey").alias("nation"), text.alias("text"))


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pseudonym table of customer names with its row order; keys divisible by 5 come twice, the later row wins."""
    c = table(spark, sf_dir, "customer")
    first = c.select(F.lit("LAST_NAME").alias("data_type"), F.col("c_name").alias("original_value"), F.concat(F.lit("Person-"), F.col("c_custkey").cast("string")).alias("replacement_value"), F.col("c_custkey").alias("line"))
    later = first.where("line % 5 = 0").select("data_type", "original_value", F.concat("replacement_value", F.lit("-b")).alias("replacement_value"), (F.col("line") + 10**9).alias("line"))
    return first.unionByName(later)


# --- the same as SQL -------------------------------------------------------------------


def sql_digits(x: str) -> str:
    return f"list_transform(string_split({x}, ''), lambda c: CAST(c AS INTEGER))"


def sql_ean13(d12: str) -> str:
    return f"CAST((10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr({d12}, CAST(i AS INTEGER), 1) AS INTEGER) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) % 10 AS INTEGER)"


def sql_luhn(x: str) -> str:
    d = f"reverse(replace({x}, ' ', ''))"
    v = f"CAST(substr({d}, CAST(i AS INTEGER), 1) AS INTEGER)"
    return f"(list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {v} WHEN {v} > 4 THEN 2 * {v} - 9 ELSE 2 * {v} END)) % 10 = 0)"


def sql_mod97(x: str) -> str:
    """An alphanumeric string modulo 97, folded over characters."""
    return f"list_reduce(list_prepend(0, list_transform(string_split(upper({x}), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, v: (a * CASE WHEN v < 10 THEN 10 ELSE 100 END + v) % 97)"


def sql_groups(x: str, n: int) -> str:
    return f"rtrim(regexp_replace({x}, '(.{{{n}}})', '\\1 ', 'g'))"


def sql_hmac(message: str, key: bytes = DEMO_KEY) -> str:
    """Hex HMAC-SHA256 of a text expression."""
    block = key.ljust(64, b"\0")
    inner, outer = (bytes(b ^ p for b in block).hex() for p in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


def sql_hmac_digits(value: str, n: int | str, key: bytes = DEMO_KEY) -> str:
    """n digits of the HMAC of a value without white space in upper case."""
    h = sql_hmac(f"upper(regexp_replace({value}, '\\s+', '', 'g'))", key)
    modulus = f"CAST(rpad('1', CAST({n} AS INTEGER) + 1, '0') AS HUGEINT)"
    folded = f"list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(range(0, 16), lambda i: CAST(CAST('0x' || substr(hx, CAST(4 * i + 1 AS INTEGER), 4) AS INTEGER) AS HUGEINT))), lambda a, v: (a * 65536 + v) % {modulus})"
    return f"(SELECT lpad(CAST({folded} AS VARCHAR), CAST({n} AS INTEGER), '0') FROM (SELECT {h} AS hx))"


SQL_ENTITIES = rf"""entities0 AS (
  SELECT c_custkey AS k, c_name, c_nationkey, c_mktsegment, '8' || lpad(CAST(c_custkey * 7919 % 1000000000000 AS VARCHAR), 16, '0') AS bban,
         '756' || lpad(CAST(c_custkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS d12 FROM customer),
entities1 AS (SELECT *, 98 - CAST(bban || '121700' AS HUGEINT) % 97 AS ck, {sql_ean13('d12')} AS dg FROM entities0),
entities2 AS (
  SELECT *, 'CH' || lpad(CAST(CASE WHEN k % 3 = 0 THEN ck % 97 + 1 ELSE ck END AS VARCHAR), 2, '0') || bban AS ib,
         d12 || CAST(CASE WHEN k % 3 = 0 THEN (dg + 1) % 10 ELSE dg END AS VARCHAR) AS d13 FROM entities1),
entities AS (
  SELECT k, c_name, c_nationkey, c_mktsegment, {sql_groups('ib', 4)} AS iban, substr(d13, 1, 3) || '.' || substr(d13, 4, 4) || '.' || substr(d13, 8, 4) || '.' || substr(d13, 12, 2) AS ahv,
         {sql_groups("'4' || lpad(CAST(k * 104729 % 100000000000000 AS VARCHAR), 14, '0') || CAST(k % 10 AS VARCHAR)", 4)} AS card,
         {sql_groups("'80756' || lpad(CAST(k * 31337 % 1000000000000 AS VARCHAR), 15, '0')", 5)} AS insurance,
         'PAT-2026-' || lpad(CAST(k % 100000 AS VARCHAR), 5, '0') AS patient,
         '+41 79 ' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') || ' ' || lpad(CAST(k % 97 AS VARCHAR), 2, '0') || ' ' || lpad(CAST(k % 89 AS VARCHAR), 2, '0') AS phone,
         'user' || CAST(k AS VARCHAR) || '@mail.example.com' AS email FROM entities2)"""

SQL_NOTES = SQL_ENTITIES + r""",
notes AS (
  SELECT k AS row_id, c_nationkey AS nation, 'Record of ' || c_name || ': account ' || CASE WHEN k % 2 = 0 THEN replace(iban, ' ', '') ELSE iban END || '; AHV ' || ahv || '; card ' || card
         || '; insured ' || insurance || '; file ' || patient || '; call ' || phone || '; write ' || email || '.' AS text, * FROM entities)"""

SQL_MAPPING = r"""mapping AS (
  SELECT 'LAST_NAME' AS data_type, c_name AS original_value, 'Person-' || CAST(c_custkey AS VARCHAR) AS replacement_value, c_custkey AS line FROM customer
  UNION ALL SELECT 'LAST_NAME', c_name, 'Person-' || CAST(c_custkey AS VARCHAR) || '-b', c_custkey + 1000000000 FROM customer WHERE c_custkey % 5 = 0)"""
