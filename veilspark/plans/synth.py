"""Fictional people and identifiers, computed from row numbers.

Every value is a hash of (seed, row, field), so rows can be made in any order by any task, and what must be
unique carries its row's place in a permutation instead of being drawn again. Sequences of other
generators are not reproduced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.keyed import CITIES, rotated_city, shifted_birth_date

ROLES = (("patient", "P"), ("physician", "D"), ("staff", "S"), ("relative", "R"))
#: Word parts of invented names; originals and replacements differ in their last part, so they never meet.
HEADS = ("Al", "Ber", "Cor", "Dal", "Es", "Fal", "Gre", "Hol", "Im", "Jor", "Kel", "Lin", "Mar", "Nor", "Os", "Per", "Qui", "Ros", "Sel", "Tor")
MIDDLES = ("a", "be", "de", "fi", "ge", "la", "li", "mo", "na", "ne", "ri", "ro", "sa", "te", "vi")
TAILS = {"original": ("ner", "rich", "mann", "let", "dier"), "replacement": ("hart", "son", "wyl", "berg", "quet")}


def _pick(seed: int, field: str, n: int, row: Column | None = None) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(field), F.col("row") if row is None else row), F.lit(n))


def unique_number(seed: int, field: str, bits: int, row: Column) -> Column:
    """A bijection of row numbers below 2**bits (bits even): no two rows share a number."""
    half = bits // 2
    mask = (1 << half) - 1
    left, right = F.shiftrightunsigned(row.cast("long"), half), row.cast("long").bitwiseAND(mask)
    for k in range(4):
        left, right = right, left.bitwiseXOR(F.xxhash64(F.lit(seed), F.lit(field), F.lit(k), right).bitwiseAND(mask))
    return F.shiftleft(left, half).bitwiseOR(right)


def _name(seed: int, field: str, kind: str) -> Column:
    part = lambda f, pool: F.get(F.array(*[F.lit(x) for x in pool]), _pick(seed, field + f, len(pool)).cast("int"))
    return F.concat(part("1", HEADS), part("2", MIDDLES), part("3", TAILS[kind]))


def iban(seed: int, field: str, country: Column, row: Column) -> Column:
    """A valid IBAN of CH, DE, FR (with its account key) or AT, unique by row below 2**32."""
    n = unique_number(seed, field, 32, row)
    digits = F.lpad(n.cast("string"), 11, "0")
    swiss = F.concat((80000 + _pick(seed, field + "b", 10000, row)).cast("string"), F.lit("0"), digits)
    german = F.concat((10000000 + _pick(seed, field + "b", 89999999, row)).cast("string"), F.lpad(n.cast("string"), 10, "0"))
    bank, branch = 10000 + _pick(seed, field + "b", 89999, row), 10000 + _pick(seed, field + "c", 89999, row)
    french = F.concat(bank.cast("string"), branch.cast("string"), digits, F.lpad((97 - (89 * bank + 15 * branch + 3 * n) % 97).cast("string"), 2, "0"))
    austrian = F.concat(bank.cast("string"), digits)
    account = F.when(country == "CH", swiss).when(country == "DE", german).when(country == "FR", french).otherwise(austrian)
    return F.concat(country, X.iban_check_digits(country, account), account)


def ahv(seed: int, field: str, row: Column, valid: bool = True) -> Column:
    """A 756 number unique by row below 2**28, with a right or a wrong check digit."""
    twelve = F.concat(F.lit("756"), F.lpad(unique_number(seed, field, 28, row).cast("string"), 9, "0"))
    digit = X.ean13_check_digit(twelve)
    last = digit if valid else ((digit.cast("int") + 1 + _pick(seed, field + "x", 9, row)) % 10).cast("string")
    return F.regexp_replace(F.concat(twelve, last), r"^(...)(....)(....)(..)$", "$1.$2.$3.$4")


def invalid_iban(seed: int, field: str, row: Column) -> Column:
    """A Swiss IBAN shape whose check digits are wrong."""
    good = iban(seed, field, F.lit("CH"), row)
    wrong = 2 + (F.substr(good, F.lit(3), F.lit(2)).cast("int") - 2 + 1 + _pick(seed, field + "x", 96, row).cast("int")) % 97
    return F.concat(F.lit("CH"), F.lpad(wrong.cast("string"), 2, "0"), F.substr(good, F.lit(5)))


def non_luhn_card(seed: int, field: str, row: Column) -> Column:
    """16 digits in groups of four that fail the Luhn test: the last digit is moved on where they would pass."""
    fifteen = F.concat(F.lit("4"), F.lpad(unique_number(seed, field, 46, row).cast("string"), 14, "0"))
    last = _pick(seed, field + "l", 10, row).cast("int")
    passes = X.luhn_is_valid(F.concat(fifteen, last.cast("string")))
    return X.groups_of(F.concat(fifteen, F.when(passes, (last + 1) % 10).otherwise(last).cast("string")), 4)


def phone(seed: int, field: str, french: Column | None = None, row: Column | None = None) -> Column:
    """A Swiss number with an implausible block, or a French one of the range kept for fiction."""
    pair = lambda f: F.lpad(_pick(seed, field + f, 100, row).cast("string"), 2, "0")
    swiss = F.concat(F.lit("+41 79 000 "), pair("1"), F.lit(" "), pair("2"))
    return swiss if french is None else F.when(french, F.concat(F.lit("+33 6 39 98 "), pair("1"), F.lit(" "), pair("2"))).otherwise(swiss)


def email(first: Column, last: Column, seed: int, field: str) -> Column:
    domain = F.get(F.array(*[F.lit(d) for d in ("example.ch", "example.com", "exemple.fr", "example.org")]), _pick(seed, field, 4).cast("int"))
    plain = lambda c, by: F.replace(F.replace(F.lower(X.strip_accents(c)), F.lit("-"), F.lit(by)), F.lit(" "), F.lit(""))
    return F.concat(plain(first, "."), F.lit("."), plain(last, ""), F.lit("@"), domain)


def honorific(gender: Column, language: Column) -> Column:
    return F.when(language == "de", F.when(gender == "M", "Herr").otherwise("Frau")).otherwise(F.when(gender == "M", "M.").otherwise("Mme"))


def entities(spark: SparkSession, seed: int, patients: int = 64, physicians: int = 8, staff: int = 4, relatives: int = 16) -> DataFrame:
    """Fictional people with their replacements (ps_*); patients have identifiers, a physician and a relative to call."""
    counts = (patients, physicians, staff, relatives)
    total = sum(counts)
    role, tag, first_row = F.lit(ROLES[-1][0]), F.lit(ROLES[-1][1]), F.lit(total - relatives)
    for (name, t), start in reversed(list(zip(ROLES[:-1], (0, patients, patients + physicians)))):
        end = start + dict(zip((r for r, _ in ROLES), counts))[name]
        role, tag, first_row = F.when(F.col("row") < end, name).otherwise(role), F.when(F.col("row") < end, t).otherwise(tag), F.when(F.col("row") < end, start).otherwise(first_row)
    df = spark.range(total).withColumnRenamed("id", "row").withColumns({"role": role, "entity_id": F.concat(tag, F.lpad((F.col("row") - first_row + 1).cast("string"), 3, "0"))})
    choose = lambda f, *pool: F.get(F.array(*[F.lit(x) for x in pool]), _pick(seed, f, len(pool)).cast("int"))
    df = df.withColumns({
        "gender": choose("gender", "M", "F"), "lang": choose("lang", "fr", "fr", "de"),
        "first": _name(seed, "first", "original"), "last": F.concat(_name(seed, "last", "original"), F.lit("-"), _name(seed, "last2", "original")),
        "ps_first": _name(seed, "ps_first", "replacement"), "ps_last": F.concat(_name(seed, "ps_last", "replacement"), F.lit("-"), _name(seed, "ps_last2", "replacement")),
        "dob": F.date_add(F.lit("1938-01-01").cast("date"), _pick(seed, "dob", 24000).cast("int")),
        "city_no": _pick(seed, "city", len(CITIES)).cast("int"), "country": choose("country", *["CH"] * 12, *["DE"] * 3, *["FR"] * 3, *["AT"] * 2),
    })
    npa, city = (F.get(F.array(*[F.lit(c[k]) for c in CITIES]), F.col("city_no")) for k in (0, 1))
    is_patient = F.col("role") == "patient"
    row = F.col("row")
    only = lambda c: F.when(is_patient, c)
    df = df.withColumns({
        "ps_dob": shifted_birth_date(F.col("dob")), "city": F.concat(npa, F.lit(" "), city), "ps_city": rotated_city(npa, city),
        "email": email(F.col("first"), F.col("last"), seed, "mail"), "ps_email": email(F.col("ps_first"), F.col("ps_last"), seed, "ps_mail"),
        "phone": phone(seed, "phone", (F.col("lang") == "fr") & (_pick(seed, "french", 4) == 0)), "ps_phone": phone(seed, "ps_phone"),
        "patient_id": only(F.concat(F.lit("PAT-2026-"), F.lpad(unique_number(seed, "pid", 16, row).cast("string"), 5, "0"))),
        "ahv": only(ahv(seed, "ahv", row)), "ps_ahv": only(ahv(seed, "ahv", row + total)),
        "iban": only(X.iban_format(iban(seed, "iban", F.col("country"), row))), "ps_iban": only(X.iban_format(iban(seed, "iban", F.col("country"), row + total))),
        "physician": only(F.concat(F.lit("D"), F.lpad((1 + _pick(seed, "physician", max(1, physicians))).cast("string"), 3, "0"))),
        "relative": only(F.concat(F.lit("R"), F.lpad((1 + _pick(seed, "relative", max(1, relatives))).cast("string"), 3, "0"))),
    })
    return df.drop("row", "city_no")
