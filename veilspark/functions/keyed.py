"""Keyed deterministic pseudonyms in Column expressions.

A value's digits come from HMAC-SHA256 of its normal form, built of two SHA-256
calls with pads made of the key on the driver, and a Horner fold over the hash. The key
is an argument without default. It shows in plans as literals: redact plans
(spark.sql.redaction.string.regex) where they are kept.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ean13_check_digit, groups_of, iban_check_digits, let, norm

#: Test card numbers that stand for cards (fixed values).
PSEUDO_CARDS = (
    "4000 0075 6000 0009", "4000 0027 6000 0016", "4000 0025 0000 0003", "4000 0004 0000 0008", "4000 0082 6000 0000", "4000 0000 0000 0077", "4000 0000 0000 0093",
    "4000 0025 0000 3155", "4000 0000 0000 3220", "4000 0000 0000 9995", "3566 0020 2036 0505", "3056 9300 0902 0004", "6200 0000 0000 0005",
)
#: Address and city pools; a replacement is the entry CITY_SHIFT further on (fixed values).
CITIES = (
    ("1201", "Genève"), ("1205", "Genève"), ("1003", "Lausanne"), ("1007", "Lausanne"), ("1260", "Nyon"), ("1800", "Vevey"), ("1820", "Montreux"), ("1400", "Yverdon-les-Bains"), ("1700", "Fribourg"),
    ("2000", "Neuchâtel"), ("2502", "Biel/Bienne"), ("1950", "Sion"), ("3011", "Bern"), ("3600", "Thun"), ("4051", "Basel"), ("4600", "Olten"), ("6003", "Luzern"), ("6300", "Zug"), ("8001", "Zürich"),
    ("8004", "Zürich"), ("8400", "Winterthur"), ("9000", "St. Gallen"), ("7000", "Chur"), ("6900", "Lugano"), ("6500", "Bellinzona"), ("1870", "Monthey"),
)
CITY_SHIFT = 7


def pads(key: bytes) -> tuple[str, str]:
    """Inner and outer HMAC pads in hex."""
    if not key:
        raise ValueError("a key is needed")
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block).hex(), bytes(b ^ 0x5C for b in block).hex()


def hmac_hex(message: Column, key: bytes) -> Column:
    inner, outer = pads(key)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(F.sha2(F.concat(F.unhex(F.lit(inner)), F.encode(message, "UTF-8")), 256))), 256)


def hmac_digits(value: Column, n: int | Column, key: bytes) -> Column:
    """n decimal digits (30 at most) of the value's HMAC."""
    return let(hmac_hex(F.upper(norm(value)), key), lambda h: _reduced(h, n))


def _reduced(h: Column, n: int | Column) -> Column:
    """64 hex digits modulo 10**n, as n digits: a fold in longs where products fit, else in decimals."""
    chunks = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.substr(h, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    if isinstance(n, int) and n <= 14:
        return F.lpad(F.aggregate(chunks, F.lit(0).cast("long"), lambda a, x: (a * 65536 + x) % (10**n)).cast("string"), n, "0")
    digits = F.lit(n) if isinstance(n, int) else n
    modulus = F.rpad(F.lit("1"), digits + 1, F.lit("0")).cast("decimal(38,0)")
    number = let(modulus, lambda m: F.aggregate(chunks, F.lit(0).cast("decimal(38,0)"), lambda a, x: ((a * 65536 + x) % m).cast("decimal(38,0)")))
    return F.lpad(number.cast("string"), digits, F.lit("0"))


def _iban(value: Column, key: bytes) -> Column:
    k = F.upper(norm(value))
    country, size = F.substr(k, F.lit(1), F.lit(2)), F.greatest(F.length(k) - 4, F.lit(1))
    account = let(hmac_digits(value, size, key), lambda a: F.when(country == "CH", F.concat(F.lit("8"), F.substr(a, F.lit(2)))).otherwise(a))
    iban = let(account, lambda a: F.concat(country, iban_check_digits(country, a), a))
    return let(iban, lambda v: F.when(F.contains(value, F.lit(" ")), groups_of(v, 4)).otherwise(v))


def _ahv(value: Column, key: bytes) -> Column:
    return let(F.concat(F.lit("756"), hmac_digits(value, 9, key)), lambda t: F.regexp_replace(F.concat(t, ean13_check_digit(t)), r"^(...)(....)(....)(..)$", "$1.$2.$3.$4"))


#: How each type's pseudonym is made.
GENERATORS = {
    "IBAN": _iban,
    "AHV_NUMBER": _ahv,
    "CREDIT_CARD": lambda v, k: F.element_at(F.array(*[F.lit(c) for c in PSEUDO_CARDS]), (hmac_digits(v, 4, k).cast("int") % len(PSEUDO_CARDS)) + 1),
    "INSURANCE_CARD_NUMBER": lambda v, k: groups_of(F.concat(F.lit("80756"), hmac_digits(v, 15, k)), 5),
    "PATIENT_ID": lambda v, k: F.concat(F.lit("PAT-"), F.substr(v, F.lit(5), F.lit(4)), F.lit("-"), hmac_digits(v, 5, k)),
    "EMAIL": lambda v, k: F.concat(F.lit("contact."), hmac_digits(v, 6, k), F.lit("@example.org")),
    "PHONE": lambda v, k: F.concat(F.lit("+41 79 000 "), hmac_digits(v, 2, k), F.lit(" "), hmac_digits(F.concat(v, F.lit("b")), 2, k)),
}


def generate(dtype: Column | str, value: Column, key: bytes) -> Column:
    """A valid pseudonym of the type for a value that no table knows; a pure function of (type, value).

    An IBAN keeps its country, its length and whether it has spaces; a Swiss one gets an
    account that starts with 8. Types without a rule become [TYPE].
    """
    if isinstance(dtype, str):
        return GENERATORS[dtype](value, key) if dtype in GENERATORS else F.lit(f"[{dtype}]")
    out = F
    for name, make in GENERATORS.items():
        out = out.when(dtype == name, make(value, key))
    return out.otherwise(F.concat(F.lit("["), dtype, F.lit("]")))


def rotated_city(npa: Column, city: Column) -> Column:
    """The pool's city CITY_SHIFT places after (npa, city) as "npa city"; null if the pool lacks it."""
    pool = F.array(*[F.lit(f"{n} {c}") for n, c in CITIES])
    at = F.array_position(pool, F.concat(npa, F.lit(" "), city))
    return F.when(at > 0, F.element_at(pool, ((at - 1 + CITY_SHIFT) % len(CITIES) + 1).cast("int")))


def shifted_birth_date(d: Column) -> Column:
    """d moved by 40 to 319 days, by the MD5 of its ISO form, back or forth by that hash's ninth bit."""

    def moved(h: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substr(h, i * 4 + 1, F.lit(4)), 16, 10).cast("int"))
        days = 40 + F.aggregate(chunks, F.lit(0), lambda a, x: (a * 65536 + x) % 280)
        even = F.conv(F.substr(h, F.lit(30), F.lit(1)), 16, 10).cast("int") % 2 == 0
        return let(days, lambda n: F.date_add(d, F.when(even, n).otherwise(-n)))

    return let(F.md5(F.date_format(d, "yyyy-MM-dd").cast("binary")), moved)


def replaced_street(street: Column, originals: tuple[str, ...], replacements: tuple[str, ...]) -> Column:
    """"Name 12" with the name at the same place of the other pool, and the number times 7 modulo 120, plus 1."""
    name, number = F.regexp_extract(street, r"^(.*) (\S+)$", 1), F.regexp_extract(street, r"^(.*) (\S+)$", 2).cast("int")
    at = F.array_position(F.array(*[F.lit(x) for x in originals]), name)
    return F.when(at > 0, F.concat(F.element_at(F.array(*[F.lit(x) for x in replacements]), at.cast("int")), F.lit(" "), ((number * 7) % 120 + 1).cast("string")))
