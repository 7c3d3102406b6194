"""Text normalisation, checksums, formats and path rules as Column expressions.

Everything here is built-in Spark SQL, so it stays in the JVM. Positions and
lengths are in code points. Patterns carry (?U), so that classes are Unicode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values of the formats -------------------------------------------------

#: Identifier patterns by type, in the order in which they are tried.
PATTERNS = (
    ("IBAN", r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?\b"),
    ("AHV_NUMBER", r"\b756\.\d{4}\.\d{4}\.\d{2}\b"),
    ("INSURANCE_CARD_NUMBER", r"\b80756(?:[ ]?\d{5}){3}\b"),
    ("CREDIT_CARD", r"\b(?:\d{4}[ ]?){3}\d{4}\b|\b\d{4}[ ]?\d{6}[ ]?\d{5}\b"),
    ("PATIENT_ID", r"\bPAT-\d{4}-\d{5}\b"),
    ("EMAIL", r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b"),
    ("PHONE", r"(?:\+41 \d{2} \d{3} \d{2} \d{2}|\b0\d{2} \d{3} \d{2} \d{2}\b|\+33 \d \d{2} \d{2} \d{2} \d{2})"),
)
#: Runs that stand for removed text.
PLACEHOLDER = r"(?i)X{4,}|\*{4,}|\[(?:REDACTED|MASQU[ÉE]|SUPPRIM[ÉE])\]|#{4,}|_{5,}"
#: Types that are looked for between word boundaries.
WORD_TYPES = ("FIRST_NAME", "LAST_NAME", "STREET_ADDRESS", "POSTAL_CITY", "EMAIL", "MEDICATION", "DIAGNOSIS_LABEL", "DIAGNOSIS_ICD")
#: Digits that recognition software takes for letters, and tokens in which they are put right.
OCR_LETTERS, OCR_DIGITS = "OoQDIl|SZB", "0000111528"
OCR_NUMERIC = r"^[A-Z]{0,2}[0-9OoQDIl|SZB.\-]{2,}$"
MONTHS = {
    "fr": ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"),
    "de": ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"),
}
ACCENTED, PLAIN = "àâäéèêëîïôöùûüçÀÂÄÉÈÊËÎÏÔÖÙÛÜÇœŒ", "aaaeeeeiioouuucAAAEEEEIIOOUUUCoO"
EXTENSIONS = (".docx", ".xlsx", ".pdf", ".rtf", ".png", ".jpg", ".jpeg")
#: Fields of a message that may hold a file's path, from the most to the least specific.
PATH_KEYS = ("file_path", "resource_path", "resourcePath", "prefix_path", "object_path", "path", "full_path", "file_name", "displayName")


def unicode_pattern(pattern: str) -> str:
    return "(?U)" + pattern


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


# --- normal forms ------------------------------------------------------------------


def norm(s: Column) -> Column:
    """s without any white space; null is empty."""
    return F.regexp_replace(F.coalesce(s, F.lit("")), r"(?U)\s+", "")


def casefold(s: Column) -> Column:
    """Lower case with sharp s as ss and final sigma as sigma."""
    return F.replace(F.replace(F.lower(s), F.lit("ς"), F.lit("σ")), F.lit("ß"), F.lit("ss"))


def collapse(s: Column) -> Column:
    """Runs of white space as one space, case-folded."""
    return casefold(F.regexp_replace(F.coalesce(s, F.lit("")), r"(?U)\s+", " "))


def strip_accents(s: Column) -> Column:
    return F.translate(s, ACCENTED, PLAIN)


def escape_regex(s: Column) -> Column:
    return F.regexp_replace(s, r"([^\p{L}\p{N}_ ])", r"\\$1")


def is_upper(s: Column) -> Column:
    """Some cased character and none in lower case."""
    return (s == F.upper(s)) & (s != F.lower(s))


def numeric_like(s: Column) -> Column:
    return F.length(F.regexp_replace(s, r"[^\p{L}]", "")) <= 2


# --- checksums ---------------------------------------------------------------------


def _digits(s: Column) -> Column:
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: c.cast("int"))


def _mod97(s: Column) -> Column:
    """An alphanumeric string, letters as 10 to 35, modulo 97."""

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(F.upper(c))
        return F.when(code <= 57, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0), step)


def iban_check_digits(country: Column, bban: Column) -> Column:
    return F.lpad((98 - _mod97(F.concat(bban, country, F.lit("00")))).cast("string"), 2, "0")


def iban_is_valid(iban: Column) -> Column:
    """ISO 7064 modulo 97; 15 characters at least, two letters first. The country's own length isn't checked."""
    s = F.upper(F.replace(iban, F.lit(" "), F.lit("")))
    shaped = (F.length(s) >= 15) & s.rlike("^[A-Z]{2}[A-Z0-9]*$")
    return F.coalesce(F.when(shaped, _mod97(F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4)))) == 1), F.lit(False))


def groups_of(s: Column, n: int) -> Column:
    return F.rtrim(F.regexp_replace(F.replace(s, F.lit(" "), F.lit("")), f"(.{{{n}}})", "$1 "))


def iban_format(iban: Column) -> Column:
    return groups_of(iban, 4)


def ean13_check_digit(d12: Column) -> Column:
    weighted = F.zip_with(_digits(d12), F.array(*[F.lit(w) for w in (1, 3) * 6]), lambda d, w: d * w)
    return ((10 - F.aggregate(weighted, F.lit(0), lambda a, x: a + x) % 10) % 10).cast("string")


def ahv_is_valid(ahv: Column) -> Column:
    d = F.replace(ahv, F.lit("."), F.lit(""))
    return F.coalesce(F.when(d.rlike("^756[0-9]{10}$"), ean13_check_digit(F.substr(d, F.lit(1), F.lit(12))) == F.substr(d, F.lit(13))), F.lit(False))


def luhn_is_valid(number: Column) -> Column:
    d = F.reverse(F.replace(number, F.lit(" "), F.lit("")))
    doubled = F.transform(_digits(d), lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.coalesce(F.when(d.rlike("^[0-9]+$"), F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0), F.lit(False))


def card_context_free(before: Column) -> Column:
    """Whether the 8 characters before a card-shaped run don't make it part of an IBAN or of a longer number."""
    return ~(before.rlike(r"(?U)[A-Z]{2}\d{2}\s?$") | before.rlike(r"(?U)\d\s?$"))


def guess_type(v: Column) -> Column:
    """The first type whose pattern is the whole of v, else UNKNOWN."""
    out = F
    for dtype, p in PATTERNS:
        out = out.when(v.rlike(f"(?U)^(?:{p})$"), F.lit(dtype))
    return out.otherwise(F.lit("UNKNOWN"))


def iban_valid_with_tail(x: Column) -> Column:
    """iban_is_valid(), also without a last token of letters if there are more than two tokens."""
    tokens = F.split(F.trim(x), r"(?U)\s+")
    shorter = F.array_join(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(1))), " ")
    return iban_is_valid(x) | ((F.size(tokens) > 2) & F.element_at(tokens, -1).rlike(r"^\p{L}+$") & iban_is_valid(shorter))


# --- text from recognition software -------------------------------------------------


def ocr_normalize(line: Column) -> Column:
    """Letters put right to digits in tokens that are mostly digits; lengths stay."""

    def fixed(t: Column) -> Column:
        digits = F.length(F.regexp_replace(t, "[^0-9]", ""))
        head = F.when(F.substr(t, F.lit(1), F.lit(2)).rlike("^[A-Z]{2}"), 2).otherwise(0)
        repaired = F.concat(F.substr(t, F.lit(1), head), F.translate(F.substr(t, head + 1), OCR_LETTERS, OCR_DIGITS))
        return F.when(t.rlike(OCR_NUMERIC) & (digits >= F.greatest(F.lit(2), F.floor(F.length(t) / 3))), repaired).otherwise(t)

    return F.array_join(F.transform(F.split(line, " "), fixed), " ")


def distance(a: Column, b: Column, cap: int) -> Column:
    """Edit distance, cap + 1 where it is above cap."""
    d = F.levenshtein(a, b, cap)
    return F.when(d < 0, cap + 1).otherwise(d)


# --- evaluation ---------------------------------------------------------------------


def squeeze(s: Column) -> Column:
    """Case-folded without white space."""
    return casefold(norm(s))


EDGE = "\u0001"


def edged(s: Column) -> Column:
    """s with a mark wherever a word begins or ends, so that a search between marks is one between word boundaries."""
    return F.regexp_replace(F.replace(s, F.lit(EDGE), F.lit(" ")), r"(?U)\w+", f"{EDGE}$0{EDGE}")


def contains_prepared(folded: Column, squeezed: Column, edges: Column, value: Column, dtype: Column, is_ocr: Column) -> Column:
    """contains_value() on a haystack whose collapse(), squeeze() and edged(collapse()) are at hand.

    A value that begins and ends with a word is looked for between marks, by plain
    search; an expression with boundaries runs for other values only, and where the plain text is there.
    """
    found = collapse(value)
    bounded = F.regexp_like(folded, F.concat(F.lit(r"(?U)(?<![\w])"), escape_regex(found), F.lit(r"(?![\w])")))
    words = found.rlike(r"(?Us)^[\w](.*[\w])?$")
    whole = F.when(words, F.contains(edges, edged(found))).otherwise(F.contains(folded, found) & bounded)
    return F.when(dtype.isin(*WORD_TYPES) & ~is_ocr, whole).otherwise(F.contains(squeezed, squeeze(value)))


def contains_value(haystack: Column, value: Column, dtype: Column, is_ocr: Column) -> Column:
    """Whether value is in haystack: word types between word boundaries, others (and all recognised text) without regard to white space."""
    return contains_prepared(collapse(haystack), squeeze(haystack), edged(collapse(haystack)), value, dtype, is_ocr)


def placeholders(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(PLACEHOLDER))


# --- dates --------------------------------------------------------------------------


def date_text(d: Column, style: str) -> Column:
    if style == "dotted":
        return F.date_format(d, "dd.MM.yyyy")
    if style == "iso":
        return F.date_format(d, "yyyy-MM-dd")
    language = style.removeprefix("long_")
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS[language]]), F.month(d))
    return F.concat(F.dayofmonth(d).cast("string"), F.lit(" " if language == "fr" else ". "), month, F.lit(" "), F.year(d).cast("string"))


# --- paths and messages ---------------------------------------------------------------


def splitext(path: Column) -> Column:
    """Lower-case extension with its dot, of the last segment; leading dots make none."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(F.regexp_replace(base, r"^\.+", ""), r"(\.[^.]*)$", 1))


def inbound_rel(path: Column, inbound: str = "Inbound") -> Column:
    """What follows the first "/Inbound/", or a leading "Inbound/", or the file's name."""
    marker = f"/{inbound}/"
    at = F.locate(marker, path)
    return F.when(at > 0, F.substr(path, at + len(marker))).when(F.startswith(path, F.lit(inbound + "/")), F.substr(path, F.lit(len(inbound) + 2))).otherwise(F.element_at(F.split(path, "/"), -1))


def safe_rel(rel: Column) -> Column:
    """struct(ok, path, reason): slashes unified and trimmed; empty, dot and dot-dot segments and unknown extensions are refused."""
    path = F.regexp_replace(F.translate(F.coalesce(rel, F.lit("")), "\\", "/"), "^/+|/+$", "")
    bad = (path == "") | F.exists(F.split(path, "/"), lambda p: p.isin("", ".", ".."))
    reason = F.when(bad, "invalid file path").when(~splitext(path).isin(*EXTENSIONS), F.concat(F.lit("unsupported extension: "), splitext(path)))
    return F.struct(reason.isNull().alias("ok"), path.alias("path"), reason.alias("reason"))


def extract_path(message: Column) -> Column:
    """The first non-empty path field of a JSON object, by priority."""
    return F.coalesce(*[F.nullif(F.get_json_object(message, f"$.{k}"), F.lit("")) for k in PATH_KEYS])


def route(path: Column) -> Column:
    """The handler of a file: docx, xlsx, pdf, rtf, image or copy."""
    ext = splitext(path)
    return F.when(ext.isin(".png", ".jpg", ".jpeg"), "image").when(ext.isin(*EXTENSIONS), F.substr(ext, F.lit(2))).otherwise("copy")


def fingerprint(content: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)
