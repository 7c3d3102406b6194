"""Detection, resolution and masking against a plain-Python version."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspark.functions import text as X
from veilspark.operators import detect as D
from veilspark.operators import mapping as M
from veilspark.operators import mask as MASK

KEY = b"test"
PLAIN = [(n, re.compile(p.replace("(?i)", ""), re.I if "(?i)" in p else 0)) for n, p in X.PATTERNS]


def luhn(s):
    d = [int(c) for c in s.replace(" ", "")]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0


def iban(s):
    s = s.replace(" ", "").upper()
    return len(s) >= 15 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def ahv(s):
    d = [int(c) for c in s.replace(".", "")]
    return (10 - sum(x * (1, 3)[i % 2] for i, x in enumerate(d[:12]))) % 10 == d[12]


def brute(text):
    found = []
    for rank, (name, p) in enumerate(PLAIN, 1):
        for m in p.finditer(text):
            v, before = m[0], text[max(0, m.start() - 8) : m.start()]
            if {"IBAN": iban, "AHV_NUMBER": ahv, "CREDIT_CARD": luhn}.get(name, lambda _: True)(v) and not (name == "CREDIT_CARD" and re.search(r"[A-Z]{2}\d{2}\s?$|\d\s?$", before)):
                found.append((m.start(), -m.end(), rank, name, v))
    out, at = [], -1
    for s, e, _, name, v in sorted(found):
        if s >= at:
            out.append((s, -e, name, v))
            at = -e
    return out


PARTS = ["CH93 0076 2011 6238 5295 7", "CH9300762011623852957", "CH53 8555 2479 4873 5989 5", "756.9217.0769.85", "756.1234.5678.90", "4242 4242 4242 4242", "3782 822463 10005", "PAT-2026-12345", "a.b@c.org", "+41 79 123 45 67", "021 345 67 89", "80756 00000 11111 22222", "FA-2026-10100", "3.9-5.8", "é", " ", "  ", "x", "1", "CHF", "\u0001", ".", "@", "\n"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=9).map("".join), min_size=40, max_size=40))
def test_pattern_spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = df.select("i", D.resolve(D.pattern_spans(F.col("text"))).alias("s")).orderBy("i").collect()
    for r, t in zip(got, texts):
        assert [(s.s, s.e, s.dtype, s.value) for s in r.s] == brute(t), t


def test_masked_values_are_gone_and_the_rest_stays(spark):
    text = "Pay CH93 0076 2011 6238 5295 7 or 4242 4242 4242 4242; decoys CH53 8555 2479 4873 5989 5, 756.1234.5678.90, FA-2026-10100; write a.b@c.org."
    r = MASK.mask_patterns(spark.createDataFrame([(text,), (None,), ("plain",)], "text string"), KEY).collect()
    assert "CH93" not in r[0].masked and "4242" not in r[0].masked and "a.b@c.org" not in r[0].masked
    assert all(x in r[0].masked for x in ("CH53 8555 2479 4873 5989 5", "756.1234.5678.90", "FA-2026-10100", "Pay ", "; decoys "))
    assert r[1].masked is None and r[1].spans == [] and r[2].masked == "plain"


TABLE = [("LAST_NAME", "Weber", "Keller", 1), ("LAST_NAME", "Weber", "Wyss", 2), ("FIRST_NAME", "Anne-Sophie", "Clara", 3), ("STREET_ADDRESS", "Rue des Trois-Sapins 4", "Hügelweg 29", 4), ("IBAN", "CH93 0076 2011 6238 5295 7", "CH00 1111 2222 3333 4444 5", 5), ("LAST_NAME", "Anne", "Lea", 6), ("EMAIL", "x.y@z.ch", "contact@example.org", 7), ("LAST_NAME", "ab", "zz", 8), ("LAST_NAME", "Müller", "Tanner", 9)]
TEXTS = [
    ("WEBER and Weber, Weber. .Weber @Weber Weber@ Weberin", "WEBER and Wyss, Wyss. .Weber @Weber Weber@ Weberin"),
    ("Anne-Sophie, Anne and Annette", "Clara, Lea and Annette"),
    ("at Rue des Trois-Sapins 4, CH93 0076 2011 6238 5295 7 / CH9300762011623852957", "at Hügelweg 29, CH00 1111 2222 3333 4444 5 / CH0011112222333344445"),
    ("ab Müller Müllerin x.y@z.ch", "ab Tanner Müllerin contact@example.org"),
    ("", ""), (None, None), ("Weber" * 3, "Weber" * 3),
]


@pytest.mark.parametrize("regex_keys", [500, 0])
def test_dictionary(spark, regex_keys):
    table = spark.createDataFrame(TABLE, "data_type string, original_value string, replacement_value string, line int")
    texts = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "row_id int, text string")
    got = {r.row_id: r for r in MASK.mask(texts, table, KEY, regex_keys=regex_keys).collect()}
    assert {i: r.masked for i, r in got.items()} == {i: m for i, (_, m) in enumerate(TEXTS)}
    assert [x.original for x in got[1].log] == ["Anne-Sophie", "Anne"] and got[5].log == []


def test_dictionary_paths_agree(spark):
    r = random.Random(2)
    keys = ["".join(r.choice("ab-.' é@") for _ in range(r.randrange(3, 7))) for _ in range(60)]
    texts = [(i, "".join(r.choice([*keys, " ", "a", ".", "@", ", "]) for _ in range(12))) for i in range(80)]
    df, kd = spark.createDataFrame(texts, "row_id int, text string"), spark.createDataFrame([(k,) for k in keys if re.search(r"\w", k)], "key string")
    by = [{x.row_id: [(s.s, s.e, s.value) for s in x.spans] for x in D.dictionary_spans(df, kd, n).collect()} for n in (500, 0)]
    assert by[0] == by[1]


def test_keys_of_marks_alone_on_both_paths(spark):
    r = random.Random(5)
    keys = sorted({"---", "+++", "-+-+", "a--", "é-- b", "...", "@--", *("".join(r.choice("-+. ") for _ in range(r.randrange(3, 6))) for _ in range(20))})
    texts = [(0, "x --- y"), (1, "a-----"), (2, "+++++++"), (3, "b---"), (4, "---b"), (5, ""), *((i, "".join(r.choice([*keys, "a", "é", " ", "@", "-"]) for _ in range(8))) for i in range(6, 80))]
    df, kd = spark.createDataFrame(texts, "row_id int, text string"), spark.createDataFrame([(k,) for k in keys], "key string")
    by = [{x.row_id: [(s.s, s.e, s.value) for s in x.spans] for x in D.dictionary_spans(df, kd, n).collect()} for n in (500, 0)]
    assert by[0] == by[1] and any(v == "---" for _, _, v in by[1][0])


def test_upper_case_names(spark):
    table = spark.createDataFrame([("LAST_NAME", "WEBER", "Keller", 1), ("IBAN", "ABCD", "xy", 2)], "data_type string, original_value string, replacement_value string, line int")
    texts = spark.createDataFrame([(1, "WEBER ABCD")], "row_id int, text string")
    assert MASK.mask(texts, table, KEY).head().masked == "KELLER xy"


@pytest.mark.parametrize("use_strict", [True, False])
def test_strict_and_evidence(spark, use_strict):
    table = spark.createDataFrame([("LAST_NAME", "Weber", "Wyss", 1)], "data_type string, original_value string, replacement_value string, line int")
    strict = spark.createDataFrame([("Asthme", "DIAGNOSIS_LABEL", "KEEP", "J00-J99"), ("Weber", "LAST_NAME", "PSEUDONYMIZE", "no")], "value string, data_type string, expected_action string, strict_replacement string")
    evidence = M.evidence_values(spark.createDataFrame([(" weird value ",), ("xy",), ("a@b.ch",)], "Detection string"))
    texts = spark.createDataFrame([(1, "Weber: Asthme, weird value, a@b.ch, xy")], "row_id int, text string")
    got = MASK.mask(texts, table, KEY, strict=strict, use_strict=use_strict, evidence=evidence).head()
    assert got.masked.startswith("Wyss: J00-J99, [UNKNOWN], contact." if use_strict else "Wyss: Asthme, [UNKNOWN], contact.") and got.masked.endswith("@example.org, xy")


def test_simultaneous_replacement(spark):
    """A replacement that is itself a key isn't replaced again."""
    table = spark.createDataFrame([("POSTAL_CITY", "1201 Genève", "1400 Yverdon", 1), ("POSTAL_CITY", "1400 Yverdon", "1700 Fribourg", 2)], "data_type string, original_value string, replacement_value string, line int")
    texts = spark.createDataFrame([(1, "1201 Genève, 1400 Yverdon")], "row_id int, text string")
    assert MASK.mask(texts, table, KEY).head().masked == "1400 Yverdon, 1700 Fribourg"


def test_mapping_tables(spark):
    rows = spark.createDataFrame([("A", "X y", "1", 1), ("B", "xY", "2", 2), ("A", "X y", "3", 3)], "data_type string, original_value string, replacement_value string, line int")
    assert {tuple(r) for r in M.exact_table(rows, "line").collect()} == {("A", "X y", "3"), ("B", "xY", "2")}
    assert [tuple(r) for r in M.normalized_table(rows, "line").collect()] == [("xy", "A", "3")]
    got = M.generated_rows(spark.createDataFrame([('{"K1": "v1", "K2": "v2"}',), (None,)], "json string")).collect()
    assert {tuple(r) for r in got} == {("K1", "v1"), ("K2", "v2")}
