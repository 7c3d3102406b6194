"""Joins and searches whose cost must follow the tables: nothing exploded is broadcast, no text is searched once a value."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veilspark.functions import text as X
from veilspark.operators import candidates as CAND
from veilspark.operators import detect as D
from veilspark.operators import evaluate as E
from veilspark.operators import layout as L
from veilspark.plans import catalog, survey_queries  # noqa: F401

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["q_fuzzy_best", "q_leak_suspects"])
def test_deletions_are_not_broadcast(spark, name):
    assert "BroadcastExchange" not in plan(catalog.QUERIES[name](spark, SF))


def test_fuzzy_best_of_keys_and_near_keys(spark):
    table = spark.createDataFrame([("anna", "A"), ("annas", "B"), ("bert", "C"), ("bert", "D"), ("carl", "E")], "key string, replacement string")
    values = spark.createDataFrame([("anna",), ("ann",), ("annax",), ("bert",), ("berta",), ("car",), ("zz",), (None,)], "value string")
    got = {tuple(r) for r in L.fuzzy_best(values, table, 1).collect()}
    # annax is as near to anna as to annas; bert has two replacements
    assert got == {("anna", "anna", "A", 0), ("ann", "anna", "A", 1), ("car", "carl", "E", 1)}


def test_leak_suspects_by_stages(spark):
    found = spark.createDataFrame([("Anna Muster",), ("Anna Mustre CHF",), ("Anna Mxstyz",), ("Ann-Kathrin Keller",), ("Anx-Kathrin Kellex",), ("Anx-Kathrxn Kellex",), (None,)], "value string")
    known = spark.createDataFrame([("annamuster",), ("Anna-Mustre",), ("Ann-Kathrin Keller",)], "replacement string")
    assert sorted(r.value or "" for r in CAND.leak_suspects(found, known).collect()) == ["", "Anna Mxstyz", "Anx-Kathrxn Kellex"]


@pytest.mark.parametrize("name", ["q_leaks_by_type", "q_leak_list", "q_leaks_by_document", "q_coherence", "q_verdict"])
def test_ground_truth_does_not_copy_documents(spark, name):
    p = plan(catalog.QUERIES[name](spark, SF))
    # each text is cut into pieces once; no ground truth row carries a text
    assert "regexp_extract_all(piece" in p and "contains(edges" not in p


CASES = ["anna", "Anna", "ANNA  muster", "a", "", " ", "C++", "+41", "anna-", "-", "ß", "SS", "annamuster", "x.y", "end", "[a", "\\E", "Zoë 1", "mu", "r\u0001s", "very " * 300 + "long", "😀b", "long very", None]
TEXTS = ["Anna Muster, annas C++ and C+++ x.yz [a] \\E Straße SS end", "", " ", "é" * 2047 + " anna", "o" * 2046 + "-anna muster", "very " * 2000 + "long end", "q" * 5000 + "anna😀b C++" + "z" * 2039 + "C++ Zoë\n1 r\u0001s", "C++", "anna" * 1500]


def test_occurring_equals_contains(spark):
    truth = spark.createDataFrame(
        [(f"{i}-{j}-{t}-{k}", str(i), k, "", "", "", "", "", t, v, "plain", "PSEUDONYMIZE", "C++", "") for i in range(len(TEXTS)) for j, v in enumerate(CASES) for t in ("LAST_NAME", "IBAN") for k in ("text", "image")],
        "gt_id string, document string, location_type string, page string, sheet string, cell string, paragraph string, section string, data_type string, value string, variant string, expected_action string, expected_replacement string, strict_replacement string",
    )
    outputs = spark.createDataFrame([(str(i), x, x) for i, x in enumerate(TEXTS)], "document string, text string, image_text string").selectExpr("document", "text", "cast(null as array<string>) pages", "cast(null as map<string,string>) locs", "image_text", "cast(null as map<int,string>) page_ocr", "cast(null as string) embedded_text")
    has = lambda c: X.contains_value(F.col("scope"), F.col(c), F.col("data_type"), F.col("is_ocr"))
    want = {r.gt_id: (r.leaked, r.replaced) for r in E.scoped(truth, outputs).select("gt_id", has("value").alias("leaked"), has("expected_replacement").alias("replaced")).collect()}
    got = {r.gt_id: (r.leaked, r.replaced) for r in E.judged(truth, outputs).collect()}
    assert {k: (got[k], v) for k, v in want.items() if got[k] != v} == {} and len(got) == len(want)
    assert 0 < sum(a for a, _ in got.values()) < len(got)


def test_decoys_of_odd_texts(spark):
    outputs = spark.createDataFrame([("a", "Ann a Ch12 34X"), ("b", None), ("c", "")], "document string, text string")
    decoys = spark.createDataFrame([("a", "CH1234"), ("a", "nnac"), ("a", "ch12 35"), ("a", " "), ("a", ""), ("b", "x"), ("b", "\t"), ("c", "y"), ("c", "y"), ("d", "z"), ("a", None)], "document string, value string")
    assert {r.document: tuple(r)[1:] for r in E.decoys_modified(outputs, decoys).collect()} == {"a": (4, 1), "b": (2, 1), "c": (2, 2)}
    assert {r.document: r[1] for r in E.decoy_examples(outputs, decoys).collect()} == {"a": ["ch12 35"], "b": ["x"], "c": ["y", "y"]}


def test_decoys_are_not_joined_with_whole_texts(spark):
    assert "regexp_extract_all(piece" in plan(catalog.q_decoys(spark, SF)) and "regexp_extract_all(piece" in plan(catalog.QUERIES["q_decoy_examples"](spark, SF))


def test_dictionary_tokens_are_not_broadcast(spark):
    texts = spark.createDataFrame([(1, "Anna Muster, Anna")], "row_id long, text string")
    found = D.token_join_spans(texts, spark.createDataFrame([("Anna",), ("Muster",)], "key string"))
    assert "BroadcastExchange" not in plan(found) and [s.value for s in found.first().spans] == ["Anna", "Muster", "Anna"]


def test_trusted_words_are_dealt_once(spark):
    p = plan(catalog.QUERIES["q_trusted_words"](spark, SF))
    # documents by their id, and no word after that
    assert p.count("Exchange") == 1 and "Join" not in p


def test_trusted_words_against_a_loop(spark):
    r = random.Random(8)
    words = []
    for i in range(400):
        x, y = r.randrange(-80, 300), r.randrange(-40, 140)
        w, h = (r.randrange(0, 400), r.randrange(0, 90)) if i % 10 == 0 else (r.randrange(10, 60), r.randrange(8, 16))
        words.append((r.choice("fg"), r.choice((1, 2, 3)), i, x, y, x + w, y + h, float(r.choice((20, 40, 60, 90))), r.choice(("ab", "AB", "abc", "a b", "abcd", "ß", "a"))))
        if i % 2:
            f, _, _, x, y, u, v, _, t = words[-1]
            words.append((f, r.choice((1, 2, 3)), 1000 + i, x + r.randrange(-9, 9), y + r.randrange(-4, 4), u + r.randrange(9), v, 50.0, t))
    words += [("f", 1, 2000, None, 1, 5, 5, 90.0, "ab"), ("f", 2, 2001, None, 1, 5, 5, 50.0, "ab"), (None, 1, 2002, 1, 1, 5, 5, 90.0, "ab"), (None, 2, 2003, 1, 1, 5, 5, 50.0, "ab")]
    fold = lambda t: t.lower().replace(" ", "").replace("ß", "ss")
    # the texts are such that one edit is a length of one more, or the same text
    alike = lambda s, t: s == t or s[:-1] == t or t[:-1] == s
    usable = [w for w in words if w[7] >= 30 and len(w[8]) >= 2]
    area = lambda a, b: max(0, min(a[5], b[5]) - max(a[3], b[3])) * max(0, min(a[6], b[6]) - max(a[4], b[4]))
    met = lambda a: any(a[0] == b[0] and a[1] != b[1] and area(a, b) > 0.5 * (a[5] - a[3]) * (a[6] - a[4]) and alike(fold(a[8]), fold(b[8])) for b in usable if None not in b)
    want = sorted(a[2] for a in usable if a[7] >= 75 or None not in a and met(a))
    got = L.trusted_words(spark.createDataFrame(words, "file string, pass int, word_id int, x0 int, y0 int, x1 int, y1 int, conf double, text string"))
    assert sorted(x.word_id for x in got.collect()) == want and 0 < len(want) < len(usable) and len([a for a in usable if a[7] < 75 and a[2] in want]) > 20


def test_needles_are_made_once(spark):
    rows = catalog.QUERIES["q_leaks_grouping_sets"](spark, SF)
    assert rows.collect()
    final = plan(rows).split("== Initial Plan ==")[0]
    # the pattern side, the join and the long needles read one exchange
    assert final.count("explode(array(there_key") == 1


@pytest.mark.parametrize("name", ["q_leak_list", "q_leaks_by_document", "q_leaks_grouping_sets", "q_verdict", "q_decoy_examples", "q_coherence"])
def test_identities_are_not_made_by_the_task_that_reads(spark, name):
    # customers of a file with one row group are dealt before their check digits are made
    p = plan(catalog.QUERIES[name](spark, SF))
    assert "hashpartitioning(c_custkey" in p


@pytest.mark.parametrize("name", ["q_leaks_by_document", "q_leaks_grouping_sets", "q_verdict", "q_decoy_examples", "q_coherence"])
def test_needles_are_not_dealt(spark, name):
    # only lengths, heads and needles too long for windows are gathered; windows meet the rows themselves
    p = plan(catalog.QUERIES[name](spark, SF))
    assert re.search(r"hashpartitioning\(sid#\w+, mode#\w+, size#\w+, head#\w+, needle#|hashpartitioning\(sid#\w+, size#\w+, head#\w+, needle#", p)
    assert not re.search(r"hashpartitioning\((sid|document)#\w+, (mode#\w+, )?needle#", p)


@pytest.mark.parametrize("name", ["q_verdict", "q_coherence"])
def test_replacements_are_looked_for_only_if_asked_for(spark, name):
    assert "swapped" not in plan(catalog.QUERIES[name](spark, SF))


def test_leaks_by_document_go_through_the_rows_once(spark):
    joins = lambda name: plan(catalog.QUERIES[name](spark, SF)).count("SortMergeJoin")
    assert joins("q_leaks_by_document") == joins("q_leaks_grouping_sets")


def test_leaks_by_document_against_a_loop(spark):
    r = random.Random(9)
    rows = [(r.choice("abc") if i % 7 else None, f"{r.randrange(10**6):06}", r.choice(("IBAN", "EMAIL")), None if i % 31 == 0 else f"v{i}", r.choice((True, True, False, None)), r.choice(("text", "image"))) for i in range(900)]
    rows += [("few", "9", "IBAN", "x", True, "text"), ("few", None, "IBAN", "y", True, "text"), ("none", "1", "IBAN", "z", False, "text")]
    df = spark.createDataFrame(rows, "document string, gt_id string, data_type string, value string, leaked boolean, location_type string")
    df = df.selectExpr("*", "coalesce(leaked, false) must_hide", "false replaced", "true present", "not leaked kept")
    want = {}
    for doc in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == doc]
        first = sorted((x for x in own if x[4]), key=lambda x: (x[1] is not None, x[1] or "", x[2], x[3] or ""))[: E.LEAK_EXAMPLES]
        want[doc] = (sum(x[4] is True for x in own), sum(x[4] is True and x[5] == "image" for x in own), "; ".join(" ".join(v for v in x[1:4] if v is not None) for x in first))
    got = {x.document: (x.leaked, x.image_leaked, x.leak_examples) for x in E.by_document(df).collect()}
    assert got == want and max(x[0] for x in want.values()) > 5 * E.LEAK_EXAMPLES


def test_coherence_of_odd_rows(spark):
    kind = "document string, value string, section string, location_type string, expected_action string, present boolean, leaked boolean"
    hide = "PSEUDONYMIZE"
    rows = [("a", "v", "s", "text", hide, True, True), ("a", "v", "", "image", hide, True, True), ("a", "v", None, "image", hide, True, False), ("a", "one", "s", "text", hide, True, True), ("a", "one", "s", "image", hide, True, True)]
    rows += [("a", "kept", "s", "text", hide, True, True), ("a", "kept", "t", "text", "KEEP", True, False), ("a", None, "s", "text", hide, True, True), ("a", None, "t", "text", hide, True, True)]
    rows += [("b", "v", "s", "text", hide, True, False), ("b", "v", "t", "text", hide, True, None), ("c", "v", "s", "text", hide, False, True), ("c", "v", "t", "text", hide, False, True), ("d", "v", "s", "text", hide, True, True)]
    assert {tuple(r) for r in E.coherence(spark.createDataFrame(rows, kind)).collect()} == {("a", 2, 2), ("b", 1, 0)}


def test_edges_and_folds_of_odd_texts(spark):
    df = spark.createDataFrame([(v,) for v in [*CASES, *TEXTS, "ΑΣ ς", "a\u0301b", "x\u0001y", "$0 \\1", "ß_1-é", "\u200db"]], "t string")
    old = F.regexp_replace(F.translate("t", "\u0001", " "), r"(?U)(?<![\w])(?=[\w])|(?<=[\w])(?![\w])", "\u0001")
    fold = F.replace(F.translate(F.lower("t"), "ς", "σ"), F.lit("ß"), F.lit("ss"))
    assert df.where(~X.edged(F.col("t")).eqNullSafe(old) | ~X.casefold(F.col("t")).eqNullSafe(fold)).count() == 0


def test_decoys_meet_their_documents_after_the_search(spark):
    # only modified decoys are dealt by document, not all of them ahead of the search
    p = plan(catalog.QUERIES["q_decoy_examples"](spark, SF))
    assert re.search(r"Join \[document#\w+\], \[document#\w+\], LeftSemi", p) and not re.search(r"Join \[document#\w+\], \[document#\w+\], Inner", p)
