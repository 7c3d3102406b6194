import random

from pyspark.sql import functions as F

from veilspark.operators import evaluate as E
from veilspark.operators import layout as L


def test_suppression_against_a_loop(spark):
    r = random.Random(1)
    boxes = [(x, y, x + r.randrange(1, 30), y + r.randrange(1, 20)) for x, y in ((r.randrange(60), r.randrange(40)) for _ in range(40))]
    kept = []
    for b in boxes:
        area = lambda d, b=b: max(0, min(b[2], d[2]) - max(b[0], d[0])) * max(0, min(b[3], d[3]) - max(b[1], d[1]))
        if not any(area(d) > 0.5 * (b[2] - b[0]) * (b[3] - b[1]) for d in kept):
            kept.append(b)
    df = spark.createDataFrame([(boxes,)], "b array<struct<x0:int,y0:int,x1:int,y1:int>>")
    assert [tuple(x) for x in df.select(L.suppressed(F.col("b")).alias("k")).head().k] == kept


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_best_is_exact(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abc") for _ in range(n))
    table = sorted({(word(r.randrange(0, 7)), f"r{k % 5}") for k in range(40)})
    values = sorted({word(r.randrange(0, 8)) for _ in range(60)})
    for cap in (0, 1, 2):
        want = set()
        for v in values:
            d = sorted((levenshtein(v, k), k, rep) for k, rep in table)
            if d[0][0] <= cap and d[1][0] > d[0][0]:
                want.add((v, d[0][1], d[0][2], d[0][0]))
        got = L.fuzzy_best(spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame(table, "key string, replacement string"), cap)
        assert {tuple(x) for x in got.collect()} == want


def test_lines_and_boxes(spark):
    words = spark.createDataFrame([("f", 1, 10, 5, 20, 8, 90.0, "Anne"), ("f", 1, 40, 4, 30, 9, 50.0, "Weber"), ("f", 2, 0, 20, 10, 8, 80.0, "x")], "file string, line int, x int, y int, w int, h int, conf double, text string")
    off = L.word_offsets(words)
    assert {(r.text, r.s, r.e) for r in off.collect()} == {("Anne", 0, 4), ("Weber", 5, 10), ("x", 0, 1)}
    spans = spark.createDataFrame([("f", 1, 7, 2, 7), ("f", 1, 8, 5, 10)], "file string, line int, span_id int, s int, e int")
    assert {tuple(r)[2:] for r in L.span_boxes(spans, off).collect()} == {(7, 10, 4, 70, 13, 50.0), (8, 40, 4, 70, 13, 50.0)}
    assert {(r.line, r.text) for r in L.line_texts(words).collect()} == {(1, "Anne Weber"), (2, "x")}
    covered = spark.createDataFrame([("f", 1, 0, 3)], "file string, line int, s int, e int")
    assert [r.span_id for r in L.uncovered(spans, covered).collect()] == [8]


def test_first_match_prefers_single_lines(spark):
    rows = spark.createDataFrame([("f", 1, 4, 2, 10.2, 5.1, "v"), ("f", 1, 5, 1, 10.4, 5.0, "v"), ("f", 1, 5, 1, 90.0, 5.0, "v")], "file string, page int, line int, n int, x0 double, y0 double, value string")
    assert sorted((r.n, r.x0) for r in L.first_match(rows).collect()) == [(1, 10.4), (1, 90.0)]


def test_snapped_and_trusted(spark):
    clusters = spark.createDataFrame([("i", 1, 20, False), ("i", 2, 25, True), ("i", 3, 40, True), ("i", 4, 24, False)], "image string, cluster int, median int, numeric boolean")
    assert {(r.cluster, r["size"]) for r in L.snapped_numeric(clusters).collect()} == {(1, 20), (2, 24), (3, 40), (4, 24)}
    words = spark.createDataFrame([("f", 1, 1, 0, 0, 10, 10, 90.0, "abc"), ("f", 2, 2, 1, 0, 10, 10, 40.0, "ABD"), ("f", 2, 5, 80, 0, 90, 10, 40.0, "scrawl"), ("f", 1, 6, 80, 0, 90, 10, 20.0, "scrawl"), ("f", 1, 3, 50, 0, 60, 10, 90.0, "zzz"), ("f", 2, 4, 50, 0, 60, 10, 90.0, "qqq")], "file string, pass int, word_id int, x0 int, y0 int, x1 int, y1 int, conf double, text string")
    assert sorted(r.word_id for r in L.trusted_words(words).collect()) == [1, 2, 3, 4]


def test_loose_shapes(spark):
    df = spark.createDataFrame([("pay CH93 0076 2011 6238 5295 8 now, XX93 0076 2011 6238 5295, 756.456 1.4552.33 end",)], "t string")
    r = df.select(L.loose_ibans(F.col("t")).alias("i"), L.loose_ahv(F.col("t")).alias("a")).head()
    assert r.i and r.i[0].startswith("CH93 0076") and len(r.i) == 1 and r.a == ["756.4561.4552.33"]


def test_missing_documents_leak(spark):
    truth = spark.createDataFrame([("1", "a", "text", "", "", "", "", "", "LAST_NAME", "Weber", "", "PSEUDONYMIZE", "Wyss", ""), ("2", "b", "image", "", "", "", "", "", "IBAN", "CH1", "", "PSEUDONYMIZE", "CH2", ""), ("3", "b", "text", "", "", "", "", "", "MEDICATION", "Aspirin", "", "KEEP", "", "[M]")], "gt_id string, document string, location_type string, page string, sheet string, cell string, paragraph string, section string, data_type string, value string, variant string, expected_action string, expected_replacement string, strict_replacement string")
    outputs = spark.createDataFrame([("a", "Mr Wyss", None, None, "", None, "")], "document string, text string, pages array<string>, locs map<string,string>, image_text string, page_ocr map<int,string>, embedded_text string")
    rows = E.judged(truth, outputs)
    assert {(r.gt_id, r.must_hide, r.leaked, r.replaced, r.kept) for r in rows.collect()} == {("1", True, False, True, False), ("2", True, True, False, False), ("3", False, False, False, False)}
    assert E.leaks(rows).count() == 1
    v = E.verdict(rows, spark.createDataFrame([(0,)], "decoys_modified int")).head()
    assert (v.leaks, v.absent, v.passed) == (1, 1, False)


def test_examples_and_integrity(spark):
    outputs = spark.createDataFrame([("a", "Keep K1 only"), ("b", "x")], "document string, text string")
    decoys = spark.createDataFrame([("a", "K 1", 0), ("a", "", 1), *(("a", f"D{k:02}", 20 - k) for k in range(12)), ("b", "X", 1), ("c", "y", 1)], "document string, value string, decoy_id int")
    got = {r.document: r.decoys_modified_examples for r in E.decoy_examples(outputs, decoys, order="decoy_id").collect()}
    assert got == {"a": [f"D{k:02}" for k in range(11, 1, -1)]}
    truth = [(f"{k:02}", "a", place, section, f"v{k // 2}", "PSEUDONYMIZE") for k in range(16) for place, section in [("text", "") if k % 2 else ("image", "header")]]
    truth = spark.createDataFrame([*truth, ("90", "a", "text", "", "one", "PSEUDONYMIZE"), ("91", "z", "text", "", "v", "PSEUDONYMIZE"), ("92", "z", "cell", "", "v", "PSEUDONYMIZE")], "gt_id string, document string, location_type string, section string, value string, expected_action string")
    rows = truth.withColumn("present", F.col("document") == "a")
    assert sorted(tuple(r) for r in E.surface_examples(truth, rows).collect()) == [("a", f"v{k}", ["header", "text"]) for k in range(6)]
    kind = "document string, text string, pages array<string>, stats map<string,long>"
    before = spark.createDataFrame([("a", "x" * 1000, ["p", "q"], {"pages": 2, "images": 1}), ("b", None, None, {"sheets": 3})], kind)
    after = spark.createDataFrame([("a", "x" * 985, ["p"], {"pages": 1, "images": 1}), ("b", "xy", None, {"sheets": 3}), ("c", "n", ["p"], {"pages": 1})], kind)
    assert sorted(tuple(r) for r in E.integrity(before, after).collect()) == [("a", {"pages": 1, "images": 1}, {"pages": 2, "images": 1}, 0.985, False), ("b", {"sheets": 3}, {"sheets": 3}, 2.0, None), ("c", {"pages": 1}, None, None, None)]


def test_upper_median_and_fidelity(spark):
    df = spark.createDataFrame([([3, 1, 2],), ([4, 1, 2, 3],), ([5],)], "v array<int>")
    assert [r.m for r in df.select(E.upper_median(F.col("v")).alias("m")).collect()] == [2, 3, 5]
    bag = lambda s: spark.createDataFrame([(t,) for t in s.split()], "token string")
    bags = E.token_bags(bag("a a b c"), bag("a c d d"))
    assert {tuple(r) for r in bags.collect()} == {("missing", "a", 1), ("missing", "b", 1), ("added", "d", 2)}
    assert E.fidelity_examples(bags, 1).count() == 2


def test_run_and_log_summaries(spark):
    files = spark.createDataFrame([("a", [("T", "o", "r")], [([1, 2],), ([3],)], 1.5)], "path string, log array<struct<type:string,original:string,replacement:string>>, images array<struct<replacements:array<int>>>, seconds double")
    assert tuple(E.run_summary(files).head()) == ("a", 1, 3, 1.5)
    found = spark.createDataFrame([("d", "x"), ("d", "y")], "document string, name string")
    logged = spark.createDataFrame([("d", "x", "processed")], "document string, name string, status string")
    assert {(r.name, r.status) for r in E.embedded_against_log(found, logged).collect()} == {("x", "processed"), ("y", "not logged")}


def test_visual_lines_against_a_loop(spark):
    r = random.Random(6)
    for n in (0, 1, 2, 30):
        boxes = [(y, y + r.randrange(1, 15), r.randrange(200)) for y in (r.randrange(80) for _ in range(n))]
        lines = []
        for b in sorted(boxes, key=lambda b: (b[0] + b[1], b[2])):
            for line in lines:
                a = line[-1]
                if (min(a[1], b[1]) - max(a[0], b[0])) / max(1, min(a[1] - a[0], b[1] - b[0])) >= 0.6:
                    line.append(b)
                    break
            else:
                lines.append([b])
        df = spark.createDataFrame([(boxes,)], "b array<struct<y0:int,y1:int,x0:int>>")
        got = df.select(L.visual_lines(F.col("b")).alias("k")).head().k
        assert [[b.x0 for b in line] for line in got] == [sorted(b[2] for b in line) for line in lines]


def test_run_growth_against_a_loop(spark):
    r = random.Random(7)
    words = [(i, x, r.randrange(0, 300), x + r.randrange(5, 40)) for i, x in ((i, r.randrange(600)) for i in range(120))]
    words = [(i, x0, y, x1, y + r.randrange(8, 14)) for i, x0, y, x1 in words]
    boxes = [(k, *w[1:]) for k, w in enumerate(words[::9])]
    want = set()
    for k, x0, y0, x1, y1 in boxes:
        reach = max(12, 1.2 * (y1 - y0))
        rest = [w for w in words if (min(y1, w[4]) - max(y0, w[2])) / max(1, min(y1 - y0, w[4] - w[2])) >= 0.6]
        lo, hi, run, grown = x0, x1, [], True
        while grown:
            near = [w for w in rest if w[3] >= lo - reach and w[1] <= hi + reach]
            rest, grown = [w for w in rest if w not in near], bool(near)
            run += near
            lo, hi = min([lo, *[w[1] for w in near]]), max([hi, *[w[3] for w in near]])
        want |= {(k, w[0]) for w in run if not (w[3] > x0 + 2 and w[1] < x1 - 2)}
    df = lambda rows, name: spark.createDataFrame([("f", *x) for x in rows], f"file string, {name} int, x0 int, y0 int, x1 int, y1 int")
    assert {(x.box_id, x.word_id) for x in L.run_growth(df(boxes, "box_id"), df(words, "word_id")).collect()} == want and want


def test_chain_layout(spark):
    """Items that grow push the ones after them; a chain beyond its space is set smaller as a whole."""
    items = spark.createDataFrame([("f", 1, 1, 0, 40, 60, 500), ("f", 1, 2, 50, 80, 30, 500), ("f", 1, 3, 200, 240, 10, 500), ("f", 2, 4, 100, 140, 90, 190), ("f", 2, 5, 150, 180, 80, 190)], "file string, chain int, item_id int, x0 int, x1 int, width int, free int")
    got = {r.item_id: (round(r.x, 3), round(r.scale, 3)) for r in L.chain_layout(items).collect()}
    assert got == {1: (0.0, 1.0), 2: (70.0, 1.0), 3: (220.0, 1.0), 4: (100.0, 0.5), 5: (150.0, 0.5)}
