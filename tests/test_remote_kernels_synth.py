import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.functions import kernels as N
from veilspark.functions import messages as MSG
from veilspark.functions import text as X
from veilspark.operators import candidates as C
from veilspark.plans import synth
from veilspark.sources import remote as R

TREE = {"Inbound": [{"name": "a.docx", "size": 3}, {"name": "sub", "folder": {}}, {"name": "b.pdf", "size": 2}], "Inbound/sub": [{"name": "c.docx", "size": 4}, {"name": "deep", "folder": {}}], "Inbound/sub/deep": [{"name": "d.rtf", "size": 1}]}


def call(method, url, headers, body):
    """A store with pages of two items."""
    assert headers["Authorization"] == "Bearer t"
    if url.endswith("/sites/host"):
        return R.Response(200, {"id": "S"})
    if url.endswith("/sites/S/drives"):
        return R.Response(200, {"value": [{"name": "Other", "id": "O"}, {"name": "Documents", "id": "D"}]})
    path = url.split("root:/", 1)[1]
    if "children" in path:
        folder, _, page = path.partition(":/children")
        at = int(page.partition("?skip=")[2] or 0)
        items = TREE[folder]
        more = {"@odata.nextLink": f"{url.partition('?')[0]}?skip={at + 2}"} if at + 2 < len(items) else {}
        return R.Response(200, {"value": items[at : at + 2]} | more)
    if path.endswith(":/content"):
        return R.Response(200, path.encode())
    return R.Response(404)


def opened():
    return R.Drive("http://x", call, lambda: "t", wait=lambda s: None).open("host")


def test_listing_and_download(spark):
    drive = opened()
    assert sorted(p for p, _ in drive.files("Inbound")) == ["a.docx", "b.pdf", "sub/c.docx", "sub/deep/d.rtf"]
    assert drive.download("Inbound/a.docx") == b"Inbound/a.docx:/content" and drive.delete("Inbound/none") is False
    with pytest.raises(LookupError):
        R.Drive("http://x", call, lambda: "t").open("host", library="None")
    got = {r.path: (r.length, bytes(r.content)) for r in R.read_drive(spark, opened, "Inbound").collect()}
    assert got == {p: (s, f"Inbound/{p}:/content".encode()) for p, s in (("a.docx", 3), ("b.pdf", 2), ("sub/c.docx", 4), ("sub/deep/d.rtf", 1))}


def test_retry():
    waits, answers = [], [R.Response(503), R.Response(429, headers={"Retry-After": "7"}), R.Response(200, {"k": 1})]
    assert R.retried(lambda: answers.pop(0), wait=waits.append).body == {"k": 1} and waits == [5.0, 7.0]
    for bad in (lambda: R.Response(503), lambda: R.Response(403)):
        with pytest.raises(OSError):
            R.retried(bad, wait=lambda s: None)

    def lost():
        raise R.Transient

    with pytest.raises(R.Transient):
        R.retried(lost, wait=lambda s: None)
    assert R.retried(lambda: R.Response(404), ok=(404,)).status == 404


@pytest.mark.parametrize("size", [10, R.DIRECT_BYTES, R.DIRECT_BYTES + 1, 2 * R.CHUNK_BYTES, 2 * R.CHUNK_BYTES + 3])
def test_upload_chunks(size):
    got = []

    def store(method, url, headers, body):
        if method == "POST":
            return R.Response(200, {"uploadUrl": "http://session"})
        got.append((headers.get("Content-Range"), len(body)))
        return R.Response(200, {"size": size})

    drive = R.Drive("http://x", store, lambda: "t")
    assert drive.upload("p", b"x" * size) == {"size": size} and sum(n for _, n in got) == size
    assert (got[0][0] is None) == (size <= R.DIRECT_BYTES)
    if size > R.DIRECT_BYTES:
        assert got[-1][0].endswith(f"-{size - 1}/{size}") and all(n <= R.CHUNK_BYTES for _, n in got)


def test_secret(tmp_path, monkeypatch):
    (tmp_path / "my_key").write_text("from folder\n")
    assert R.secret("MY_KEY", str(tmp_path)) == "from folder"
    (tmp_path / "f").write_text("from file")
    monkeypatch.setenv("MY_KEY_FILE", str(tmp_path / "f"))
    assert R.secret("MY_KEY", str(tmp_path)) == "from file"
    monkeypatch.setenv("MY_KEY", "direct")
    assert R.secret("MY_KEY", str(tmp_path)) == "direct" and R.secret("NONE", str(tmp_path)) is None


def test_deep_path(spark):
    cases = [({"a": {"b": ["x", {"path": "p/q"}]}, "c": "d.e"}, "p/q"), ({"a": "no", "b": "x.y"}, "x.y"), ({"file_path": "", "other": [1, None, "z/"]}, "z/"), ([], None), ("a.b", "a.b")]
    df = spark.createDataFrame([(i, json.dumps(m)) for i, (m, _) in enumerate(cases)] + [(98, "{broken"), (99, None)], "i int, m string")
    got = {r.i: r.p for r in df.select("i", MSG.deep_path("m").alias("p")).collect()}
    assert got == {i: p for i, (_, p) in enumerate(cases)} | {98: None, 99: None}


def flood(mask):
    seen, out = set(), []
    for y, x in zip(*np.nonzero(mask)):
        if (y, x) in seen:
            continue
        wait, part = [(y, x)], []
        seen.add((y, x))
        while wait:
            a, b = wait.pop()
            part.append((a, b))
            for p in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and p not in seen:
                    seen.add(p)
                    wait.append(p)
        ys, xs = zip(*part)
        out.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(part)))
    return sorted(out)


@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 0.65, 1.0])
def test_components(share):
    mask = np.random.default_rng(int(share * 100)).random((30, 41)) < share
    labels, boxes = N.components(mask)
    assert sorted(tuple(b) for b in boxes.tolist()) == flood(mask) and ((labels > 0) == mask).all()
    assert [int((labels == k + 1).sum()) for k in range(len(boxes))] == boxes[:, 4].tolist()


def test_erase_keeps_rules():
    image = np.full((60, 100, 3), 250, np.uint8)
    image[30, :] = 0  # a rule across
    image[10:25, 40:45] = 0  # a stroke
    out = N.erased(image, (10, 5, 90, 40), (250, 250, 250))
    assert (out[10:25, 40:45] == 250).all() and (out[30, 20:80] == 0).all() and (image[12, 42] == 0).all()
    assert (N.erased(image, (10, 5, 90, 40), (250, 250, 250), keep_rules=False)[30, 20:80] == 250).all()


def test_skew_and_slant():
    for degrees in (-1.5, 0.0, 2.0):
        gray = np.full((400, 600), 255, np.uint8)
        x = np.arange(600)
        for y0 in range(40, 380, 30):
            y = np.round(y0 + np.tan(np.radians(degrees)) * (x - 300)).astype(int)
            for d in range(4):
                gray[np.clip(y + d, 0, 399), x] = 0
        assert abs(N.skew(gray) - degrees) <= 0.1
    word = np.full((30, 60, 3), 255, np.uint8)
    for y in range(30):
        for k in (10, 25, 40):
            word[y, int(k + 0.3 * (29 - y)) : int(k + 0.3 * (29 - y)) + 3] = 0
    assert abs(N.slant(word, (255, 255, 255)) - 0.3) <= 0.06
    assert N.slant(word[:5], (255, 255, 255)) is None
    assert N.skew(np.full((100, 200), 255, np.uint8)) == 0.0


@pytest.mark.parametrize("lean", [-0.1, 0.0, 0.2, 0.4])
def test_slant_of_drawn_letters(lean):
    """Stems, a bowl and a bar, drawn upright and then sheared."""
    upright = np.zeros((40, 120), bool)
    upright[:, 10:14] = upright[:, 90:93] = True  # stems
    upright[18:22, 90:118] = True  # a bar
    y, x = np.mgrid[:40, :120]
    ring = np.hypot(y - 20, x - 50)
    upright |= (ring > 14) & (ring < 18)  # a bowl
    word = np.full((40, 160, 3), 255, np.uint8)
    at = np.nonzero(upright)
    word[at[0], at[1] + 20 + np.floor(lean * (39 - at[0])).astype(int)] = 0
    assert abs(N.slant(word, (255, 255, 255)) - lean) <= 0.05


def test_skew_of_noisy_words():
    r = np.random.default_rng(5)
    for degrees in (-2.4, -0.6, 0.35, 1.4):
        gray = r.integers(225, 256, (500, 700)).astype(np.uint8)
        for y0 in range(60, 440, 24):
            for x0 in range(30, 640, 50):
                x = np.arange(x0, x0 + int(r.integers(15, 45)))
                y = np.round(y0 + np.tan(np.radians(degrees)) * (x - 350)).astype(int)
                for d in range(int(r.integers(6, 11))):
                    gray[y + d, x] = r.integers(0, 60)
        assert abs(N.skew(gray) - degrees) <= 0.15


def test_signature_zones(spark):
    image = np.full((300, 400, 3), 255, np.uint8)
    r = np.random.default_rng(0)
    x = np.arange(100, 220)
    y = (250 + 18 * np.sin((x - 100) / 9) * (1 - (x - 100) / 150)).astype(int)
    for d in range(6):
        image[y + d, x] = 0  # a scribble at the bottom
    image[40:42, 20:380] = 0  # a line
    image[100, 50:150], image[160, 50:150], image[100:160, 50], image[100:161, 149] = 0, 0, 0, 0  # a frame
    image[:10, 300:] = r.integers(0, 40, (10, 100, 3))  # dark, but covered
    df = spark.createDataFrame([("f", 400, 300, bytearray(image.tobytes()), [(300, 0, 400, 10)])], "file string, width int, height int, pixels binary, covered array<struct<x0:int,y0:int,x1:int,y1:int>>")
    got = {(z.y0 // 50, z.why) for z in N.ink_zones(df).withColumn("why", N.signature_reason(F.lit(False))).collect()}
    assert got == {(4, None), (2, "frame")}  # lines of two pixels are no parts at all


def test_affine_and_fonts(spark):
    m = N.affine_from_points([(0, 0), (1, 0), (0, 1)], [(2, 3), (4, 3), (2, 7)])
    assert np.allclose(m, (2, 0, 2, 0, 4, 3)) and np.allclose(N.affine_inverse(N.affine_inverse(m)), m)
    x, y = N.affine_point(m, F.lit(5.0), F.lit(6.0))
    assert tuple(spark.range(1).select(x, y).head()) == (12.0, 27.0)
    df = spark.createDataFrame([("ABC+Courier-Bold", 0), ("Times-Italic", 0), ("DejaVuSans", 16), (None, 0), ("x", 10)], "n string, f int")
    assert [r.c for r in df.select(N.pdf_font(F.col("n"), F.col("f")).alias("c")).collect()] == ["cobo", "tiit", "hebo", "helv", "coit"]


def test_tighten_and_ratio():
    image = np.full((40, 60, 3), 255, np.uint8)
    image[12:30, 10:14] = 0
    assert N.tightened(image, (5, 2, 55, 38), (255, 255, 255)) == (5, 12, 55, 30)
    image[4] = 0  # a rule and a speck far from the word make no difference
    image[36, 20] = 0
    assert N.tightened(image, (5, 2, 55, 38), (255, 255, 255)) == (5, 12, 55, 30)
    image[4] = image[36, 20] = 255
    assert N.tightened(image, (5, 12, 55, 30), (255, 255, 255)) == (5, 12, 55, 30)  # nothing to gain
    assert N.tightened(image, (20, 2, 55, 38), (255, 255, 255)) == (20, 2, 55, 38)  # no ink
    assert N.ink_ratio(image, (10, 12, 14, 30)) == 1.0 and N.ink_ratio(image, (20, 0, 30, 10)) == 0.0


def test_entities(spark):
    people = synth.entities(spark, 7, patients=200, physicians=5, staff=3, relatives=9).cache()
    rows = people.collect()
    assert len(rows) == 217 and len({r.entity_id for r in rows}) == 217 and sum(r.role == "patient" for r in rows) == 200
    patients = [r for r in rows if r.role == "patient"]
    for field in ("patient_id", "ahv", "iban", "ps_ahv", "ps_iban"):
        assert len({r[field] for r in patients}) == 200
    assert not {r.ahv for r in patients} & {r.ps_ahv for r in patients} and not {r["last"] for r in rows} & {r.ps_last for r in rows}
    assert {r.physician for r in patients} <= {r.entity_id for r in rows if r.role == "physician"} and {r.relative for r in patients} <= {r.entity_id for r in rows if r.role == "relative"}
    ok = people.where("role = 'patient'").select(X.iban_is_valid(F.col("iban")) & X.iban_is_valid(F.col("ps_iban")) & X.ahv_is_valid(F.col("ahv")) & (X.guess_type(F.col("email")) == "EMAIL") & (X.guess_type(F.col("phone")) == "PHONE"))
    assert {r[0] for r in ok.collect()} == {True}
    assert [r.entity_id for r in rows] == [r.entity_id for r in synth.entities(spark, 7, 200, 5, 3, 9).collect()]
    people.unpersist()


def test_decoys(spark):
    df = spark.range(300)
    bad = df.select(X.iban_is_valid(synth.invalid_iban(1, "i", F.col("id"))).alias("i"), X.ahv_is_valid(synth.ahv(1, "a", F.col("id"), valid=False)).alias("a"), X.luhn_is_valid(synth.non_luhn_card(1, "c", F.col("id"))).alias("c"))
    assert {tuple(r) for r in bad.collect()} == {(False, False, False)}
    n = df.select(synth.unique_number(1, "u", 16, F.col("id")).alias("n"))
    assert n.distinct().count() == 300 and n.where("n >= 65536").count() == 0


TABLE = [("IBAN", "CH93 0076 2011 6238 5295 7", "CH11 REPL", 1), ("AHV_NUMBER", "756.9217.0769.85", "756.REPL", 2), ("LAST_NAME", "Pierre-Alain", "Gaspard", 3), ("FIRST_NAME", "Weber", "Keller", 4)]


def line(text, conf=90.0, number=1):
    x, out = 0, []
    for w in text.split(" "):
        out.append(("f", number, x, 10, 10 * len(w), 12, conf, w))
        x += 10 * len(w) + 10
    return out


def test_candidates_and_leak_suspects(spark):
    table = spark.createDataFrame(TABLE, "data_type string, original_value string, replacement_value string, line_no int")
    words = [*line("Mr Weber pays CH93 0076 2011 6238 5295 7", 90.0, 1), *line("to CH93 OO76 2O11 6238 5295 7", 90.0, 2), *line("or CH93 0076 2011 6238 5298 7 now", 90.0, 3), *line("Pjerre-Alain", 40.0, 4), *line("Pjerre-Alain", 95.0, 5), *line("no 756.9217 .0769.85 x", 90.0, 6), *line("and DE12 3456 7890 1234 5678 00", 90.0, 7)]
    df = spark.createDataFrame(words, "file string, line int, x int, y int, w int, h int, conf double, text string")
    got = {(r.line, r.dtype): r for r in C.candidates(df, table, b"k").collect()}
    assert got[1, "FIRST_NAME"].replacement == "Keller" and got[1, "IBAN"].method == "exact" and (got[1, "FIRST_NAME"].x0, got[1, "FIRST_NAME"].x1) == (30, 80)
    assert got[2, "IBAN"].replacement == "CH11 REPL" and got[2, "IBAN"].value.startswith("CH93 OO76")
    assert got[3, "IBAN"].method.startswith("fuzzy_mapping") and got[3, "IBAN"].replacement == "CH11 REPL"
    assert got[4, "LAST_NAME"].replacement == "Gaspard" and (5, "LAST_NAME") not in got
    assert got[7, "IBAN"].method == "generated_fail_closed" and got[7, "IBAN"].replacement.startswith("DE")
    found = spark.createDataFrame([("Keller",), ("Kellar",), ("Weber",), ("CH11 REPL CHF",)], "value string")
    replacements = spark.createDataFrame([(t[2],) for t in TABLE], "replacement string")
    assert [r.value for r in C.leak_suspects(found, replacements).collect()] == ["Weber"]


def test_random_labels_are_stable():
    r = random.Random(0)
    boxes = np.array([[x, y, x + 5, y + 5, 25] for x, y in ((r.randrange(200), r.randrange(200)) for _ in range(40))])
    groups = N.grouped(boxes, 10, 10)
    assert sorted(i for g in groups for i in g.tolist()) == list(range(40))
