import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from veilspark.operators import mapping as M
from veilspark.sinks import sizes as S
from veilspark.sources import files as FILES
from veilspark.sources import pages as PAGES
from veilspark.sources import tables as TABLES
from veilspark.streaming import triggers as T


def docx(paragraphs, header="Head Weber", embedded=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{a}</w:t></w:r><w:r><w:t>{b}</w:t></w:r></w:p>' for a, b in paragraphs)
        z.writestr("word/document.xml", f"<w:document><w:body>{body}<w:p/></w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr><w:p><w:r><w:t>{header}</w:t></w:r></w:p></w:hdr>")
        if embedded:
            z.writestr("word/embeddings/book.xlsx", embedded)
    return out.getvalue()


def xlsx():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>shared &amp; one</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<row r="1"><c r="A1" t="s" s="3"><v>0</v></c><c r="B1" t="inlineStr"><is><t>inline</t></is></c><c r="C1"><f>A1</f><v>2</v></c><c r="D1"><v>5</v></c><c r="E1" s="1"/></row>')
    return out.getvalue()


def test_office_units_and_rewriting(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.docx").write_bytes(docx([("An", "ne &lt;x&gt;"), ("", "")], embedded=xlsx()))
    (tmp_path / "b.rtf").write_bytes(rb"{\rtf1{\fonttbl{\f0 Arial;}}\f0 Caf\'e9 \u233? \b bold\par next{\*\generator x}}")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "d.docx").write_bytes(b"not a zip")
    (tmp_path / "~$lock.docx").write_bytes(b"x")
    (tmp_path / ".hidden").write_bytes(b"x")
    files = FILES.listing(spark, f"file://{tmp_path}")
    assert {(r.path, r.handler) for r in files.collect()} == {("sub/a.docx", "docx"), ("b.rtf", "rtf"), ("c.pdf", "pdf"), ("d.docx", "docx")}
    assert FILES.listing(spark, f"file://{tmp_path}", only="sub").count() == 1
    units = {(r.path, r.unit): r for r in FILES.text_units(files).collect()}
    assert units["sub/a.docx", "word/document.xml#0"].text == "Anne <x>" and units["sub/a.docx", "word/header1.xml#0"].zone == "header"
    inner = "sub/a.docx!word/embeddings/book.xlsx"
    assert units[inner, "xl/worksheets/sheet1.xml#A1"].text == "shared & one" and units[inner, "xl/worksheets/sheet1.xml#B1"].depth == 1
    assert len([k for k in units if k[0] == inner]) == 2
    assert units["b.rtf", "rtf"].text == "Café é bold\nnext"
    assert units["c.pdf", None].status == "unsupported" and units["d.docx", None].status.startswith("error")
    new = spark.createDataFrame([("sub/a.docx", "word/document.xml#0", "Cla & ra")], "path string, unit string, masked string")
    got = {r.path: r.content for r in FILES.rewrite_files(files.where("handler = 'docx' AND path <> 'd.docx'"), new).collect()}
    with zipfile.ZipFile(io.BytesIO(got["sub/a.docx"])) as z:
        assert [t for _, _, t in FILES.docx_units(z)] == ["Cla & ra", "Head Weber"] and "word/embeddings/book.xlsx" in z.namelist()
    book = FILES.rewritten(xlsx(), "x.xlsx", {"xl/worksheets/sheet1.xml#A1": "new <1>"})
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        assert [t for _, _, t in FILES.xlsx_units(z)] == ["new <1>", "inline"] and 's="3"' in z.read("xl/worksheets/sheet1.xml").decode()


def test_paragraphs_in_paragraphs_and_broken_parts():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        inner = "<w:txbxContent><w:p><w:r><w:t>box</w:t></w:r></w:p></w:txbxContent>"
        z.writestr("word/document.xml", f'<w:p w:rsidR="1"/><w:p><w:pPr/><w:r><w:t>before </w:t></w:r>{inner}<w:r><w:t>after</w:t></w:r></w:p><w:p w:x="1"><w:t/><w:t>last</w:t></w:p>')
        z.writestr("word/embeddings/broken.xlsx", b"no package")
    rows = [(r[2], r[3], r[5].split(":")[0]) for r in FILES._walk("a.docx", out.getvalue(), 0, ())]
    assert rows == [("word/document.xml#1", "before after", "processed"), ("word/document.xml#2", "box", "processed"), ("word/document.xml#3", "last", "processed"), (None, None, "error")]
    new = FILES.rewritten(out.getvalue(), "a.docx", {"word/document.xml#1": "new", "word/document.xml#3": "<end>"})
    with zipfile.ZipFile(io.BytesIO(new)) as z:
        assert [t for _, _, t in FILES.docx_units(z)] == ["new", "box", "<end>"]


def test_zones_and_scanned_documents(spark):
    data = docx([("An", "ne"), ("Be", "a")], embedded=xlsx())
    units = FILES.text_units(spark.createDataFrame([("a.docx", data), ("b.xlsx", xlsx()), ("c.pdf", b"x")], "path string, content binary"))
    assert {(r.path, r.zone): (r.n, r.texts) for r in FILES.zones(units).collect() if r.path == "a.docx"} == {("a.docx", "body"): (2, ["Anne", "Bea"]), ("a.docx", "header"): (1, ["Head Weber"])}
    got = {r.document: r for r in FILES.scanned(units).collect()}
    assert got["a.docx"].locs == {"paragraph:0": "Anne", "paragraph:1": "Bea"} and got["a.docx"].text == "Anne\nBea\nHead Weber" and got["a.docx"].embedded_text == "shared & one\ninline"
    assert got["b.xlsx"].locs == {"sheet1!A1": "shared & one", "sheet1!B1": "inline"} and "c.pdf" not in got


def test_settled_size():
    raw = docx([("x", "")])
    grown = lambda more: (lambda data: len(data) + more)
    data, stored, ok = S.settled(raw, "a.docx", len(raw) + 500, grown(100))
    assert ok and stored == len(raw) + 500 and len(data) == len(raw) + 400
    assert S.settled(raw, "a.docx", len(raw) + 500, lambda data: None)[1:] == (None, False)
    sizes = []
    S.settled(raw, "a.docx", len(raw) + 900, lambda data: sizes.append(len(data)) or len(data) + 100 * len(sizes))
    assert len(sizes) <= 1 + S.TRIES  # a store that adds more each time doesn't hold the run


def test_generated_pairs_are_kept(spark, tmp_path):
    pairs = lambda *rows: spark.createDataFrame(rows, "original_value string, replacement_value string")
    path = f"{tmp_path}/generated"
    for batch, rows in ((1, [("a", "X"), ("b", "Y")]), (2, [("a", "Z"), ("c", "W")]), (2, [("a", "Z"), ("c", "W")])):
        S.append_generated(pairs(*rows), path, batch)
    table = S.generated_table(spark, path)
    assert {(r.original_value, r.replacement_value) for r in table.collect()} == {("a", "X"), ("b", "Y"), ("c", "W")}
    both = M.with_generated(spark.createDataFrame([("T", "a", "Q")], "data_type string, original_value string, replacement_value string"), table)
    assert [r.json for r in S.mapping_page(both).collect()][-1] == '{"data_type":"T","original_value":"a","replacement_value":"Q","origin":"table"}' and both.count() == 3


def test_worker_counters(spark):
    def handle(path, content):
        return 1 // len(content) and "done"

    done = T.worked(spark.createDataFrame([("a", b"x"), ("b", b""), ("c", b"y")], "path string, content binary"), handle)
    assert tuple(T.counters(done).head()) == (2, 1, "ZeroDivisionError: integer division or modulo by zero")
    assert tuple(T.counters(done.limit(0)).head()) == (0, 0, None)


def test_embedded_loops_end():
    data = docx([("x", "")])
    for _ in range(5):
        data = docx([("x", "")], embedded=None) if data is None else _with(data)
    rows = list(FILES._walk("a.docx", data, 0, ()))
    assert max(r[4] for r in rows) == FILES.MOST_DEPTH + 1 and any(r[5] == "too deep" for r in rows)


def _with(inner):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:r><w:t>x</w:t></w:r></w:p>")
        z.writestr("word/embeddings/inner.docx", inner)
    return out.getvalue()


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


@pytest.mark.parametrize("gap", [0, 4, 14, 20, 65_537, 65_538, 70_000, 131_075, 200_000])
def test_padding(gap):
    jpeg = b"\xff\xd8\xff\xd9"
    out, ok = S.match_size(jpeg, "a.JPG", len(jpeg) + gap)
    assert ok and len(out) == len(jpeg) + gap and out[:2] == b"\xff\xd8" and out[-2:] == b"\xff\xd9"
    at = 2
    while out[at : at + 2] == b"\xff\xfe":
        at += 2 + int.from_bytes(out[at + 2 : at + 4], "big")
    assert out[at:] == b"\xff\xd9"
    for name, data in (("a.png", png()), ("a.docx", docx([("x", "")])), ("a.rtf", b"{\\rtf1 x}")):
        out, ok = S.match_size(data, name, len(data) + gap)
        assert ok == (name != "a.png" or gap == 0 or gap >= 14) and len(out) == len(data) + (gap if ok else 0)
        if name == "a.docx":
            with zipfile.ZipFile(io.BytesIO(out)) as z:
                assert z.testzip() is None and "word/document.xml" in z.namelist()


def test_padding_never_cuts(spark):
    assert S.match_size(b"x" * 10, "a.docx", 5) == (b"x" * 10, False) and S.match_size(b"abc", "a.txt", 4) == (b"abc", False)
    assert S.next_target(100, 104) == 96
    outputs = spark.createDataFrame([("a.rtf", bytearray(b"{}")), ("b.txt", bytearray(b"x"))], "path string, content binary")
    inputs = spark.createDataFrame([("a.rtf", 5), ("b.txt", 2)], "path string, length long")
    assert {(r.path, r.length_out, r.matched) for r in S.matched_files(outputs, inputs).collect()} == {("a.rtf", 5, True), ("b.txt", 1, False)}
    assert S.markdown_table(inputs.orderBy("path")).splitlines()[2] == "| a.rtf | 5 |"


def test_csv_sources(spark, tmp_path):
    (tmp_path / "m.csv").write_text('data_type,original_value,replacement_value\nA,"x, ""y""\nz",1\nA,k,2\nA,k,3\n', encoding="utf-8")
    rows = TABLES.read_mapping(spark, f"file://{tmp_path}/m.csv")
    from veilspark.operators.mapping import exact_table

    assert {tuple(r) for r in exact_table(rows, "line").collect()} == {("A", 'x, "y"\nz', "1"), ("A", "k", "3")}
    (tmp_path / "o.tsv").write_text("level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n4\t1\t1\t1\t1\t0\t0\t0\t9\t9\t-1\t\n5\t1\t1\t1\t1\t1\t11\t21\t31\t9\t88.5\t \"He\n5\t1\t1\t1\t1\t2\t11\t21\t31\t9\t88.5\t  \n", encoding="utf-8")
    got = TABLES.read_ocr(spark, f"file://{tmp_path}/o.tsv", psm=11, scale=2).collect()
    assert [(r.x, r.y, r.w, r.h, r.text) for r in got] == [(5, 10, 16, 5, '"He')]


def test_jobs_stream(spark, tmp_path):
    jobs = [(1, "file", "a", "1"), (2, "all", None, "2"), (3, "file", "a", "3"), (4, "all", None, "4"), (5, "file", "b", "5")]
    spark.createDataFrame(jobs, T.JOBS).coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = []
    stream = spark.readStream.schema(T.JOBS).parquet(f"{tmp_path}/in")
    listing = spark.createDataFrame([("a",), ("c",)], "path string")

    def handle(batch, epoch):
        seen.append((sorted((r.kind, r.path, r.seq) for r in batch.where("kind = 'file'").collect()), sorted(r.path for r in T.fan_out(batch, listing).collect())))

    for _ in range(2):  # the second run finds nothing new
        T.run_jobs(stream, handle, f"{tmp_path}/checkpoint", once=True).awaitTermination()
    assert seen == [([("file", "a", 1), ("file", "b", 5)], ["a", "b", "c"])]


def test_poll_baseline_and_new_jobs(spark, tmp_path):
    row = lambda i, ids='["9"]', s=3: (ids, s, "Post-Processing Complete", i, "s", "n", "t")
    listing = lambda *rows: spark.createDataFrame(list(rows), "instance_ids string, last_job_status int, last_job_sub_state string, last_job_id string, scan_id string, scan_name string, last_job_scan_time string")
    seen = f"{tmp_path}/seen"
    started = []

    def polled(*rows, take=lambda jobs: started.append([(r.kind, r.job_id) for r in jobs.collect()])):
        started.clear()
        T.poll(spark, listing(*rows), "9", seen, take)
        return sum(started, [])

    assert polled(row("1")) == []
    now = row("1"), row("2"), row("2"), row("3", '["8"]'), row("4", s=1)

    def fails(jobs):
        raise OSError("queue is full")

    with pytest.raises(OSError):
        polled(*now, take=fails)
    assert polled(*now) == [("all", "2")]  # a failed hand-over is made up for
    assert polled(row("1"), row("2")) == []


def test_stream_of_scans_has_each_job_once(spark, tmp_path):
    schema = "job_id string, finished_at timestamp"
    spark.createDataFrame([("1", None), ("2", None), ("1", None)], schema).write.parquet(f"{tmp_path}/s")
    query = T.stream_unseen(spark.readStream.schema(schema).parquet(f"{tmp_path}/s")).writeStream.format("memory").queryName("scans").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("scans").select(F.count("*")).head()[0] == 2


def test_pages_by_a_codec(spark):
    def read(content):
        if content == b"bad":
            raise ValueError("no such codec")
        for k, word in enumerate(content.decode().split()):
            yield 1, k // 3, 50 * (k % 3), 20 * (k // 3), 8 * len(word), 12, 90.0, word

    files = spark.createDataFrame([("a.pdf", b"Anna Weber lives here now"), ("b.pdf", b""), ("c.pdf", b"bad")], "path string, content binary")
    words = PAGES.page_words(files, read, batch=2).collect()
    assert sorted((w.file, w.text or "", w.status) for w in words) == [("a.pdf", t, "processed") for t in sorted("Anna Weber lives here now".split())] + [("b.pdf", "", "blank"), ("c.pdf", "", "error: ValueError: no such codec")]


def test_edits_of_a_page(spark):
    rects = spark.createDataFrame([(1, 0, 7, 10, 10, 40, 22, "Clara"), (1, 0, 8, 44, 10, 90, 22, ""), (1, 5, 9, 10, 110, 60, 122, "Rey")], "page int, line int, rect_id int, x0 int, y0 int, x1 int, y1 int, replacement string")
    spans = spark.createDataFrame([(1, 1, 8, 9, 95, 23, "Times-Bold", 16, 11.0, 255)], "page int, span_id int, x0 int, y0 int, x1 int, y1 int, font string, flags int, size double, color int")
    erase, write = PAGES.edits(rects, spans, rects)
    assert {tuple(r) for r in erase.select("line", "x0", "x1").collect()} == {(0, 10, 90), (5, 10, 60)}
    assert {tuple(r) for r in write.select("rect_id", "text", "font", "size", "color").collect()} == {(7, "Clara", "tibo", 11.0, 255), (9, "Rey", "helv", 12.0, 0)}
