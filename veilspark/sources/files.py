"""Folders of documents: listing, routing and text units of office files.

Office packages are read with zipfile and the XML of their parts; what can't be read raises or is
listed for review, and is never passed through as if it were clean.
"""

from __future__ import annotations

import hashlib
import html
import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

#: Objects in objects are followed so deep.
MOST_DEPTH = 3
EMBEDDED = (".docx", ".xlsx", ".xlsm")


def listing(spark: SparkSession, folder: str, only: str | None = None, content: bool = True) -> DataFrame:
    """Files below a folder with their relative path; lock and hidden files are left out, `only` is a part of the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.removeprefix("file://").rstrip("/") + "/"
    rel = F.element_at(F.split("path", re.escape(root), 2), -1)
    files = files.withColumn("path", rel)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.where(~F.startswith(name, F.lit("~$")) & ~F.startswith(name, F.lit(".")))
    if only:
        files = files.where(F.contains("path", F.lit(only)))
    return files.select("path", "length", *["content"] * content, X.route(F.col("path")).alias("handler"))


_DOCX_TAGS = re.compile(r"</w:p>|<w:p(?: [^>]*?)?(?P<empty>/?)>|<w:t(?: [^>]*?)?(?:/>|>(?P<text>.*?)</w:t>)", re.S)
_CELL = re.compile(r"<c( [^>]*?)(?:/>|>(.*?)</c>)", re.S)
_DOCX_PARTS = re.compile(r"word/(document|header\d*|footer\d*)\.xml$")
_SHEET = re.compile(r"xl/worksheets/(sheet\d+)\.xml$")


def _attribute(attributes: str, name: str) -> str:
    m = re.search(rf'(?<![\w:]){name}="([^"]*)"', attributes)
    return html.unescape(m[1]) if m else ""


def _shared_strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    xml = z.read("xl/sharedStrings.xml").decode("utf-8")
    return [html.unescape("".join(re.findall(r"<t(?: [^>]*)?>(.*?)</t>", si, re.S))) for si in re.findall(r"<si(?: [^>]*)?>(.*?)</si>", xml, re.S)]


def _docx_texts(xml: str) -> Iterator[tuple[int, re.Match]]:
    """(paragraph, text element) in order; a text belongs to the innermost paragraph around it, paragraphs count by where they open."""
    opened, n = [], 0
    for m in _DOCX_TAGS.finditer(xml):
        if m[0] == "</w:p>":
            if opened:
                opened.pop()
        elif m[0].startswith("<w:t"):
            yield (opened[-1] if opened else -1), m
        else:
            if not m["empty"]:
                opened.append(n)
            n += 1


def docx_units(z: zipfile.ZipFile) -> Iterator[tuple[str, str, str]]:
    """(zone, unit, text) of paragraphs with text in the body, headers and footers."""
    for name in sorted(n for n in z.namelist() if _DOCX_PARTS.match(n)):
        zone = re.sub(r"\d+$", "", _DOCX_PARTS.match(name)[1]).replace("document", "body")
        texts: dict[int, str] = {}
        for k, m in _docx_texts(z.read(name).decode("utf-8")):
            texts[k] = texts.get(k, "") + html.unescape(m["text"] or "")
        for k in sorted(texts):
            if texts[k]:
                yield zone, f"{name}#{k}", texts[k]


def xlsx_units(z: zipfile.ZipFile) -> Iterator[tuple[str, str, str]]:
    """(zone, unit, text) of text cells; formulas and numbers are left out."""
    shared = _shared_strings(z)
    for name in sorted(n for n in z.namelist() if _SHEET.match(n)):
        for m in _CELL.finditer(z.read(name).decode("utf-8")):
            body = m[2] or ""
            if "<f" in body:
                continue
            kind, text = _attribute(m[1], "t"), ""
            if kind == "s" and (v := re.search(r"<v>(\d+)</v>", body)):
                text = shared[int(v[1])]
            elif kind == "inlineStr":
                text = html.unescape("".join(re.findall(r"<t(?: [^>]*)?>(.*?)</t>", body, re.S)))
            elif kind == "str" and (v := re.search(r"<v>(.*?)</v>", body, re.S)):
                text = html.unescape(v[1])
            if text:
                yield _SHEET.match(name)[1], f"{name}#{_attribute(m[1], 'r')}", text


def rtf_text(data: bytes) -> str:
    """Visible text of an RTF file: control words, destinations and pictures left out."""
    out, skip, depth, i, s = [], None, 0, 0, data.decode("latin-1")
    while i < len(s):
        c = s[i]
        if c == "{":
            depth += 1
            i += 1
        elif c == "}":
            if skip is not None and depth <= skip:
                skip = None
            depth -= 1
            i += 1
        elif c == "\\":
            if m := re.compile(r"\\'([0-9a-fA-F]{2})").match(s, i):
                out += [bytes([int(m[1], 16)]).decode("cp1252", "replace")] * (skip is None)
            elif m := re.compile(r"\\u(-?\d+) ?\??").match(s, i):
                out += [chr(int(m[1]) % 65536)] * (skip is None)
            elif m := re.compile(r"\\([a-zA-Z]+)(-?\d+)? ?").match(s, i):
                if skip is None and m[1] in ("fonttbl", "colortbl", "stylesheet", "info", "pict", "object"):
                    skip = depth
                out += ["\n"] * (skip is None and m[1] in ("par", "line", "row"))
                out += ["\t"] * (skip is None and m[1] in ("tab", "cell"))
            elif m := re.compile(r"\\([\\{}*~_-])").match(s, i):
                if m[1] == "*" and skip is None:
                    skip = depth
                out += [m[1]] * (skip is None and m[1] in "\\{}")
            else:
                m = re.compile(r"\\.?", re.S).match(s, i)
            i = m.end()
        else:
            out += [c] * (skip is None and c not in "\r\n")
            i += 1
    return "".join(out)


_BROKEN = (zipfile.BadZipFile, KeyError, ValueError, IndexError, NotImplementedError, zlib.error)


def _walk(path: str, data: bytes, depth: int, ancestors: tuple[str, ...]) -> Iterator[tuple]:
    """(path, zone, unit, text, depth, status) of a file and the office files in it."""
    ext = "." + path.rsplit(".", 1)[-1].lower()
    mark = hashlib.sha256(data).hexdigest()[:16]
    if depth > MOST_DEPTH or mark in ancestors:
        yield path, None, None, None, depth, "too deep" if depth > MOST_DEPTH else "loop"
        return
    if ext == ".rtf":
        yield path, "body", "rtf", rtf_text(data), depth, "processed"
        return
    if ext not in EMBEDDED:
        yield path, None, None, None, depth, "unsupported"
        return
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for zone, unit, text in (docx_units if ext == ".docx" else xlsx_units)(z):
            yield path, zone, unit, text, depth, "processed"
        for name in sorted(n for n in z.namelist() if "/embeddings/" in n):
            try:
                yield from list(_walk(f"{path}!{name}", z.read(name), depth + 1, (*ancestors, mark)))
            except _BROKEN as e:  # what the file around it says is kept
                yield f"{path}!{name}", None, None, None, depth + 1, f"error: {e}"


UNITS = "path string, zone string, unit string, text string, depth int, status string"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            try:
                rows += list(_walk(path, content, 0, ()))
            except _BROKEN as e:
                rows.append((path, None, None, None, 0, f"error: {e}"))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(),) * 4 + (pa.int32(), pa.string()))], ["path", "zone", "unit", "text", "depth", "status"])


def text_units(files: DataFrame) -> DataFrame:
    """Text units of files (path, content), embedded files included; a file that can't be read has one row with its status, for review."""
    return files.select("path", "content").mapInArrow(_units, UNITS)


def zones(units: DataFrame) -> DataFrame:
    """Per file and zone of text_units(): how many units, and their texts in order of their places."""
    return units.where("status = 'processed'").groupBy("path", "zone").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct(_place(), "unit", "text"))), lambda u: u["text"]).alias("texts"))


def _place() -> Column:
    """A unit's number in its part; cells keep their name."""
    return F.coalesce(F.try_to_number(F.element_at(F.split("unit", "#"), -1), F.lit("999999999")).cast("long"), F.lit(0)).alias("place")


def scanned(units: DataFrame) -> DataFrame:
    """text_units() as the evaluation reads documents: document, text, locs (paragraph:N and sheet!cell to text), embedded_text.

    Paragraphs of the body count from 0 by their place. Columns that need a page or image reader are null.
    """
    own = F.col("depth") == 0
    last, part = F.element_at(F.split("unit", "#"), -1), F.element_at(F.split("unit", "#"), 1)
    loc = F.when(part == "word/document.xml", F.concat(F.lit("paragraph:"), last)).when(F.startswith(part, F.lit("xl/worksheets/")), F.concat("zone", F.lit("!"), last))
    rows = units.where("status = 'processed'").select(F.element_at(F.split("path", "!"), 1).alias("document"), own.alias("own"), loc.alias("loc"), F.struct("path", "zone", _place(), "unit", "text").alias("u"))
    joined = lambda which: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(which, F.col("u")))), lambda u: u["text"]), "\n")
    found = F.map_from_entries(F.array_distinct(F.collect_list(F.when(F.col("own") & F.col("loc").isNotNull(), F.struct("loc", "u.text")))))
    out = rows.groupBy("document").agg(joined(F.col("own")).alias("text"), found.alias("locs"), joined(~F.col("own")).alias("embedded_text"))
    return out.withColumns({"pages": F.lit(None).cast("array<string>"), "image_text": F.lit(None).cast("string"), "page_ocr": F.lit(None).cast("map<int,string>")})


def rewritten(content: bytes, path: str, texts: dict[str, str]) -> bytes:
    """An office package with the texts of the given units replaced. The first run of a paragraph takes the text, the others are emptied; a cell becomes an inline string."""
    ext, out = "." + path.rsplit(".", 1)[-1].lower(), io.BytesIO()
    by_part: dict[str, dict[str, str]] = {}
    for unit, text in texts.items():
        part, _, place = unit.partition("#")
        by_part.setdefault(part, {})[place] = html.escape(text, quote=False)

    def paragraphs(xml: str, new: dict[str, str]) -> str:
        out, at, begun = [], 0, set()
        for k, m in _docx_texts(xml):
            if str(k) in new:
                text = "" if k in begun else new[str(k)]
                begun.add(k)
                out += [xml[at : m.start()], f'<w:t xml:space="preserve">{text}</w:t>']
                at = m.end()
        return "".join([*out, xml[at:]])

    def cell(m: re.Match, new: dict[str, str]) -> str:
        ref = _attribute(m[1], "r")
        if ref not in new:
            return m[0]
        style = _attribute(m[1], "s")
        return f'<c r="{ref}"' + f' s="{style}"' * bool(style) + f' t="inlineStr"><is><t xml:space="preserve">{new[ref]}</t></is></c>'

    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        for info in z.infolist():
            data = z.read(info)
            if new := by_part.get(info.filename):
                xml = data.decode("utf-8")
                if ext == ".docx":
                    xml = paragraphs(xml, new)
                else:
                    xml = _CELL.sub(lambda m, new=new: cell(m, new), xml)
                data = xml.encode("utf-8")
            w.writestr(info, data)
    return out.getvalue()


def rewrite_files(files: DataFrame, masked_units: DataFrame) -> DataFrame:
    """(path, content) of office files with their units' (path, unit, masked) texts in place."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        new = dict(zip(right.column("unit").to_pylist(), right.column("masked").to_pylist()))
        rows = [(p, rewritten(c, p, new) if new else c) for p, c in zip(left.column("path").to_pylist(), left.column("content").to_pylist())]
        return pa.table({"path": pa.array([r[0] for r in rows], pa.string()), "content": pa.array([r[1] for r in rows], pa.binary())})

    return files.select("path", "content").groupBy("path").cogroup(masked_units.select("path", "unit", "masked").groupBy("path")).applyInArrow(run, "path string, content binary")
