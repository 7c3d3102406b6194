"""Documents whose pages need a codec: words in, edits out.

No reader of PDF or images is at hand, so the codec is a function of the caller; what lies between
reading and writing, which words to replace and how, are tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import pdf_font
from ..operators import layout as L

WORDS = "file string, page int, line int, x int, y int, w int, h int, conf double, text string, status string"
_KINDS = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.string())


def page_words(files: DataFrame, read: Callable[[bytes], Iterable[tuple]], batch: int = 4096) -> DataFrame:
    """Words of files (path, content) by a codec: read(content) gives (page, line, x, y, w, h, conf, text).

    A file that the codec can't read is one row with its status, for review; a file
    without words has one row `blank`, as a scanned page would.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], [c.split()[0] for c in WORDS.split(", ")])

        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                rows, n = [], 0
                try:
                    for word in read(content):
                        rows.append((path, *word, "processed"))
                        n += 1
                        if len(rows) == batch:
                            yield made(rows)
                            rows = []
                    if not n:
                        rows = [(path, *[None] * 8, "blank")]
                except Exception as e:  # noqa: BLE001  (a codec may fail in any way)
                    rows = [*rows, (path, *[None] * 8, f"error: {type(e).__name__}: {e}")]
                if rows:
                    yield made(rows)

    return files.select("path", "content").mapInArrow(run, WORDS)


def edits(rects: DataFrame, spans: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a codec has to do on its pages: (areas to erase, texts to write).

    rects: page, line, rect_id, x0..y1, replacement, of values found; spans: page, span_id, x0..y1, font, flags, size, color, the
    text as it is set; words: page, line, x0..y1, all replaced words. Neighbouring rectangles of a line are erased
    as one, so that no space of the original stays between two replaced words. A
    replacement takes the place, size and colour of its rectangle's best-covering span, and the nearest base font.
    """
    erase = L.merged_rects(words.select("page", "line", "x0", "y0", "x1", "y1")).drop("g")
    cover = L.best_cover(rects.select("page", "rect_id", "x0", "y0", "x1", "y1"), spans.select("page", "span_id", "x0", "y0", "x1", "y1"))
    style = spans.select("page", "span_id", pdf_font(F.col("font"), F.col("flags")).alias("font"), "size", "color")
    placed = rects.join(cover.select("page", "rect_id", "span_id"), ["page", "rect_id"], "left").join(style, ["page", "span_id"], "left")
    write = placed.where("replacement <> ''").select("page", "rect_id", "x0", "y0", "x1", "y1", F.col("replacement").alias("text"), F.coalesce("font", F.lit("helv")).alias("font"), F.coalesce("size", F.col("y1") - F.col("y0")).alias("size"), F.coalesce("color", F.lit(0)).alias("color"))
    return erase, write
