"""Layout: words to lines, spans back to boxes, clusters, fuzzy and spatial joins.

words: file, line, x, y, w, h, conf, text. Windows and groups are bounded by a line or an
image, whose size is that of a page, not of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X


def word_offsets(words: DataFrame) -> DataFrame:
    """words with their offsets s and e in the line's text, which joins them by spaces from left to right."""
    before = W.partitionBy("file", "line").orderBy("x", "y", "text").rowsBetween(W.unboundedPreceding, -1)
    return words.withColumn("s", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int")).withColumn("e", (F.col("s") + F.length("text")).cast("int"))


def line_texts(words: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("x", "y", "text")))
    return words.groupBy("file", "line").agg(F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"))


def span_boxes(spans: DataFrame, words: DataFrame) -> DataFrame:
    """Spans (file, line, span_id, s, e) as the box of the words (with s and e) that they overlap, and those words' least confidence."""
    hit = spans.alias("p").join(words.alias("w"), (F.col("p.file") == F.col("w.file")) & (F.col("p.line") == F.col("w.line")) & (F.col("w.s") < F.col("p.e")) & (F.col("w.e") > F.col("p.s")))
    return hit.groupBy("p.file", "p.line", "p.span_id").agg(F.min("w.x").alias("x0"), F.min("w.y").alias("y0"), F.max(F.col("w.x") + F.col("w.w")).alias("x1"), F.max(F.col("w.y") + F.col("w.h")).alias("y1"), F.min("w.conf").alias("conf"))


def line_pairs(lines: DataFrame) -> DataFrame:
    """Each line and, joined by a space, each pair of consecutive lines (file, page, line, text): n is 1 or 2."""
    following = F.lead("text").over(W.partitionBy("file", "page").orderBy("line"))
    pairs = lines.withColumn("text", F.concat("text", F.lit(" "), following)).where("text IS NOT NULL")
    return lines.withColumn("n", F.lit(1)).unionByName(pairs.withColumn("n", F.lit(2)))


def first_match(matches: DataFrame) -> DataFrame:
    """One row a (file, page, rounded corner, value): matches of single lines come before those of pairs."""
    w = W.partitionBy("file", "page", F.round("x0").cast("int"), F.round("y0").cast("int"), "value").orderBy("n", "line")
    return matches.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def adjacent_cells(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """Neighbouring cells (sheet, row, col, value) whose joined text is in pairs (original_value, replacement_value): the two replacement parts."""
    w = W.partitionBy("sheet", "row").orderBy("col")
    both = cells.withColumn("next_col", F.lead("col").over(w)).withColumn("next_value", F.lead("value").over(w)).where("next_col = col + 1")
    both = both.withColumn("original_value", F.concat(F.trim("value"), F.lit(" "), F.trim("next_value")))
    cut = F.split("replacement_value", " ", 2)
    return both.join(pairs, "original_value").select("sheet", "row", "col", F.get(cut, 0).alias("first"), F.get(cut, 1).alias("second"))


def uncovered(candidates: DataFrame, covered: DataFrame) -> DataFrame:
    """Candidates (file, line, s, e) that overlap no covered span: an anti-join with an equality on the line."""
    c, d = candidates.alias("c"), covered.alias("d")
    return c.join(d, (F.col("c.file") == F.col("d.file")) & (F.col("c.line") == F.col("d.line")) & (F.col("d.s") < F.col("c.e")) & (F.col("d.e") > F.col("c.s")), "left_anti")


def size_clusters(sizes: DataFrame, ratio: float = 1.10, least: int = 3) -> DataFrame:
    """sizes (image, idx, size) with the cluster they are in and its upper median; a gap above ratio and above `least` starts a cluster."""
    w = W.partitionBy("image").orderBy("size", "idx")
    previous = F.lag("size").over(w)
    new = F.coalesce((F.col("size") > F.greatest(previous * F.lit(ratio), previous + least)).cast("int"), F.lit(0))
    clustered = sizes.withColumn("new", new).withColumn("cluster", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    inside = W.partitionBy("image", "cluster")
    ranked = clustered.withColumn("r", F.row_number().over(inside.orderBy("size", "idx"))).withColumn("n", F.count("*").over(inside))
    median = F.max(F.when(F.col("r") == F.floor(F.col("n") / 2) + 1, F.col("size"))).over(inside)
    return ranked.select("image", "idx", "size", "cluster", median.alias("median"))


def snapped_numeric(clusters: DataFrame, most: float = 1.35) -> DataFrame:
    """Clusters (image, cluster, median, numeric): a purely numeric one takes the nearest lower letter cluster's median within `most` times."""
    c, d = clusters.alias("c"), clusters.where("NOT numeric").select("image", F.col("median").alias("lower")).alias("d")
    near = (F.col("c.image") == F.col("d.image")) & F.col("c.numeric") & (F.col("d.lower") < F.col("c.median")) & (F.col("c.median") <= F.col("d.lower") * F.lit(most))
    return c.join(d, near, "left").groupBy("c.image", "c.cluster", "c.median", "c.numeric").agg(F.coalesce(F.max("d.lower"), F.col("c.median")).alias("size"))


def chains(words: DataFrame, gap: float = 0.8) -> DataFrame:
    """words with a chain number: on a line, a word joins the one before it if the gap is at most `gap` times its height."""
    w = W.partitionBy("file", "line").orderBy("x", "y", "text")
    new = F.coalesce((F.col("x") - F.lag(F.col("x") + F.col("w")).over(w) > F.lit(gap) * F.lag("h").over(w)).cast("int"), F.lit(0))
    return words.withColumn("new", new).withColumn("chain", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("new")


def merged_rects(rects: DataFrame, gap: float = 0.6) -> DataFrame:
    """Neighbouring rectangles (page, line, x0, y0, x1, y1) of a line as one where the gap is at most `gap` times the height."""
    w = W.partitionBy("page", "line").orderBy("x0", "x1", "y0")
    reach = F.max("x1").over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.coalesce((F.col("x0") - reach > F.lit(gap) * (F.col("y1") - F.col("y0"))).cast("int"), F.lit(0))
    grouped = rects.withColumn("new", new).withColumn("g", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return grouped.groupBy("page", "line", "g").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def overlap_area(a: str, b: str) -> Column:
    side = lambda lo, hi: F.greatest(F.lit(0), F.least(f"{a}.{hi}", f"{b}.{hi}") - F.greatest(f"{a}.{lo}", f"{b}.{lo}"))
    return side("x0", "x1") * side("y0", "y1")


def _in_cells(boxes: DataFrame, x: tuple[Column, Column], y: tuple[Column, Column], cell: int) -> DataFrame:
    """boxes once for each cell of a square grid (cx, cy) that the ranges x and y touch."""
    touched = lambda lo, hi: F.explode(F.sequence(F.floor(lo / cell), F.floor(F.greatest(lo, hi) / cell)))
    return boxes.withColumn("cx", touched(*x)).withColumn("cy", touched(*y))


#: Side of a grid cell in pixels: boxes of one page meet only in the cells that both touch.
CELL = 128


def best_cover(rects: DataFrame, spans: DataFrame, cell: int = CELL) -> DataFrame:
    """Per rectangle (page, rect_id, x0..y1) the span (page, span_id, x0..y1) that covers most of it; smaller ids on ties.

    A pair is counted in the one cell that holds the upper left corner of its overlap.
    """
    sides = (F.col("x0"), F.col("x1")), (F.col("y0"), F.col("y1"))
    a, b = _in_cells(rects, *sides, cell).alias("a"), _in_cells(spans, *sides, cell).alias("b")
    corner = (F.floor(F.greatest("a.x0", "b.x0") / cell) == F.col("a.cx")) & (F.floor(F.greatest("a.y0", "b.y0") / cell) == F.col("a.cy"))
    meet = (F.col("a.page") == F.col("b.page")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & corner
    joined = a.join(b, meet).withColumn("area", overlap_area("a", "b")).where("area > 0")
    return joined.groupBy("a.page", "a.rect_id").agg(F.max_by("b.span_id", F.struct("area", -F.col("b.span_id"))).alias("span_id"), F.max("area").alias("area"))


def residuals(boxes: DataFrame, objects: DataFrame, cell: int = CELL) -> DataFrame:
    """Per box (page, box_id, x0..y1) how many objects (page, kind, x0..y1: curves, images) still overlap it, by kind; a clean box has a row with kind null and 0."""
    sides = (F.col("x0"), F.col("x1")), (F.col("y0"), F.col("y1"))
    a, b = _in_cells(boxes, *sides, cell).alias("a"), _in_cells(objects, *sides, cell).alias("b")
    corner = (F.floor(F.greatest("a.x0", "b.x0") / cell) == F.col("a.cx")) & (F.floor(F.greatest("a.y0", "b.y0") / cell) == F.col("a.cy"))
    meet = (F.col("a.page") == F.col("b.page")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & corner
    left = a.join(b, meet).where(overlap_area("a", "b") > 0).groupBy("a.page", "a.box_id", "b.kind").agg(F.count("*").alias("n"))
    return boxes.select("page", "box_id").join(left, ["page", "box_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def suppressed(boxes: Column, share: float = 0.5) -> Column:
    """Greedy non-maximum suppression of an array of struct(x0, y0, x1, y1, ...) in order: a box goes if more than `share` of it lies in one that stays."""

    def covers(d: Column, b: Column) -> Column:
        ix = F.greatest(F.lit(0), F.least(b["x1"], d["x1"]) - F.greatest(b["x0"], d["x0"]))
        iy = F.greatest(F.lit(0), F.least(b["y1"], d["y1"]) - F.greatest(b["y0"], d["y0"]))
        return ix * iy > F.lit(share) * (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])

    return F.aggregate(boxes, F.slice(boxes, 1, 0), lambda kept, b: F.when(F.exists(kept, lambda d: covers(d, b)), kept).otherwise(F.concat(kept, F.array(b))))


def near_labels(boxes: DataFrame, labels: DataFrame, reach: int = 250) -> DataFrame:
    """Boxes (file, box_id, x0..y1) that start at most `reach` right of or below the end of a label (file, x0..y1), and are no further from it in the other direction.

    Boxes meet labels in grid cells of side `reach`, by their left and their upper edge.
    """
    a, b = boxes.select("file", "box_id", "x0", "y0", "x1", "y1"), labels.select("file", *[F.col(c).alias(f"l{c}") for c in ("x0", "y0", "x1", "y1")])
    right = (F.col("x0") - F.col("lx1")).between(0, reach) & (F.col("y0") <= F.col("ly1") + reach) & (F.col("y1") >= F.col("ly0") - reach)
    below = (F.col("y0") - F.col("ly1")).between(0, reach) & (F.col("x0") <= F.col("lx1") + reach) & (F.col("x1") >= F.col("lx0") - reach)
    found = None
    for condition, x, y, lx, ly in (
        (right, ("x0", "x0"), ("y0", "y1"), (F.col("lx1"), F.col("lx1") + reach), (F.col("ly0") - reach, F.col("ly1") + reach)),
        (below, ("x0", "x1"), ("y0", "y0"), (F.col("lx0") - reach, F.col("lx1") + reach), (F.col("ly1"), F.col("ly1") + reach)),
    ):
        own = _in_cells(a, tuple(map(F.col, x)), tuple(map(F.col, y)), reach)
        hit = own.join(_in_cells(b, lx, ly, reach), ["file", "cx", "cy"]).where(condition).select("file", "box_id")
        found = hit if found is None else found.unionByName(hit)
    return boxes.join(found.distinct(), ["file", "box_id"], "left_semi")


def trusted_words(words: DataFrame, sure: float = 75, least: float = 30, cap: int = 1, cell: int = CELL // 2) -> DataFrame:
    """Words (file, pass, word_id, x0..y1, conf, text) of two characters and more that are surely read, or that another pass reads alike: more than half of the box, edit distance at most cap.

    What covers more than half of a box covers its middle, so a word meets the others in the one cell that holds its middle.
    A window gathers the words that touch a cell; unlike a join, it leaves words that are dealt by file where they are.
    """
    usable = words.where((F.col("conf") >= least) & (F.length("text") >= 2))
    x0, y0, x1, y1 = map(F.col, ("x0", "y0", "x1", "y1"))
    # a word without a place has a cell of its own kind; nothing meets it there
    touched = lambda lo, hi: F.explode(F.coalesce(F.sequence(F.floor(lo / cell), F.floor(F.greatest(lo, hi) / cell)), F.array(F.lit(None).cast("long"))))
    home = lambda c, lo, hi: F.col(c).eqNullSafe(F.greatest(F.floor(lo / cell), F.floor((lo + hi) / (2 * cell))))
    parts = ["pass", "x0", "y0", "x1", "y1", "text"]
    folded = lambda c: X.casefold(X.norm(c))

    def alike(b: Column) -> Column:
        middle = (2 * b["y0"] <= y0 + y1) & (2 * b["y1"] >= y0 + y1) & (2 * b["x0"] <= x0 + x1) & (2 * b["x1"] >= x0 + x1)
        area = (F.least(x1, b["x1"]) - F.greatest(x0, b["x0"])) * (F.least(y1, b["y1"]) - F.greatest(y0, b["y0"]))
        return middle & (F.col("pass") != b["pass"]) & (area > 0.5 * (x1 - x0) * (y1 - y0)) & (X.distance(folded(F.col("text")), folded(b["text"]), cap) <= cap)

    # as one column, what the window gathers is sorted once and not twice
    placed = usable.withColumn("cx", touched(x0, x1)).withColumn("cy", touched(y0, y1)).withColumn("word", F.struct(*parts)).drop(*parts)
    met = placed.withColumn("near", F.collect_list("word").over(W.partitionBy("file", "cx", "cy"))).withColumns({c: F.col("word")[c] for c in parts})
    found = (F.col("conf") >= sure) | (F.col("file").isNotNull() & F.exists("near", alike))
    return met.where(home("cx", x0, x1) & home("cy", y0, y1) & found).select(*words.columns)


def ocr_union(words: DataFrame) -> DataFrame:
    """Words of several recognition passes (file, scale, psm, block, par, line, word, seq, left, top, width, height, conf, text) in the original's pixels.

    Of a pass's repeated words the first by seq stays; corners round down and sizes up,
    so that a scaled-back box still covers its ink. `pass` and `line_id` tell passes and their lines apart.
    """
    key = ["file", "scale", "psm", "block", "par", "line", "word"]
    one = words.groupBy(*key).agg(F.min_by(F.struct("left", "top", "width", "height", "conf", "text"), "seq").alias("r")).select(*key, "r.*")
    down, up = lambda c: F.floor(F.col(c) / F.col("scale")).cast("int"), lambda c: F.ceil(F.col(c) / F.col("scale")).cast("int")
    return one.select(
        "file", F.concat_ws("/", "scale", "psm").alias("pass"), F.concat_ws("/", "scale", "psm", "block", "par", "line").alias("line_id"), "word",
        down("left").alias("x"), down("top").alias("y"), up("width").alias("w"), up("height").alias("h"), F.coalesce("conf", F.lit(0.0)).alias("conf"), F.trim("text").alias("text"),
    )


def run_growth(boxes: DataFrame, words: DataFrame, gap: float = 1.2, least: float = 12, overlap: float = 0.6) -> DataFrame:
    """(file, box_id, word_id) of the words of a box's run: of its visual line, and linked to it by gaps of at most `gap` times its height.

    boxes: file, box_id, x0..y1; words: file, word_id, x0..y1, surely read ones. A run grows over
    words that it reaches, which is a merge of intervals: words and box in order of their left ends, cut
    where a gap is too wide. Words that lie in the box itself are not part of the run.
    """
    a, b = boxes.alias("a"), words.alias("b")
    height = F.least(F.col("a.y1") - F.col("a.y0"), F.col("b.y1") - F.col("b.y0"))
    shared = F.least("a.y1", "b.y1") - F.greatest("a.y0", "b.y0")
    same = (F.col("a.file") == F.col("b.file")) & (shared / F.greatest(F.lit(1), height) >= overlap)
    cells = _in_cells(a, (F.col("y0"), F.col("y0")), (F.col("y0"), F.col("y1")), CELL).drop("cx").alias("a"), _in_cells(b, (F.col("y0"), F.col("y0")), (F.col("y0"), F.col("y1")), CELL).drop("cx").alias("b")
    once = (F.col("a.cy") == F.col("b.cy")) & (F.floor(F.greatest("a.y0", "b.y0") / CELL) == F.col("a.cy"))
    lined = cells[0].join(cells[1], same & once).select("a.file", "a.box_id", "b.word_id", F.col("b.x0").alias("x0"), F.col("b.x1").alias("x1"), F.col("a.x0").alias("bx0"), F.col("a.x1").alias("bx1"), F.greatest(F.lit(least), F.lit(gap) * (F.col("a.y1") - F.col("a.y0"))).alias("reach"))
    own = lined.select("file", "box_id", F.lit(None).cast(dict(words.dtypes)["word_id"]).alias("word_id"), F.col("bx0").alias("x0"), F.col("bx1").alias("x1"), "bx0", "bx1", "reach").distinct()
    w = W.partitionBy("file", "box_id").orderBy("x0", "x1", F.col("word_id").asc_nulls_first())
    far = F.coalesce((F.col("x0") - F.max("x1").over(w.rowsBetween(W.unboundedPreceding, -1)) > F.col("reach")).cast("int"), F.lit(0))
    parted = lined.unionByName(own).withColumn("far", far).withColumn("part", F.sum("far").over(w.rowsBetween(W.unboundedPreceding, 0)))
    home = F.max(F.when(F.col("word_id").isNull(), F.col("part"))).over(W.partitionBy("file", "box_id"))
    inside = (F.col("x1") > F.col("bx0") + 2) & (F.col("x0") < F.col("bx1") - 2)
    return parted.withColumn("home", home).where((F.col("part") == F.col("home")) & F.col("word_id").isNotNull() & ~inside).select("file", "box_id", "word_id")


def visual_lines(boxes: Column, overlap: float = 0.6) -> Column:
    """An array of boxes struct(y0, y1, x0, ...) of one page as an array of lines, each from left to right.

    Boxes come by the height of their middle, then from left to right; each joins the
    first line whose latest box it overlaps vertically by `overlap` of the smaller height, else starts one.
    """
    by = F.array_sort(boxes, lambda a, b: F.when(a["y0"] + a["y1"] < b["y0"] + b["y1"], -1).when(a["y0"] + a["y1"] > b["y0"] + b["y1"], 1).when(a["x0"] < b["x0"], -1).when(a["x0"] > b["x0"], 1).otherwise(0))

    def level(a: Column, b: Column) -> Column:
        smaller = F.greatest(F.lit(1), F.least(a["y1"] - a["y0"], b["y1"] - b["y0"]))
        return (F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])) / smaller >= overlap

    def step(lines: Column, box: Column) -> Column:
        fits = F.transform(lines, lambda line: level(F.element_at(line, -1), box))
        at = F.array_position(fits, True)
        joined = F.transform(lines, lambda line, i: F.when(i + 1 == at, F.concat(line, F.array(box))).otherwise(line))
        return F.when(at > 0, joined).otherwise(F.concat(lines, F.array(F.array(box))))

    lines = F.aggregate(by, F.slice(F.array(by), 1, 0), step)
    return F.transform(lines, lambda line: F.array_sort(line, lambda a, b: F.when(a["x0"] < b["x0"], -1).when(a["x0"] > b["x0"], 1).otherwise(0)))


def linked_chains(items: DataFrame, words: DataFrame, gap: float = 0.8, least: float = 10, overlap: float = 0.6) -> DataFrame:
    """items (file, line, item_id, x0..y1) with the chain they are laid out in: an item joins the one left of it if the gap is no
    more than `gap` times its own height and no surely read word (file, x0..y1) of their line stands between them."""
    w = W.partitionBy("file", "line").orderBy("x0", "item_id")
    placed = items.withColumn("left", F.lag("x1").over(w))
    a, b = placed.where("left IS NOT NULL").alias("a"), words.alias("b")
    height = F.greatest(F.lit(1), F.least(F.col("a.y1") - F.col("a.y0"), F.col("b.y1") - F.col("b.y0")))
    level = (F.least("a.y1", "b.y1") - F.greatest("a.y0", "b.y0")) / height >= overlap
    between = (F.col("a.file") == F.col("b.file")) & (F.col("b.x0") >= F.col("a.left") - 2) & (F.col("b.x1") <= F.col("a.x0") + 2) & level
    parted = a.join(b, between, "left_semi").select("file", "line", "item_id", F.lit(True).alias("parted"))
    joined = placed.join(parted, ["file", "line", "item_id"], "left")
    away = F.col("x0") - F.col("left")
    new = F.coalesce(F.col("parted") | (away < 0) | (away > F.greatest(F.lit(least), F.lit(gap) * (F.col("y1") - F.col("y0")))), F.lit(False)).cast("int")
    return joined.withColumn("new", new).withColumn("chain", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0))).select(*items.columns, "chain")


def chain_layout(items: DataFrame) -> DataFrame:
    """Where the replacements of chains are written: items (file, chain, item_id, x0, x1, width, free) with `x` and the chain's `scale`.

    width: of the replacement as it is set; free: where the space that the chain may fill ends. An item starts
    where it stood, or is pushed to the end of the one before it and the original gap between the two. A
    chain that doesn't fit is set smaller by one factor, so that no single word takes all the loss.
    """
    w = W.partitionBy("file", "chain").orderBy("x0", "item_id")
    gap = F.coalesce(F.greatest(F.lit(0), F.col("x0") - F.lag("x1").over(w)), F.lit(0))
    up_to, whole = w.rowsBetween(W.unboundedPreceding, 0), W.partitionBy("file", "chain")
    # pushed start: the largest of all "an earlier item's start, plus widths and gaps since"
    laid = items.withColumn("gap", gap).withColumn("taken", F.sum(F.col("gap") + F.coalesce(F.lag("width").over(w), F.lit(0))).over(up_to))
    laid = laid.withColumn("x", F.col("taken") + F.max(F.col("x0") - F.col("taken")).over(up_to))
    first, end = F.min("x0").over(whole), F.max(F.col("x") + F.col("width")).over(whole)
    room = F.max("free").over(whole) - first
    scaled = laid.withColumn("first", first).withColumn("scale", F.when(end - first > room, room / (end - first)).otherwise(F.lit(1.0)))
    return scaled.select(*items.columns, (F.col("first") + (F.col("x") - F.col("first")) * F.col("scale")).alias("x"), "scale")


def deletions(s: Column, cap: int) -> Column:
    """s and all strings that up to cap deletions make of it (cap 0 to 2): two strings within cap edits share one of them."""
    out = F.array(s)
    for _ in range(cap):
        shorter = F.flatten(F.transform(out, lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1)))))
        out = F.array_distinct(F.concat(out, shorter))
    return out


def fuzzy_best(values: DataFrame, table: DataFrame, cap: int) -> DataFrame:
    """values (value) with the one table row (key, replacement) that is nearest, if it is within cap edits and no other row is as near.

    Candidates share a string after up to cap deletions: an equi-join with no pair of
    unlike lengths or contents, exact for caps up to 2. Distances are verified.
    Rows of one key with different replacements make it ambiguous. A value that is a key needs no
    deletions: nothing else is as near. Both sides are shuffled, since their sizes are
    estimated before they are exploded and so would look fit to be broadcast.
    """
    keys, listed = table.select("key", "replacement").distinct(), values.select("value").distinct()
    same = listed.join(keys.hint("merge"), F.col("value") == F.col("key")).groupBy("value").agg(F.count("*").alias("n"), F.first("key").alias("key"), F.first("replacement").alias("replacement"))
    rest = listed.join(keys.select("key").hint("merge"), F.col("value") == F.col("key"), "left_anti")
    v = rest.select("value", F.explode(deletions(F.col("value"), cap)).alias("d"))
    t = keys.select("key", "replacement", F.explode(deletions(F.col("key"), cap)).alias("d"))
    pairs = v.join(t.hint("merge"), "d").select("value", "key", "replacement").distinct().withColumn("distance", X.distance(F.col("value"), F.col("key"), cap)).where(F.col("distance") <= cap)
    w = W.partitionBy("value").orderBy("distance", "key", "replacement")
    best = pairs.withColumn("r", F.row_number().over(w)).withColumn("runner_up", F.lead("distance").over(w)).where("r = 1 AND (runner_up IS NULL OR runner_up > distance)")
    return best.select("value", "key", "replacement", "distance").unionByName(same.where("n = 1").select("value", "key", "replacement", F.lit(0).alias("distance")))


#: Shapes of misread IBANs and AHV numbers, the countries of the former, and what may follow one (fixed values).
LOOSE_IBAN = r"\b[A-Z]{2}[0-9OoQDIlSZB]{2}(?:[ ]?[A-Z0-9]{2,4}){3,8}\b"
LOOSE_AHV = r"\b756[.,]\s?(?:\d\s?){4}[.,]\s?(?:\d\s?){4}[.,]\s?\d{2}\b"
IBAN_COUNTRIES = ("CH", "LI", "DE", "AT", "FR", "IT", "ES", "PT", "NL", "BE", "LU", "GB", "IE", "DK", "SE", "NO", "FI", "PL", "CZ", "MC")
TAIL = r"^ ?[A-Z0-9]{1,4}"


def loose_ibans(line: Column) -> Column:
    """IBAN-shaped runs of a line of recognised text whose country is known and whose account is mostly digits."""

    def plausible(v: Column) -> Column:
        body = F.substr(X.norm(v), F.lit(5))
        return F.substr(v, F.lit(1), F.lit(2)).isin(*IBAN_COUNTRIES) & (F.length(F.regexp_replace(body, "[^0-9]", "")) >= 0.6 * F.length(body))

    return F.filter(F.regexp_extract_all(line, F.lit(X.unicode_pattern(f"({LOOSE_IBAN})")), 1), plausible)


def with_tails(rest: Column) -> Column:
    """What an IBAN-shaped run may be longer by, from what follows it: nothing, the next token, or the next two; a token that is joined on without a space is the last."""
    first = F.regexp_extract(rest, TAIL, 0)
    second = F.regexp_extract(F.substr(rest, F.length(first) + 1), TAIL, 0)
    both = F.startswith(first, F.lit(" ")) & (second != "")
    tails = F.array(F.lit(""), F.when(first != "", first), F.when(both, F.concat(first, second)))
    return F.filter(tails, lambda t: t.isNotNull())


def loose_ahv(line: Column) -> Column:
    """AHV-shaped runs with stray spaces or commas, in canonical form."""
    shaped = F.regexp_extract_all(line, F.lit(X.unicode_pattern(f"({LOOSE_AHV})")), 1)
    return F.transform(shaped, lambda v: F.regexp_replace(F.regexp_replace(v, "[^0-9]", ""), r"^(...)(....)(....)(..)$", "$1.$2.$3.$4"))
