"""Evaluation of masked output against a ground truth.

ground truth: gt_id, document, location_type, page, sheet, cell, paragraph, section, data_type,
value, variant, expected_action, expected_replacement, strict_replacement.
outputs, one row a document: document, text, pages array<string>, locs map<string,string>,
image_text, page_ocr map<int,string>, embedded_text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from . import search as S

LEAK_EXAMPLES, DECOY_EXAMPLES, SURFACE_EXAMPLES, TOKEN_EXAMPLES = 15, 10, 6, 20


_FORMS = {"text": lambda t: t, "folded": X.collapse, "squeezed": X.squeeze, "edges": lambda t: X.edged(X.collapse(t))}


def _prepared(outputs: DataFrame) -> DataFrame:
    """outputs with each text as struct(text, folded, squeezed, edges), so that a document is normalized once and not once a ground truth row."""
    forms = lambda t: F.struct(*[f(t).alias(n) for n, f in _FORMS.items()])
    blank = lambda c: F.coalesce(c, F.lit(""))
    return outputs.select(
        "document", forms(F.col("text")).alias("text"), F.transform("pages", forms).alias("pages"), F.transform_values("locs", lambda k, v: forms(v)).alias("locs"),
        forms(blank(F.col("image_text"))).alias("image_text"), F.transform_values("page_ocr", lambda k, v: forms(v)).alias("page_ocr"), forms(blank(F.col("embedded_text"))).alias("embedded_text"), F.lit(True).alias("present"),
    )


def _scope(form: str) -> Column:
    """One form of the finest known text for a ground truth row.

    Order: image (the page's recognised text, if any, and the images'), embedded objects, page
    (out of range: the whole text), cells of a sheet, paragraph, table cell, whole text.
    """
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    gap = F.lit("" if form == "squeezed" else " ")
    single = (lambda c: F.regexp_replace(c, " +", " ")) if form in ("folded", "edges") else (lambda c: c)
    page, whole = F.col("page").cast("int"), F.col("text")[form]
    ocr, images = F.element_at("page_ocr", page)[form], F.col("image_text")[form]
    image = F.when(F.col("pages").isNotNull() & filled("page") & ocr.isNotNull(), single(F.concat(ocr, gap, images))).otherwise(images)
    on_page = F.when((page >= 1) & (page <= F.size("pages")), F.get("pages", page - 1)[form]).otherwise(whole)
    each = F.transform(F.split("cell", ":"), lambda c: F.coalesce(F.element_at("locs", F.concat("sheet", F.lit("!"), c))[form], F.lit("")))
    cells = single(F.array_join(each, "" if form == "squeezed" else " "))
    kind = F.col("location_type")
    return (
        F.when(kind == "image", image)
        .when(F.startswith(kind, F.lit("embedded")), F.col("embedded_text")[form])
        .when((F.coalesce(F.size("pages"), F.lit(0)) > 0) & filled("page"), on_page)
        .when((kind == "cell") & filled("sheet") & filled("cell"), cells)
        .when((kind == "paragraph") & filled("paragraph"), F.coalesce(F.element_at("locs", F.concat(F.lit("paragraph:"), "paragraph"))[form], whole))
        .when((kind == "table_cell") & filled("cell"), F.coalesce(F.element_at("locs", F.col("cell"))[form], whole))
        .otherwise(whole)
    )


#: Ground truth rows of one document that a task judges; a document with more goes to several.
TRUTH_ROWS = 1000


def _joined(truth: DataFrame, outputs: DataFrame) -> DataFrame:
    parts = truth.groupBy("document").agg(F.ceil(F.count("*") / TRUTH_ROWS).cast("int").alias("parts"))
    own = truth.join(parts, "document", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("gt_id"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    laid = _prepared(outputs).join(parts, "document").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return own.join(laid, ["document", "part"], "left").drop("part").withColumn("present", F.coalesce("present", F.lit(False))).withColumn("is_ocr", F.col("present") & (F.col("location_type") == "image"))


def scoped(truth: DataFrame, outputs: DataFrame) -> DataFrame:
    """Ground truth with `present` (the document was written), and for those the `scope` of text to look in and `is_ocr`."""
    return _joined(truth, outputs).select(*truth.columns, "present", F.when(F.col("present"), F.coalesce(_scope("text"), F.lit(""))).alias("scope"), "is_ocr")


#: What tells the texts apart that ground truth rows are looked for in.
PLACE = ["document", "location_type", "page", "sheet", "cell", "paragraph"]


def judged(truth: DataFrame, outputs: DataFrame, strict: bool = False, replacements: bool = True) -> DataFrame:
    """Ground truth with present, is_ocr, must_hide, leaked, replaced and kept; a missing document leaks all it had to hide.

    Each text is searched once for all values and replacements that are looked for in it (search.standing).
    Without replacements these aren't looked for, and there is no column `replaced`.
    """
    hide = (F.col("expected_action") == "PSEUDONYMIZE") | (F.lit(strict) & F.col("present"))
    target = F.when(F.lit(strict) & (F.col("expected_action") == "KEEP"), F.col("strict_replacement")).otherwise(F.col("expected_replacement"))
    sid = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in PLACE]).alias("sid")
    texts = truth.select(*PLACE).distinct().join(_prepared(outputs).hint("merge"), "document")
    forms = F.array(*[F.struct(F.lit(m).alias("mode"), F.coalesce(_scope(form), F.lit("")).alias("text")) for m, form in ((S.SQUEEZED, "squeezed"), (S.EDGES, "edges"), (S.FOLDED, "folded"))])
    texts = texts.select(sid, F.explode(forms).alias("t")).select("sid", "t.*")

    there = outputs.select("document", F.lit(True).alias("present")).distinct()
    rows = truth.join(there, "document", "left").withColumn("present", F.coalesce("present", F.lit(False))).withColumn("is_ocr", F.col("present") & (F.col("location_type") == "image"))
    key = lambda value: F.when(F.col("present"), S.key_of(value, F.col("data_type"), F.col("is_ocr")))
    # a replacement counts only where something is to be hidden
    keys = {"there": key(F.col("value"))} | ({"swapped": F.when(F.coalesce(hide, F.lit(True)), key(target))} if replacements else {})
    rows = rows.select(*truth.columns, "present", "is_ocr", sid, *[k.alias(f"{name}_key") for name, k in keys.items()])
    found = S.standing(texts, rows.select("sid", F.explode(F.array(*[f"{name}_key" for name in keys])).alias("key")))
    for name in keys:
        hit = found.select("sid", F.col("key").alias(f"{name}_key"), F.lit(True).alias(name))
        rows = rows.join(hit.hint("merge"), ["sid", f"{name}_key"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    replaced = [(hide & F.col("present") & F.col("swapped")).alias("replaced")] if replacements else []
    return rows.select(*truth.columns, "present", "is_ocr", hide.alias("must_hide"), (hide & F.when(F.col("present"), F.col("there")).otherwise(True)).alias("leaked"), *replaced, (~hide & F.col("present") & F.col("there")).alias("kept"))


def _counts() -> list[Column]:
    image = F.col("location_type") == "image"
    return [
        F.count_if("must_hide").alias("to_pseudonymize"), F.count_if("leaked").alias("leaked"), F.count_if("replaced").alias("replacement_present"),
        F.count_if(~F.col("must_hide") & F.col("present")).alias("keep_expected"), F.count_if("kept").alias("keep_present"),
        F.count_if(F.col("must_hide") & image).alias("image_to_pseudonymize"), F.count_if(F.col("leaked") & image).alias("image_leaked"),
    ]


def by_type(rows: DataFrame) -> DataFrame:
    return rows.groupBy("data_type").agg(*_counts())


#: Parts of a document's rows that are sorted apart, so that no task sorts all of a large document.
PARTS = 64


def by_document(rows: DataFrame) -> DataFrame:
    """Counts a document, and its first leaks by gt_id as text. Rows are gone through once; the examples are cut in parts of a document before they are gathered."""
    order = ["gt_id", "data_type", "value"]
    line = F.struct("gt_id", F.concat_ws(" ", *order).alias("line"))
    ranked = rows.withColumn("part", F.pmod(F.xxhash64("gt_id"), F.lit(PARTS))).withColumn("n", F.row_number().over(W.partitionBy("document", "part").orderBy(F.desc("leaked"), *order)))
    parts = ranked.groupBy("document", "part").agg(*_counts(), F.collect_list(F.when(F.col("leaked") & (F.col("n") <= LEAK_EXAMPLES), line)).alias("first"))
    names = [c for c in parts.columns if c not in ("document", "part", "first")]
    shown = F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, LEAK_EXAMPLES)
    return parts.groupBy("document").agg(*[F.sum(c).alias(c) for c in names], F.array_join(F.transform(shown, lambda x: x["line"]), "; ").alias("leak_examples"))


def grouped(rows: DataFrame) -> DataFrame:
    """Counts by type, by document and over all in one pass."""
    return rows.groupingSets([["data_type"], ["document"], []], "data_type", "document").agg(*_counts())


def leaks(rows: DataFrame) -> DataFrame:
    return rows.where("leaked").select("document", "gt_id", "page", "data_type", "value", "variant", "location_type")


def coherence(rows: DataFrame) -> DataFrame:
    """Per present document of a judged ground truth: values to hide that stand on two surfaces and more (section, else location type), and the leaks among them."""
    surface = F.when(F.col("expected_action") == "PSEUDONYMIZE", F.coalesce(F.nullif("section", F.lit("")), "location_type"))
    # two surfaces and more: the least is not the largest
    leaks = F.count_if(F.col("leaked") & F.col("value").isNotNull()).alias("leaks")
    multi = rows.where("present").groupBy("document", "value").agg(F.min(surface).alias("least"), F.max(surface).alias("largest"), leaks).where("least <> largest")
    return multi.groupBy("document").agg(F.count("*").alias("values_multi_surface"), F.sum("leaks").alias("leaks_in_multi_surface_values"))


def surface_examples(truth: DataFrame, rows: DataFrame, n: int = SURFACE_EXAMPLES) -> DataFrame:
    """Per present document its first n values (by gt_id) that stand on two surfaces and more, with these in order."""
    surface = F.coalesce(F.nullif("section", F.lit("")), "location_type")
    multi = truth.where("expected_action = 'PSEUDONYMIZE'").groupBy("document", "value").agg(F.array_sort(F.collect_set(surface)).alias("surfaces"), F.min("gt_id").alias("first")).where(F.size("surfaces") >= 2)
    there = multi.join(rows.where("present").select("document").distinct(), "document", "left_semi")
    return there.withColumn("r", F.row_number().over(W.partitionBy("document").orderBy("first", "value"))).where(F.col("r") <= n).select("document", "value", "surfaces")


def _found(text: Column, dtype: str) -> Column:
    return F.regexp_extract_all(text, F.lit(X.unicode_pattern(f"({dict(X.PATTERNS)[dtype]})")), 1)


def format_validity(outputs: DataFrame, decoys: DataFrame) -> DataFrame:
    """Per document (document, text): IBAN-, AHV- and card-shaped strings and the valid ones among them; decoys (value) don't count, cards are looked for outside IBANs."""
    iban = dict(X.PATTERNS)["IBAN"]
    bare = F.regexp_replace("text", F.lit(X.unicode_pattern(iban)), F.lit(" "))

    def tagged(kind: str, text: Column) -> Column:
        return F.transform(_found(text, kind), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = F.concat(tagged("IBAN", F.col("text")), tagged("AHV_NUMBER", F.col("text")), tagged("CREDIT_CARD", bare))
    rows = outputs.select("document", F.explode(found).alias("f")).select("document", "f.*").withColumn("key", X.casefold(X.norm(F.col("value"))))
    rows = rows.join(decoys.select(X.casefold(X.norm(F.col("value"))).alias("key")).distinct(), "key", "left_anti")
    valid = F.when(F.col("kind") == "IBAN", X.iban_valid_with_tail(F.col("value"))).when(F.col("kind") == "AHV_NUMBER", X.ahv_is_valid(F.col("value"))).otherwise(X.luhn_is_valid(F.col("value")))
    counts = [c for k, name in (("IBAN", "iban"), ("AHV_NUMBER", "ahv"), ("CREDIT_CARD", "card")) for c in (F.count_if(F.col("kind") == k).alias(f"{name}_like"), F.count_if((F.col("kind") == k) & valid).alias(f"{name}_valid"))]
    every = outputs.select("document", X.placeholders(F.col("text")).cast("long").alias("placeholders"))
    zero = [F.coalesce(f"{n}_{k}", F.lit(0)).alias(f"{n}_{k}") for n in ("iban", "ahv", "card") for k in ("like", "valid")]
    return every.join(rows.groupBy("document").agg(*counts), "document", "left").select("document", *zero, "placeholders")


def decoys_modified(outputs: DataFrame, decoys: DataFrame) -> DataFrame:
    """Per document: its decoys (document, value) and how many of them are no longer in its text."""
    return _looked_for(outputs, decoys.select("document", "value")).groupBy("document").agg(F.count("*").alias("decoys_total"), F.count_if("gone").alias("decoys_modified"))


def _looked_for(outputs: DataFrame, decoys: DataFrame) -> DataFrame:
    """decoys (document, value, ..) that aren't empty, of documents that are there, with `gone`: not in the document's text without regard to white space and case."""
    sid = F.col("document").alias("sid")
    rows = decoys.where("value <> ''").withColumn("key", F.concat(F.lit(S.SQUEEZED), X.squeeze(F.col("value"))))
    texts = outputs.select(sid, F.lit(S.SQUEEZED).alias("mode"), X.squeeze(F.col("text")).alias("text"))
    found = S.standing(texts, rows.select(sid, "key")).select(F.col("sid").alias("document"), "key", F.lit(True).alias("there"))
    there = outputs.select("document").distinct()
    return rows.join(found.hint("merge"), ["document", "key"], "left").withColumn("gone", F.col("there").isNull()).join(there, "document", "left_semi").select(*decoys.columns, "gone")


def decoy_examples(outputs: DataFrame, decoys: DataFrame, n: int = DECOY_EXAMPLES, order: str = "value") -> DataFrame:
    """Per document its first n modified decoys (document, value) by the decoys' column `order`."""
    rows = _looked_for(outputs, decoys.select("document", "value", F.col(order).alias("at"))).where("gone")
    rows = rows.withColumn("r", F.row_number().over(W.partitionBy("document").orderBy("at", "value"))).where(F.col("r") <= n)
    return rows.groupBy("document").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda x: x["value"]).alias("decoys_modified_examples"))


def integrity(inbound: DataFrame, outputs: DataFrame) -> DataFrame:
    """Per document of outputs (document, text, pages, stats): its stats, a map of counts (pages, images, paragraphs, tables, sheets), beside those of
    the inbound document, the ratio of text lengths, and whether pages are as many. What has no inbound document, or no pages, is null there."""
    a = inbound.select("document", F.col("text").alias("text_in"), F.col("pages").alias("pages_in"), F.col("stats").alias("inbound"), F.lit(True).alias("there"))
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    ratio = F.when(F.col("there"), F.bround(size("text") / F.greatest(F.lit(1), size("text_in")), 3))
    equal = F.when(F.col("pages").isNotNull() & F.col("pages_in").isNotNull(), F.size("pages") == F.size("pages_in"))
    return outputs.join(a, "document", "left").select("document", F.col("stats").alias("output"), "inbound", ratio.alias("text_length_ratio"), equal.alias("pages_equal"))


def dropped_members(before: DataFrame, after: DataFrame, folder: str = "word/embeddings/") -> DataFrame:
    """Embedded objects of packages (file, name) that the rewritten package lacks, as entries of the run's log."""
    gone = before.where(F.startswith("name", F.lit(folder))).select("file", "name").join(after.select("file", "name").distinct(), ["file", "name"], "left_anti")
    return gone.select("file", "name", F.lit("dropped").alias("status"))


def zones_kept(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per file and zone (body, header, footer, table, ...) of text units (file, zone, text): how many stood before and stand after, and whether the zone survived."""
    a, b = (df.groupBy("file", "zone").agg(F.count("*").alias(n)) for df, n in ((before, "n_before"), (after, "n_after")))
    both = a.join(b, ["file", "zone"], "full").select("file", "zone", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))
    return both.withColumn("survived", (F.col("n_before") == 0) | (F.col("n_after") > 0))


def size_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per path in both listings (path, length): bytes before, after and the difference in thousandths of the input, toward zero."""
    a, b = before.select("path", F.col("length").alias("bytes_in")), after.select("path", F.col("length").alias("bytes_out"))
    delta = F.col("bytes_out") - F.col("bytes_in")
    return a.join(b, "path").select("path", "bytes_in", "bytes_out", F.expr("(1000 * (bytes_out - bytes_in)) div greatest(bytes_in, 1)").alias("permille"), delta.alias("delta"))


def token_bags(before: DataFrame, after: DataFrame) -> DataFrame:
    """Multiset difference of tokens (token) both ways: side, token, n."""
    lost, new = before.select("token").exceptAll(after.select("token")), after.select("token").exceptAll(before.select("token"))
    count = lambda df, side: df.groupBy("token").agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "token", "n")
    return count(lost, "missing").unionByName(count(new, "added"))


def fidelity_examples(bags: DataFrame, n: int = TOKEN_EXAMPLES) -> DataFrame:
    """The first n tokens of each side in order."""
    return bags.withColumn("r", F.row_number().over(W.partitionBy("side").orderBy("token"))).where(F.col("r") <= n).drop("r")


def trees_equal(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: paths only before, only after, and common."""
    a, b = before.select("path").distinct(), after.select("path").distinct()
    tagged = a.exceptAll(b).select(F.lit("only_before").alias("k")).unionByName(b.exceptAll(a).select(F.lit("only_after").alias("k"))).unionByName(a.intersect(b).select(F.lit("common").alias("k")))
    return tagged.agg(*[F.count_if(F.col("k") == k).alias(k) for k in ("only_before", "only_after", "common")])


def signatures(rows: DataFrame) -> DataFrame:
    """One row from (kind, ink_in, ink_out[, present]): a signature is well covered below 2 % residual ink, a decoy intact within 5 %."""
    signature = F.startswith("kind", F.lit("signature"))
    residual = F.when(F.col("ink_in") > 0, F.col("ink_out") / F.col("ink_in")).otherwise(0.0)
    ok = F.when(signature, residual < 0.02).otherwise(F.abs(F.col("ink_out") - F.col("ink_in")) <= 0.05 * F.greatest("ink_in", F.lit(1e-9)))
    return rows.agg(F.bool_and(ok).alias("ok"), F.count_if(signature).alias("signatures"), F.count_if(signature & ok).alias("signatures_ok"), F.count_if(~signature).alias("decoys"), F.count_if(~signature & ok).alias("decoys_intact"), F.max(F.when(signature, residual)).alias("residual_max"))


def embedded_summary(objects: DataFrame) -> DataFrame:
    """Per file from (path, name, status): objects found, processed and unsupported, the latter's names."""
    return objects.groupBy("path").agg(F.count("*").alias("found"), F.count_if(F.col("status") == "processed").alias("processed"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == "unsupported", F.col("name")))), ",").alias("unsupported"))


def embedded_against_log(found: DataFrame, logged: DataFrame) -> DataFrame:
    """Objects found (document, name) and whether the run's log (document, name, status) has them."""
    return found.join(logged, ["document", "name"], "left").select("document", "name", F.coalesce("status", F.lit("not logged")).alias("status"))


def run_summary(files: DataFrame) -> DataFrame:
    """Per file from (path, log, images, seconds): replacements in the text, in images, and seconds."""
    images = F.aggregate("images", F.lit(0), lambda a, x: a + F.size(x["replacements"]))
    return files.select("path", F.size("log").alias("text_replacements"), images.alias("image_replacements"), "seconds")


def verdict(rows: DataFrame, decoys: DataFrame) -> DataFrame:
    """One row: leaks, modified decoys, absent documents, and whether all three are zero."""
    totals = rows.agg(F.count_if("leaked").alias("leaks"), F.count_distinct(F.when(~F.col("present"), F.col("document"))).alias("absent"))
    changed = decoys.agg(F.coalesce(F.sum("decoys_modified"), F.lit(0)).alias("decoys_modified"))
    both = totals.withColumn("one", F.lit(1)).join(changed.withColumn("one", F.lit(1)), "one")
    return both.select("leaks", "decoys_modified", "absent", ((F.col("leaks") == 0) & (F.col("decoys_modified") == 0) & (F.col("absent") == 0)).alias("passed"))


def upper_median(values: Column) -> Column:
    """The middle element of an array in order, of an even number the upper one."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def upper_medians(rows: DataFrame, steps: int = 4096) -> DataFrame:
    """Per key of rows (key, value) the middle value in order, of an even number the upper one; nulls don't count, NaN is the largest.

    Values are counted by steps between the least and largest finite one of the key; only the step that
    holds the middle is ordered, by distinct values, so no task takes a whole key.
    """
    v = F.col("value").cast("double")
    finite = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v / 2)
    same = lambda a, b: F.col(f"{a}.key").eqNullSafe(F.col(f"{b}.key"))
    ends = rows.groupBy("key").agg(F.min(finite).alias("lo"), F.max(finite).alias("hi"), F.count("value").alias("n"))
    inner = F.when(F.col("hi") > F.col("lo"), F.floor((v / 2 - F.col("lo")) / (F.col("hi") - F.col("lo")) * steps)).otherwise(0)
    step = F.when(finite.isNotNull(), inner).when(v < 0, -1).otherwise(steps + 1).cast("long")
    stepped = rows.alias("r").join(F.broadcast(ends).alias("e"), same("r", "e")).where("value IS NOT NULL").select("r.key", "r.value", "lo", "hi", "n").withColumn("step", step)
    up_to = W.partitionBy("key").orderBy("step")
    counts = stepped.groupBy("key", "step", "n").agg(F.count("*").alias("c")).withColumn("before", F.sum("c").over(up_to) - F.col("c"))
    middle = counts.withColumn("rank", F.floor(F.col("n") / 2) + 1 - F.col("before")).where("rank BETWEEN 1 AND c").select("key", "step", "rank")
    inside = stepped.alias("s").join(F.broadcast(middle).alias("m"), same("s", "m") & (F.col("s.step") == F.col("m.step")))
    values = inside.groupBy("s.key", "value", "rank").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(W.partitionBy("key").orderBy("value")))
    found = values.where("rank <= upto").groupBy("key").agg(F.min("value").alias("median"))
    return ends.alias("e").join(found.alias("f"), same("e", "f"), "left").select("e.key", "median")
