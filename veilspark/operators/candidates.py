"""Candidates in recognised text, in stages that each leave alone what earlier ones cover, and the check for what leaked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.keyed import generate
from . import detect, layout, mapping, mask

NAME_TYPES = ("FIRST_NAME", "LAST_NAME", "STREET_ADDRESS", "POSTAL_CITY")
#: Readings of at least this confidence are never taken for a misread name.
SURE = 85
#: A value of more characters than this may be two edits from a replacement.
LONG = 12
COLUMNS = ["file", "line", "s", "e", "dtype", "value", "replacement", "method"]


def _masked_spans(lines: DataFrame, table: DataFrame, key: bytes, order: str) -> DataFrame:
    """(file, line, s, e, dtype, value, replacement) of what mask() finds in lines (file, line, text)."""
    ided = lines.withColumn("row_id", F.struct("file", "line"))
    return mask.resolved_spans(ided, table, key, order=order).select("row_id.file", "row_id.line", F.explode("spans").alias("p")).select("file", "line", "p.s", "p.e", "p.dtype", "p.value", "p.replacement")


def _as_written(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """spans with `value` as the line has it: digits put right don't move offsets."""
    return spans.join(lines.select("file", "line", "text"), ["file", "line"]).withColumn("value", F.substr("text", F.col("s") + 1, F.col("e") - F.col("s"))).drop("text")


def _unique_best(found: DataFrame, table: DataFrame, canonical: Column, cap: int) -> DataFrame:
    """found (.., canon) with the table's replacement by unique nearest canonical value, if any."""
    keys = table.select(canonical.alias("key"), F.col("replacement_value").alias("replacement"))
    best = layout.fuzzy_best(found.select(F.col("canon").alias("value")), keys, cap)
    return found.join(best.select(F.col("value").alias("canon"), F.col("replacement").alias("near"), "distance"), "canon", "left")


def _loose(lines: DataFrame, pattern: str) -> DataFrame:
    return lines.select("file", "line", F.explode(detect.matches(F.col("text"), pattern)).alias("m")).select("file", "line", "m.s", "m.e", "m.value")


def candidates(words: DataFrame, table: DataFrame, key: bytes, order: str = "line_no") -> DataFrame:
    """Spans to replace in words (file, line, x, y, w, h, conf, text) as boxes with their method.

    Stages: as read; with digits put right; IBAN shapes without a valid checksum (nearest table
    entry within two edits if it is the only one, else generated: never left clear); AHV
    shapes with stray spaces likewise; unsure words close to a name of the table. A later
    stage's span that overlaps an earlier one on its line is dropped. An IBAN shape is taken with the
    one or two tokens after it too where that brings it nearer to a table entry.
    """
    words = layout.word_offsets(words)
    lines = layout.line_texts(words)
    fixed = lines.withColumn("text", X.ocr_normalize(F.col("text")))
    exact = mapping.exact_table(table, order)
    raw = _masked_spans(lines, table, key, order).withColumn("method", F.lit("exact"))
    normalized = _as_written(_masked_spans(fixed, table, key, order), lines).withColumn("method", F.lit("ocr_normalized"))
    found = raw.unionByName(layout.uncovered(normalized, raw).select(*raw.columns))

    ibans = _loose(fixed, layout.LOOSE_IBAN).where(F.size(layout.loose_ibans(F.col("value"))) > 0).join(fixed.select("file", "line", "text"), ["file", "line"])
    ibans = ibans.withColumn("more", F.explode(layout.with_tails(F.substr("text", F.col("e") + 1)))).withColumns({"e": (F.col("e") + F.length("more")).cast("int"), "value": F.concat("value", "more")})
    ibans = ibans.withColumn("canon", F.upper(X.norm(F.col("value"))))
    near = _unique_best(ibans, exact.where("data_type = 'IBAN'"), F.upper(X.norm(F.col("original_value"))), 2)
    nearest = F.min_by(F.struct("e", "value", "canon", "near", "distance"), F.struct(F.coalesce("distance", F.lit(99)), F.length("more")))
    near = near.groupBy("file", "line", "s").agg(nearest.alias("r")).select("file", "line", "s", "r.*")
    spoiled = F.concat(F.substr("canon", F.lit(1), F.lit(2)), F.lit("00"), F.substr("canon", F.lit(5)))
    iban = near.withColumn("replacement", F.coalesce("near", generate("IBAN", spoiled, key))).withColumn("method", F.when(F.col("near").isNull(), "generated_fail_closed").otherwise(F.format_string("fuzzy_mapping(d=%d)", "distance"))).withColumn("dtype", F.lit("IBAN"))
    found = found.unionByName(_as_written(layout.uncovered(iban.select(*COLUMNS), found), lines).select(*COLUMNS))

    digits = F.regexp_replace("value", "[^0-9]", "")
    ahvs = _loose(fixed, layout.LOOSE_AHV).withColumn("canon", digits)
    near = _unique_best(ahvs, exact.where("data_type = 'AHV_NUMBER'"), F.regexp_replace("original_value", "[^0-9]", ""), 2)
    form = F.regexp_replace("canon", r"^(...)(....)(....)(..)$", "$1.$2.$3.$4")
    ahv = near.withColumn("replacement", F.coalesce("near", generate("AHV_NUMBER", form, key))).withColumn("dtype", F.lit("AHV_NUMBER"))
    ahv = ahv.withColumn("method", F.when(F.col("near").isNull(), "generated_fail_closed").when(F.col("distance") == 0, "ocr_respaced").otherwise(F.format_string("fuzzy_mapping(d=%d)", "distance")))
    found = found.unionByName(_as_written(layout.uncovered(ahv.select(*COLUMNS), found), lines).select(*COLUMNS))

    names = exact.where(F.col("data_type").isin(*NAME_TYPES) & (F.length("original_value") >= 5)).withColumn("folded", X.casefold(F.col("original_value")))
    unsure = words.where((F.col("conf") < SURE) & (F.length("text") >= 5)).select("file", "line", "s", "e", F.col("text").alias("value"), X.casefold(F.regexp_replace("text", r"^[.,;:()]+|[.,;:()]+$", "")).alias("canon"))
    keys = names.select(F.col("folded").alias("key"), F.to_json(F.struct("data_type", "replacement_value")).alias("replacement"))
    best = [layout.fuzzy_best(unsure.where(size).select(F.col("canon").alias("value")), keys, cap) for cap, size in ((1, F.length("canon") < 9), (2, F.length("canon") >= 9))]
    hit = unsure.join(best[0].unionByName(best[1]).withColumnRenamed("value", "canon"), "canon")
    entry = F.from_json("replacement", "data_type string, replacement_value string")
    named = hit.select("file", "line", "s", "e", entry["data_type"].alias("dtype"), hit["value"], entry["replacement_value"].alias("replacement"), F.format_string("fuzzy_mapping(d=%d)", "distance").alias("method"))
    found = found.unionByName(layout.uncovered(named, found).select(*COLUMNS))

    spans = found.withColumn("span_id", F.struct("s", "e", "dtype", "value", "replacement", "method"))
    boxes = layout.span_boxes(spans.select("file", "line", "span_id", "s", "e"), words)
    rank = F.when(F.col("method") == "exact", 0).when(F.col("method") == "ocr_normalized", 1).otherwise(2)
    return boxes.select("file", "line", "x0", "y0", "x1", "y1", "conf", "span_id.*").withColumn("rank", rank)


def safety_net(found: DataFrame, matched: DataFrame) -> DataFrame:
    """Values of a page's whole text (page, s, value, dtype, replacement) that no line of it matched (page, value): to be searched for again, each with its first type and replacement."""
    first = found.groupBy("page", "value").agg(F.min_by(F.struct("dtype", "replacement"), F.struct("s", "dtype")).alias("r")).select("page", "value", "r.*")
    return first.join(matched.select("page", "value").distinct(), ["page", "value"], "left_anti")


def leak_suspects(found: DataFrame, replacements: DataFrame) -> DataFrame:
    """Candidates (.., value) read from masked output that are no known replacement (replacement).

    A value counts as known if it is, with or without a last token of two to four letters, within
    one edit of a replacement, or within two beyond twelve characters. Values that no edit, then that one
    edit explains go first, so that only the rest meets replacements by two deletions.
    """
    known = replacements.select(X.casefold(X.norm(F.col("replacement"))).alias("key")).distinct()
    forms = F.array(F.col("value"), F.regexp_replace("value", r"\s+[A-Za-z]{2,4}$", ""))
    rest = found.select("value").distinct().select("value", F.explode(F.array_distinct(F.transform(forms, lambda v: X.casefold(X.norm(v))))).alias("form"))
    for cap, least in ((0, 0), (1, 0), (2, LONG)):
        t = rest.where(F.length("form") > least).select("value", F.explode(layout.deletions(F.col("form"), cap)).alias("d"), "form") if cap else rest.select("value", F.col("form").alias("d"), "form")
        k = known.where(F.length("key") > least - cap).select("key", F.explode(layout.deletions(F.col("key"), cap)).alias("d")) if cap else known.select("key", F.col("key").alias("d"))
        hits = t.join(k.hint("merge"), "d").where(X.distance(F.col("form"), F.col("key"), cap) <= cap).select("value").distinct().hint("merge")
        rest = rest.join(hits, "value", "left_anti")
    left = rest.select(F.col("value").alias("left")).distinct().hint("merge")
    return found.join(left, F.col("value").eqNullSafe(F.col("left")), "left_semi")
