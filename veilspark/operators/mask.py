"""Masking: spans to replacements, all replaced at once, with a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.keyed import generate
from . import detect, mapping

ENTRY = "struct<type:string,original:string,replacement:string>"
REPLACED = "array<struct<s:int,e:int,dtype:string,value:string,rank:int,replacement:string>>"


def rewrite(text: Column, spans: Column) -> Column:
    """text with each span's `replacement` in its place; spans are in order and don't overlap."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, span: Column) -> Column:
        gap = F.substr(text, acc["at"], span["s"] + 1 - acc["at"])
        return F.struct((span["e"] + 1).cast("int").alias("at"), F.concat(acc["out"], gap, span["replacement"]).alias("out"))

    done = F.aggregate(spans, start, step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substr(text, done["at"])))


def cased(dtype: Column, value: Column, replacement: Column) -> Column:
    """Names in capitals get replacements in capitals."""
    return F.when(dtype.isin("FIRST_NAME", "LAST_NAME") & X.is_upper(value), F.upper(replacement)).otherwise(replacement)


def log(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["dtype"].alias("type"), s["value"].alias("original"), s["replacement"].alias("replacement")))


def mask_patterns(texts: DataFrame, key: bytes, detectors=detect.DETECTORS, text: str = "text") -> DataFrame:
    """texts with `spans` (with replacements) and `masked`, by typed patterns alone: projections only, no shuffle.

    Spans are a column of their own, so that the masked text doesn't evaluate the patterns again.
    """
    found = texts.withColumn("spans", detect.resolve(detect.pattern_spans(F.col(text), detectors)))
    replaced = F.transform("spans", lambda s: s.withField("replacement", generate(s["dtype"], s["value"], key)))
    found = found.withColumn("spans", F.when(F.size("spans") > 0, replaced).otherwise(F.expr(f"cast(array() as {REPLACED})")))
    return found.withColumn("masked", rewrite(F.col(text), F.col("spans")))


def resolved_spans(texts: DataFrame, table: DataFrame, key: bytes, *, order: str = "line", strict: DataFrame | None = None, use_strict: bool = False, evidence: DataFrame | None = None, regex_keys: int = detect.REGEX_KEYS) -> DataFrame:
    """(row_id, spans with replacements) of texts (row_id, text), by a pseudonym table, an optional strict table and evidence values.

    row_id must be unique; rows without a span are absent. A dictionary hit is resolved by the exact table, else by the strict
    table (ignored unless use_strict), else by the normalized table, else by its guessed
    type and a generated value. A pattern hit takes the normalized table's entry, without spaces if
    the value has none, else a generated value. Lookups are equi-joins on the distinct
    values found, so a value costs one generation however often it occurs.
    """
    exact, folded = mapping.exact_table(table, order), mapping.normalized_table(table, order)
    sources = [exact, *([mapping.strict_table(strict)] if strict is not None else []), *([evidence] if evidence is not None else [])]
    found = detect.dictionary_spans(texts.select("row_id", "text"), mapping.dictionary_keys(*sources), regex_keys)
    every = found.select("row_id", F.explode(F.concat("spans", detect.pattern_spans(F.col("text")))).alias("span"))
    values = every.select(F.col("span.value").alias("value"), (F.col("span.rank") == 0).alias("known"), F.when(F.col("span.rank") > 0, F.col("span.dtype")).alias("pattern")).distinct()
    values = values.withColumn("key", X.casefold(X.norm(F.col("value"))))
    by_key = values.join(folded.select("key", F.col("data_type").alias("n_type"), F.col("replacement_value").alias("n_rep")), "key", "left")
    by_value = by_key.join(exact.select(F.col("original_value").alias("value"), F.col("data_type").alias("x_type"), F.col("replacement_value").alias("x_rep")), "value", "left")
    if strict is not None:
        listed = mapping.strict_table(strict).groupBy("original_value").agg(F.max_by("data_type", "replacement_value").alias("s_type"), F.max("replacement_value").alias("s_rep"))
        by_value = by_value.join(listed.withColumnRenamed("original_value", "value"), "value", "left")
    else:
        by_value = by_value.withColumns({"s_type": F.lit(None).cast("string"), "s_rep": F.lit(None).cast("string")})
    guessed = X.guess_type(F.col("value"))
    hit_type = F.coalesce("x_type", "s_type", "n_type", guessed)
    made = generate(F.coalesce("pattern", guessed), F.col("value"), key)
    silent = F.col("x_rep").isNull() & F.col("s_rep").isNotNull() & F.lit(not use_strict)
    spaced = F.when(~F.contains("value", F.lit(" ")), F.replace(F.col("n_rep"), F.lit(" "), F.lit(""))).otherwise(F.col("n_rep"))
    rep = F.coalesce(F.when(F.col("known"), F.coalesce("x_rep", "s_rep", "n_rep")).otherwise(spaced), made)
    resolved = by_value.where(~(F.col("known") & silent)).select("value", "known", F.col("pattern"), F.when(F.col("known"), hit_type).otherwise(F.col("pattern")).alias("dtype"), rep.alias("replacement"))
    located = every.select("row_id", "span.s", "span.e", "span.rank", F.col("span.value").alias("value"), (F.col("span.rank") == 0).alias("known"), F.when(F.col("span.rank") > 0, F.col("span.dtype")).alias("pattern"))
    same = (located["value"] == resolved["value"]) & (located["known"] == resolved["known"]) & located["pattern"].eqNullSafe(resolved["pattern"])
    joined = located.join(resolved.hint("merge"), same).select("row_id", F.struct("s", "e", resolved["dtype"], located["value"], "rank", cased(resolved["dtype"], located["value"], F.col("replacement")).alias("replacement")).alias("span"))
    return joined.groupBy("row_id").agg(F.collect_list("span").alias("spans")).select("row_id", detect.resolve(F.col("spans").cast(REPLACED), REPLACED).alias("spans"))


def mask(texts: DataFrame, table: DataFrame, key: bytes, **options) -> DataFrame:
    """Mask texts (row_id, text): row_id, text, masked and log. Options are those of resolved_spans(). Null text stays null with an empty log."""
    spans = resolved_spans(texts, table, key, **options)
    out = texts.select("row_id", "text").join(spans.hint("merge"), "row_id", "left").withColumn("spans", F.coalesce("spans", F.expr(f"cast(array() as {REPLACED})")))
    return out.select("row_id", "text", rewrite(F.col("text"), F.col("spans")).alias("masked"), log(F.col("spans")).alias("log"))
