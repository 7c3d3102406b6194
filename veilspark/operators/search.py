"""Which of many values stand in a text: one pass over the text for each length of value, and an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

#: How a value is looked for: anywhere, between the marks of edged(), or where no word goes on before or after it.
SQUEEZED, EDGES, FOLDED = "s", "e", "f"
#: A text is cut into pieces of so many characters; values beyond WIDEST are looked for in the whole text, one by one.
PIECE, WIDEST = 2048, 1024
#: Windows are taken only where a value's first characters stand, unless these are too many to tell places apart.
HEAD, HEADS = 3, 16


def key_of(value: Column, dtype: Column, is_ocr: Column) -> Column:
    """The way in which contains_prepared() looks for a value, as one letter, and then the value in that form: its needle."""

    def word(c: Column) -> Column:
        return F.when(F.startswith(c, F.lit(X.EDGE)) & F.endswith(c, F.lit(X.EDGE)), F.concat(F.lit(EDGES), c)).otherwise(F.concat(F.lit(FOLDED), X.collapse(value)))

    return F.when(dtype.isin(*X.WORD_TYPES) & ~is_ocr, X.let(X.edged(X.collapse(value)), word)).otherwise(F.concat(F.lit(SQUEEZED), X.squeeze(value)))


def _patterns(kinds: DataFrame) -> DataFrame:
    """(sid, mode, patterns, widest): for each length n of a text's needles the expression whose matches are its windows."""
    heads = kinds.select("sid", "mode", "n", "head").distinct()
    ranked = heads.withColumn("r", F.row_number().over(W.partitionBy("sid", "mode", "n").orderBy("head"))).where(F.col("r") <= HEADS + 1)
    by_size = ranked.groupBy("sid", "mode", "n").agg(F.array_sort(F.collect_list("head")).alias("heads"))
    head = F.concat(F.lit("(?:"), F.array_join(F.transform("heads", X.escape_regex), "|"), F.lit(")"))
    rest = F.col("n") - F.least(F.col("n"), F.lit(HEAD))
    body = F.when(F.size("heads") <= HEADS, F.concat(head, F.format_string(".{%d}", rest))).otherwise(F.format_string(".{%d}", "n"))
    pattern = F.when(F.col("mode") == FOLDED, F.concat(F.lit(r"(?Us)(?<=[^\w])(?=("), body, F.lit(r")(?=[^\w])).")))
    return by_size.withColumn("pattern", pattern.otherwise(F.concat(F.lit("(?s)(?=("), body, F.lit(")).")))).groupBy("sid", "mode").agg(F.collect_list("pattern").alias("patterns"), F.max("n").alias("widest"))


def standing(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """Distinct keys (sid, key), all of which stand in the text of their sid and mode (sid, mode, text), exactly; a needle (sid, key) stands there if it is one of them.

    A key is the letter of its mode and what is looked for. Pieces overlap by the longest needle of their text and have
    a blank where the text ends, so that each window lies whole in one piece and shows what is before and after it.
    The work is text times lengths plus needles, not text times needles; no task holds more than a piece.
    Needles are gone through once and not dealt: only their lengths and heads are, and those too long for windows.
    """
    needle, n = F.substr("key", F.lit(2)), F.length("key") - 1
    kinds = needles.where("key IS NOT NULL").select("sid", F.left("key", F.lit(1)).alias("mode"), n.alias("size"), F.left(needle, F.lit(HEAD)).alias("head"), F.coalesce(F.when(n > WIDEST, needle), F.lit("")).alias("needle"))
    # the length is an aggregate too and the needle never null, so that no filter on them slips below the exchange
    kinds = kinds.groupBy("sid", "mode", "size", "head", "needle").agg(F.max("size").alias("n"))
    short, texts = kinds.where(F.col("n") <= WIDEST), texts.where("sid IS NOT NULL AND mode IS NOT NULL AND text IS NOT NULL")
    laid = texts.join(_patterns(short).hint("merge"), ["sid", "mode"])
    cut = F.concat(F.array(F.lit(" ")), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), F.array(F.lit(" ")))

    def overlapping(c: Column) -> Column:
        after = lambda i: F.concat(F.get(c, i + 1), F.when(i + 3 == F.size(c), " ").otherwise(""))
        inner = F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - 2, F.lit(1))), lambda i: F.concat(F.right(F.get(c, i - 1), F.lit(1)), F.get(c, i), F.left(after(i), F.col("widest") + 1)))
        return F.when(F.size(c) == 2, F.array(F.lit("  "))).otherwise(inner)

    pieces = laid.select("sid", "mode", "patterns", F.posexplode(X.let(cut, overlapping)).alias("i", "piece")).repartition("sid", "mode", "i")
    windows = pieces.select("sid", "mode", "piece", F.explode("patterns").alias("pattern")).select("sid", "mode", F.explode(F.array_distinct(F.regexp_extract_all("piece", F.col("pattern"), F.lit(1)))).alias("needle"))
    long = kinds.where(F.col("n") > WIDEST).join(texts.hint("merge"), ["sid", "mode"])
    edge = F.regexp_like("text", F.concat(F.lit(r"(?U)(?<![\w])"), X.escape_regex(F.col("needle")), F.lit(r"(?![\w])")))
    found = windows.unionByName(long.where(F.contains("text", F.col("needle")) & ((F.col("mode") != FOLDED) | edge)).select("sid", "mode", "needle"))
    # never null: a filter that a join infers would keep the windows from being dealt once
    return found.select("sid", F.coalesce(F.concat("mode", "needle"), F.lit("")).alias("key")).distinct()
