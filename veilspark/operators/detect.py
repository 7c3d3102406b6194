"""Detection of identifiers: pattern spans, dictionary spans, overlap resolution.

A span is struct(s, e, dtype, value, rank): code point offsets, type, text and
the order of its source (0: dictionary, then the patterns in theirs).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

SPAN = "struct<s:int,e:int,dtype:string,value:string,rank:int>"
SPANS = f"array<{SPAN}>"
#: Up to so many keys the dictionary is one regular expression; beyond, a join on tokens.
REGEX_KEYS = 500
#: Keys shorter than this are never looked for.
LEAST_KEY = 3
_MARK, _STAND_IN = "\u0001", "\u0002"


@dataclass(frozen=True)
class Detector:
    """One typed pattern. validator: a test on the value; context: a test on the 8 characters before it."""

    name: str
    pattern: str
    validator: Callable[[Column], Column] | None = None
    context: Callable[[Column], Column] | None = None


_CHECKS = {"IBAN": (X.iban_is_valid, None), "AHV_NUMBER": (X.ahv_is_valid, None), "CREDIT_CARD": (X.luhn_is_valid, X.card_context_free)}
DETECTORS = tuple(Detector(name, p, *_CHECKS.get(name, (None, None))) for name, p in X.PATTERNS)


def matches(text: Column, pattern: str, dtype: str = "", rank: int = 0) -> Column:
    """All matches of a pattern as spans with exact offsets, without Python.

    Matches are set between marks by one replacement; a split then gives gaps and
    matches in turn, and a fold their running offsets. Texts without a match skip
    the fold. A mark that a text itself holds is replaced by a stand-in of the same length.
    """
    safe = F.translate(F.coalesce(text, F.lit("")), _MARK, _STAND_IN)
    parts = F.split(F.regexp_replace(safe, F.lit(X.unicode_pattern(f"({pattern})")), F.lit(f"{_MARK}$1{_MARK}")), _MARK)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.expr(f"cast(array() as {SPANS})").alias("out"))

    def step(acc: Column, part: Column) -> Column:
        end = (acc["at"] + F.length(part)).cast("int")
        span = F.struct(acc["at"].alias("s"), end.alias("e"), F.lit(dtype).alias("dtype"), part.alias("value"), F.lit(rank).alias("rank"))
        return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), F.when(acc["inside"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(parts, start, step, lambda acc: acc["out"])
    return F.when(safe.rlike(X.unicode_pattern(pattern)), found).otherwise(F.expr(f"cast(array() as {SPANS})"))


def _passes(d: Detector, text: Column) -> Callable[[Column], Column]:
    def ok(span: Column) -> Column:
        out = d.validator(span["value"]) if d.validator else F.lit(True)
        return out & d.context(F.substr(text, F.greatest(span["s"] - 7, F.lit(1)), F.least(span["s"], F.lit(8)))) if d.context else out

    return ok


def pattern_spans(text: Column, detectors: Iterable[Detector] = DETECTORS, first_rank: int = 1) -> Column:
    """Spans of all typed patterns that pass their checks."""
    found = []
    for k, d in enumerate(detectors):
        spans = matches(text, d.pattern, d.name, first_rank + k)
        if d.validator or d.context:
            spans = F.filter(spans, _passes(d, text))
        found.append(spans)
    return F.concat(*found)


def _in_order(a: Column, b: Column) -> Column:
    """Comparison by start, then longest first, then rank."""
    out = F
    for x, y in ((a["s"], b["s"]), (b["e"], a["e"]), (a["rank"], b["rank"])):
        out = out.when(x < y, -1).when(x > y, 1)
    return out.otherwise(0)


def resolve(spans: Column, kind: str = SPANS) -> Column:
    """Non-overlapping spans: leftmost first, of equal starts the longest, of equal spans the first source."""

    def step(out: Column, span: Column) -> Column:
        return F.when((F.size(out) == 0) | (span["s"] >= F.element_at(out, -1)["e"]), F.concat(out, F.array(span))).otherwise(out)

    return F.aggregate(F.array_sort(spans, _in_order), F.expr(f"cast(array() as {kind})"), step)


def dictionary_pattern(keys: Iterable[str]) -> str:
    """One alternation, longest key first, with the boundaries outside it."""
    listed = sorted({k for k in keys if len(k) >= LEAST_KEY}, key=lambda k: (-len(k), k))
    return r"(?<![\w@.])(?:" + "|".join(re.sub(r"([^\w ])", r"\\\1", k) for k in listed) + r")(?![\w@])" if listed else r"(?!)"


def rarest_tokens(keys: DataFrame) -> DataFrame:
    """(key, token, lead): of each key the word token that the fewest keys share, and its offset in the key. Keys without a word token are absent."""
    tokens = keys.select("key", F.explode(matches(F.col("key"), r"\w+")).alias("t")).select("key", F.col("t.value").alias("token"), F.col("t.s").alias("lead"))
    shared = tokens.groupBy("token").agg(F.count_distinct("key").alias("n"))
    best = F.min_by(F.struct("token", "lead"), F.struct("n", -F.length("token"), "lead"))
    return tokens.join(shared.hint("merge"), "token").groupBy("key").agg(best.alias("r")).select("key", "r.*")


def token_join_spans(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(row_id, spans) of dictionary hits in texts (row_id, text), by a join on each key's rarest word token and exact verification.

    keys: one column `key`. No cost grows with keys times texts; frequent tokens
    are spread by AQE's skew handling. Rows without a hit are absent. By the
    boundary rules every token of a key is a whole token of the text. A key of marks
    alone lies in a run of marks and is found by its first LEAST_KEY marks. Tokens and hits are
    shuffled: they are exploded after their size is estimated, and so would look fit to be broadcast.
    """
    listed = keys.where(F.length("key") >= LEAST_KEY).select("key").distinct()
    marks = listed.where(F.size(matches(F.col("key"), r"\w")) == 0).select("key", F.left("key", F.lit(LEAST_KEY)).alias("token"), F.lit(0).alias("lead"))
    keyed = rarest_tokens(listed).unionByName(marks)
    tokens = texts.select("row_id", F.explode(matches(F.col("text"), r"\w+")).alias("t")).select("row_id", F.col("t.s").alias("at"), F.col("t.value").alias("token"))
    runs = texts.select("row_id", F.explode(matches(F.col("text"), rf"\W{{{LEAST_KEY},}}")).alias("t")).select("row_id", "t.*", F.explode(F.sequence("t.s", F.col("t.e") - LEAST_KEY)).alias("at"))
    tokens = tokens.unionByName(runs.select("row_id", "at", F.substr("value", F.col("at") - F.col("s") + 1, F.lit(LEAST_KEY)).alias("token")))
    hit = tokens.join(keyed.hint("merge"), "token").select("row_id", (F.col("at") - F.col("lead")).cast("int").alias("s"), "key").where("s >= 0")
    # the text joins in once a row, where it has a candidate at all
    listed_hits = hit.groupBy("row_id").agg(F.collect_list(F.struct("s", (F.col("s") + F.length("key")).cast("int").alias("e"), F.lit("").alias("dtype"), F.col("key").alias("value"), F.lit(0).alias("rank"))).alias("spans"))
    text = F.col("text")

    def holds(p: Column) -> Column:
        before, after = F.substr(text, p["s"], F.when(p["s"] > 0, 1).otherwise(0)), F.substr(text, p["e"] + 1, F.lit(1))
        return (F.substr(text, p["s"] + 1, F.length(p["value"])) == p["value"]) & ~before.rlike(r"(?U)[\w@.]") & ~after.rlike(r"(?U)[\w@]")

    found = texts.select("row_id", "text").join(listed_hits.hint("merge"), "row_id").select("row_id", F.filter("spans", holds).alias("spans")).where(F.size("spans") > 0)
    return found.select("row_id", resolve(F.col("spans").cast(SPANS)).alias("spans"))


def dictionary_spans(texts: DataFrame, keys: DataFrame, regex_keys: int = REGEX_KEYS) -> DataFrame:
    """texts with a column `spans` of dictionary hits. Few keys: one alternation, read by the driver up to regex_keys + 1 of them; many: token_join_spans()."""
    known = [r.key for r in keys.where(F.length("key") >= LEAST_KEY).select("key").distinct().limit(regex_keys + 1).collect()]
    if len(known) <= regex_keys:
        return texts.withColumn("spans", matches(F.col("text"), dictionary_pattern(known)) if known else F.expr(f"cast(array() as {SPANS})"))
    found = token_join_spans(texts, keys)
    return texts.join(found.hint("merge"), "row_id", "left").withColumn("spans", F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")))
