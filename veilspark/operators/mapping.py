"""Pseudonym tables: loading, merging, unions and unpivoting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

COLUMNS = ["data_type", "original_value", "replacement_value"]


def last_wins(rows: DataFrame, order: str, key: str = "original_value") -> DataFrame:
    """One row for each key, the one of the greatest `order`; partial aggregation, no sort."""
    kept = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*kept), order).alias("r")).select(key, "r.*")


def exact_table(rows: DataFrame, order: str) -> DataFrame:
    return last_wins(rows, order).select(*COLUMNS)


def normalized_table(rows: DataFrame, order: str) -> DataFrame:
    """By the case-folded value without white space; last wins among those that fall together."""
    keyed = rows.withColumn("key", X.casefold(X.norm(F.col("original_value"))))
    return last_wins(keyed, order, "key").select("key", "data_type", "replacement_value")


def strict_table(rows: DataFrame) -> DataFrame:
    """KEEP rows of (value, data_type, expected_action, strict_replacement) as a table."""
    return rows.where(F.col("expected_action") == "KEEP").select("data_type", F.col("value").alias("original_value"), F.col("strict_replacement").alias("replacement_value"))


def evidence_values(rows: DataFrame, column: str = "Detection") -> DataFrame:
    """Distinct trimmed values of three characters and more, as `key`."""
    return rows.select(F.trim(F.col(column)).alias("key")).where(F.length("key") >= 3).distinct()


def seed_rows_missing(table: DataFrame, seed: DataFrame) -> DataFrame:
    """Seed rows whose (data_type, original_value) the table lacks."""
    return seed.select(*COLUMNS).join(table.select("data_type", "original_value"), ["data_type", "original_value"], "left_anti").select(*COLUMNS)


def with_seed(table: DataFrame, seed: DataFrame) -> DataFrame:
    return table.select(*COLUMNS).unionByName(seed_rows_missing(table, seed))


def with_generated(table: DataFrame, generated: DataFrame) -> DataFrame:
    """The table and the generated pairs (original_value, replacement_value) whose key it lacks, by raw comparison, with their origin."""
    listed = table.select(*COLUMNS, F.lit("table").alias("origin"))
    new = generated.join(table.select("original_value"), "original_value", "left_anti")
    return listed.unionByName(new.select(F.lit("GENERATED").alias("data_type"), "original_value", "replacement_value", F.lit("generated").alias("origin")))


def generated_rows(json: DataFrame, column: str = "json") -> DataFrame:
    """(original_value, replacement_value) of JSON objects."""
    return json.select(F.explode(F.from_json(column, "map<string,string>")).alias("original_value", "replacement_value"))


def dictionary_keys(*tables: DataFrame) -> DataFrame:
    """Distinct `key`s of tables (original_value) and value lists (key)."""
    out = None
    for t in tables:
        k = t.select(F.col("original_value" if "original_value" in t.columns else "key").alias("key"))
        out = k if out is None else out.union(k)
    return out.where(F.length("key") >= 3).distinct()


def first_value_wins(rows: DataFrame, order: str) -> DataFrame:
    """Of rows (entity_id, data_type, value, replacement, ...) the first by `order` for each entity and type."""
    return rows.groupBy("entity_id", "data_type").agg(F.min_by(F.struct("value", "replacement"), order).alias("r")).select("entity_id", "data_type", "r.*")


def long_mapping(entities: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Unpivot wide entities (entity_id, role, ...) to (entity_id, role, field, original, replacement); fields: name to (column, replacement column)."""
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(a).cast("string").alias("original"), F.col(b).cast("string").alias("replacement")) for f, (a, b) in fields.items()])
    return entities.select("entity_id", "role", F.explode(rows).alias("r")).select("entity_id", "role", "r.*").where(F.col("original").isNotNull())
