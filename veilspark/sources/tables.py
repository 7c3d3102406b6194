"""CSV and JSON tables with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAPPING = "data_type string, original_value string, replacement_value string"
STRICT = "value string, data_type string, expected_action string, strict_replacement string"
GROUND_TRUTH = ", ".join(
    f"{c} string"
    for c in (
        "gt_id document location_type page sheet cell paragraph image_file section data_type value entity_id entity_role variant language "
        "expected_action expected_replacement strict_replacement securiti_data_element_hint native_or_custom"
    ).split()
)
DECOYS = ", ".join(f"{c} string" for c in "decoy_id document page section sheet cell kind value expected note".split())
SIGNATURES = "file string, page int, x0 double, y0 double, x1 double, y1 double, kind string, unit string"
OCR = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header; quoted fields may hold line ends; what doesn't fit the schema fails."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(path)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """A pseudonym table with each row's place, so that the last of equal keys can win."""
    rows = read_csv(spark, path, MAPPING)
    return rows.withColumn("line", F.struct(F.input_file_name(), F.monotonically_increasing_id()))


def read_ocr(spark: SparkSession, path: str, psm: int, scale: int = 1) -> DataFrame:
    """Words of a recognition program's tab-separated output, with boxes at the image's own scale: corners rounded down, sizes up."""
    raw = spark.read.schema(OCR).option("header", True).option("sep", "\t").option("quote", "").csv(path)
    words = raw.where((F.col("level") == 5) & (F.trim("text") != "")).withColumn("file", F.input_file_name())
    line = F.concat_ws("/", F.lit(scale), F.lit(psm), "block_num", "par_num", "line_num")
    down = lambda c: F.floor(F.col(c) / scale).cast("int")
    up = lambda c: F.ceil(F.col(c) / scale).cast("int")
    out = words.select("file", line.alias("line"), "word_num", F.lit(psm).alias("pass"), down("left").alias("x"), down("top").alias("y"), up("width").alias("w"), up("height").alias("h"), F.coalesce("conf", F.lit(0.0)).alias("conf"), F.trim("text").alias("text"))
    return out.dropDuplicates(["file", "line", "word_num"])


def read_scan_listing(spark: SparkSession, path: str) -> DataFrame:
    schema = "instance_ids string, last_job_status int, last_job_sub_state string, last_job_id string, scan_id string, scan_name string, last_job_scan_time string"
    return spark.read.schema(schema).json(path)
