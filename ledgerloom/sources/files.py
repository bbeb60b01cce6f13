"""Reading what arrives as files, and writing sheets. Every path goes through Spark's own readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import csv_safe


def text_segments(spark: SparkSession, path: str) -> DataFrame:
    """(path, locator, text): the lines of text files that aren't blank, located as `lines:n`."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    lines = whole.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("n", "text"))
    return lines.where(F.trim("text") != "").select("path", F.concat(F.lit("lines:"), (F.col("n") + 1).cast("string")).alias("locator"), F.trim("text").alias("text"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha) of every file below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha"))


def content_addressed(spark: SparkSession, path: str, most_bytes: int = 2 << 20) -> DataFrame:
    """(sha, text, finding) of files named by their SHA-256: TOO_LARGE, HASH_MISMATCH or null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = F.regexp_extract("path", r"([0-9a-f]{64})[^/]*$", 1)
    finding = F.when(F.col("length") > most_bytes, "TOO_LARGE").when(F.sha2("content", 256) != named, "HASH_MISMATCH")
    return files.select(named.alias("sha"), F.col("content").cast("string").alias("text"), finding.alias("finding"))


def to_prepare(listed: DataFrame, done: DataFrame) -> DataFrame:
    """Files that haven't been prepared with the content they have now."""
    return listed.join(done.select("path", "sha"), ["path", "sha"], "left_anti")


def sheet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of CSV files with a fixed header and typed columns; `error` holds a line that doesn't fit."""
    full = T.StructType([*schema.fields, T.StructField("error", T.StringType())])
    return spark.read.schema(full).option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "error").csv(path)


def write_sheet(df: DataFrame, path: str) -> None:
    """CSV with a header in the frame's order; no cell starts a formula."""
    safe = [csv_safe(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema]
    df.select(*safe).write.option("header", True).csv(path)


def golden_cases(spark: SparkSession, path: str, schema: T.StructType, required: list[str]) -> DataFrame:
    """Cases of JSON files, with `errors`: required fields that are missing."""
    cases = spark.read.schema(schema).option("multiLine", True).json(path)
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"MISSING_{c.upper()}")) for c in required]))
    return cases.withColumn("errors", missing)


#: What one fetched page of a remote source holds; adapters write these as JSON files for Spark to read.
PAGE = T.StructType(
    [
        T.StructField("area", T.StringType()), T.StructField("batch", T.LongType()), T.StructField("cursor", T.StringType()), T.StructField("next_cursor", T.StringType()),
        T.StructField("terminal", T.BooleanType()), T.StructField("source_total", T.LongType()), T.StructField("rows", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
    ]
)


def pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE).json(path)


def page_rows(fetched: DataFrame, key: str) -> DataFrame:
    """(area, batch, place, key, fields): rows of pages; such as lack the key have it null and count as malformed."""
    flat = fetched.select("area", "batch", F.posexplode("rows").alias("place", "fields"))
    return flat.select("area", "batch", "place", F.element_at("fields", F.lit(key)).alias("key"), "fields")


def scan_diagnostics(fetched: DataFrame) -> DataFrame:
    """Per area: batches, rows, whether the last page was seen, and the issues CURSOR_CYCLE, TOTAL_CHANGED and TOTAL_MISMATCH."""
    told = fetched.groupBy("area").agg(
        F.count("*").alias("batches"), F.sum(F.size("rows")).alias("rows"), F.bool_or(F.coalesce("terminal", F.lit(False))).alias("complete"),
        F.count("cursor").alias("__c"), F.count_distinct("cursor").alias("__d"), F.count_distinct("source_total").alias("__t"), F.max("source_total").alias("__m"),
    )
    issues = F.array_compact(F.array(
        F.when(F.col("__c") > F.col("__d"), "CURSOR_CYCLE"), F.when(F.col("__t") > 1, "TOTAL_CHANGED"), F.when(F.col("complete") & (F.col("__m") != F.col("rows")), "TOTAL_MISMATCH"),
    ))
    return told.select("area", "batches", "rows", "complete", issues.alias("issues"))


def content_profile(characters: Column, images: Column) -> Column:
    """What a page holds: TEXT_ONLY, IMAGE_ONLY, MIXED_CONTENT or EMPTY."""
    return F.when((characters > 0) & (images > 0), "MIXED_CONTENT").when(characters > 0, "TEXT_ONLY").when(images > 0, "IMAGE_ONLY").otherwise("EMPTY")
