"""Landed payload files and the observation envelope every parser emits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knownwhen.functions.columns import sha256_text

COLUMNS = (
    "source_id", "source_locator", "entity_id", "observed_at", "effective_at", "available_at", "vintage_at",
    "raw_content_hash", "value", "quality_flags",
)


def landed_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as (path, content, raw_content_hash); one row per payload."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return with_hash(raw)


def with_hash(payloads: DataFrame) -> DataFrame:
    return payloads.withColumn("raw_content_hash", sha256_text(F.col("content")))


def envelope(
    df: DataFrame, *, source_id: Column, locator: Column, entity: Column, available_at: Column, value: Column, flags: Column,
    observed_at: Column | None = None, effective_at: Column | None = None, vintage_at: Column | None = None,
) -> DataFrame:
    none = F.lit(None).cast("timestamp_ntz")

    def at(x: Column | None) -> Column:
        return none if x is None else x.cast("timestamp_ntz")

    return df.select(
        source_id.alias("source_id"), locator.alias("source_locator"), entity.alias("entity_id"), at(observed_at).alias("observed_at"),
        at(effective_at).alias("effective_at"), available_at.cast("timestamp_ntz").alias("available_at"), at(vintage_at).alias("vintage_at"),
        F.col("raw_content_hash"), value.alias("value"), F.array_sort(flags).alias("quality_flags"),
    )


def drifted(parsed: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """Split parsed rows by payload: any problem rejects the whole payload as SCHEMA_DRIFT.

    Returns (rows of clean payloads, one row per rejected payload with its problems).
    """
    marked = parsed.withColumn("_problem", problem)
    bad = marked.where(F.col("_problem").isNotNull()).groupBy("path").agg(F.array_sort(F.collect_set("_problem")).alias("problems"))
    good = marked.join(bad.select("path"), "path", "left_anti").drop("_problem")
    return good, bad.withColumn("code", F.lit("SCHEMA_DRIFT"))
