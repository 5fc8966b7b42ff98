"""Structural check of Parquet files by their magic bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import ends_of, listing

MAGIC, LEAST_BYTES, REPORTED = b"PAR1", 8, 20


def checked_files(spark: SparkSession, root: str) -> DataFrame:
    """Every Parquet file below root with what is wrong: too short, or without the magic at an end; null for nothing."""
    files = listing(spark, root).where("suffix = '.parquet'").select("path", "length")
    ends = ends_of(files, len(MAGIC), len(MAGIC))
    reason = F.when(F.col("length") < LEAST_BYTES, "short").when(F.col("head") != F.lit(MAGIC), "head").when(F.col("tail") != F.lit(MAGIC), "tail")
    return files.join(ends, "path").select("path", "length", reason.alias("reason"))


def bad_files(spark: SparkSession, root: str) -> DataFrame:
    return checked_files(spark, root).where("reason is not null")


def validate(spark: SparkSession, root: str) -> dict:
    """Files, bad ones, and the first of those, in one pass."""
    bad = F.col("reason").isNotNull()
    row = checked_files(spark, root).agg(F.count("*").alias("files"), F.count_if(bad).alias("bad")).head()
    first = [r.asDict() for r in bad_files(spark, root).orderBy("path").limit(REPORTED).collect()] if row["bad"] else []
    return {"files": row["files"], "bad": row["bad"], "first_bad": first}
