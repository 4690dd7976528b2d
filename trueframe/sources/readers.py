"""Declared-schema readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.corpus import census_bucket


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSONL truth rows; a malformed row stops the read, blank lines do not count."""
    return spark.read.schema(schemas.MANIFEST).json(path, mode="FAILFAST")


def scan_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PREDICTION).json(path, mode="FAILFAST")


def repeated_predictions(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("id").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


MEDIA_SUFFIX = r"(?i)\.(?:mp4|mov|mkv|avi|webm)\z"


def scan_census(entries: DataFrame) -> DataFrame:
    """Archive listing rows with label and generator from their path; media only."""
    label, generator = census_bucket(F.col("name"))
    return entries.filter(F.col("name").rlike(MEDIA_SUFFIX)).withColumns({"label": label, "generator": generator}).filter(
        "label is not null")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths and sizes under a root, without reading contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(
        "path", F.col("length").alias("bytes"))


def track_rows(files: DataFrame, path: str = "path") -> DataFrame:
    """Benchmark rows from track/real/.. and track/fake/<generator>/.. paths."""
    pattern = r"(?:^|/)(id|ood|wild)/(real|fake)/(?:([^/]+)/)?[^/]+\z"
    pick = lambda i: F.regexp_extract(path, pattern, i)
    kind, sub = pick(2), pick(3)
    return files.filter(F.col(path).rlike(MEDIA_SUFFIX) & F.col(path).rlike(pattern)).select(
        path, pick(1).alias("track"), F.when(kind == "real", "A").otherwise("B").alias("solution"),
        F.when(kind == "real", "real").otherwise(sub).alias("subcat")).filter("subcat <> ''")


def scan_track_tree(spark: SparkSession, root: str) -> DataFrame:
    return track_rows(list_files(spark, root))


def read_cache(spark: SparkSession, path: str, version: str, now_us: Column, key: str | None = None) -> DataFrame:
    """Unexpired complete results of one analyzer version; every condition is a
    plain comparison, so it reaches the Parquet scan."""
    rows = spark.read.parquet(path).filter((F.col("status") == "complete") & (F.col("analyzer_version") == version)
                                           & (F.col("expires_us") > now_us))
    return rows if key is None else rows.filter(F.col("canonical_key") == key)
