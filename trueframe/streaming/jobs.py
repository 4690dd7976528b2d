"""Structured Streaming jobs over event streams."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.joins import dedupe_by_key
from .processors import Admission, Coalesce, ErrorStop, Ordered, Runs
from .tables import account

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WINDOW_US = 15 * 60 * 1_000_000


def stateful(stream: DataFrame, key: str, processor: Ordered) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return stream.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.output, outputMode="Append", timeMode="None")


def admission(stream: DataFrame, key: str, limit: int = 5, window_us: int = WINDOW_US) -> DataFrame:
    """Sliding-log rate limit: (key, at_us, event_id) rows to outcomes."""
    return stateful(stream.select(key, "at_us", "event_id"), key, Admission(limit, window_us))


def coalesce_requests(stream: DataFrame, key: str, flight_us: int) -> DataFrame:
    """Every request with the request whose result serves it."""
    return stateful(stream.select(key, "at_us", "event_id"), key, Coalesce(flight_us))


def first_requests(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Cheap form of ``coalesce_requests`` for live streams whose batches are
    shorter than a flight: only the first request per key inside the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def runs(stream: DataFrame, max_gap_nano: int) -> DataFrame:
    return stateful(stream.select("case_id", "at_us", "event_id", "nano", "score", "valid"), "case_id", Runs(max_gap_nano))


def error_stop(stream: DataFrame, length: int = 3) -> DataFrame:
    return stateful(stream.select("case_id", "at_us", "event_id", "error"), "case_id", ErrorStop(length))


def to_files(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    return (stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def cache_join(requests: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """Requests with the unexpired same-version result of their key, else fresh work."""
    hits = cache.filter((F.col("status") == "complete") & (F.col("analyzer_version") == version)).select(
        "canonical_key", "expires_us", F.col("final_score").alias("cached_score"))
    return requests.join(hits, (requests["canonical_key"] == hits["canonical_key"]) & (hits["expires_us"] > requests["at_us"]), "left").select(
        requests["event_id"], requests["canonical_key"], "cached_score", F.col("cached_score").isNotNull().alias("served"))


BUCKETS = 256


def table_bucket(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def cache_upsert(stream: DataFrame, table: str, staging: str, checkpoint: str, reusable: Column,
                 key: str = "canonical_key", order: tuple[str, ...] = ("analyzed_us", "event_id"), buckets: int = BUCKETS) -> StreamingQuery:
    """Keyed table of the latest reusable result.

    The table is partitioned by key bucket. A batch is reduced to one row per
    key, merged with the buckets it touches into a staging folder, and those
    buckets are then replaced. Taking the latest row is idempotent, so a batch
    that is run again after a failure leaves the same table.
    """
    names = list(dict.fromkeys([c for c in stream.columns if c != key]))

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = dedupe_by_key(batch.filter(reusable), key, list(order), names).withColumn("bucket", table_bucket(F.col(key), buckets))
        stage = f"{staging}/{number}"
        newest.write.mode("overwrite").partitionBy("bucket").parquet(f"{stage}/new")
        new = spark.read.schema(newest.schema).parquet(f"{stage}/new")
        old = existing(spark, table, new)
        merged = new if old is None else new.unionByName(old.join(new.select("bucket").distinct(), "bucket", "left_semi"))
        latest = dedupe_by_key(merged, key, list(order), [*names, "bucket"])
        latest.write.mode("overwrite").partitionBy("bucket").parquet(f"{stage}/merged")
        done = spark.read.schema(new.schema).parquet(f"{stage}/merged")
        (done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table))

    return (stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def existing(spark: SparkSession, table: str, like: DataFrame) -> DataFrame | None:
    """The table as it is, or None before its first batch."""
    try:
        return spark.read.schema(like.schema).parquet(table)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def op_budget(stream: DataFrame, budget: int, folder: str, checkpoint: str) -> StreamingQuery:
    """Running reserved amount over all rows and the rows past the budget (``tables.account``)."""
    return account(stream, budget, folder, checkpoint)
