"""Truth joins, paired runs and execution summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import completed, is_positive, truthy
from ..functions.stats import mcnemar_exact, ratio
from .ordered import running_sums, score_bucket

TRUTH = ("group_id", "label", "split", "generator", "platform", "dataset", "transformation")


def truth_join(predictions: DataFrame, manifest: DataFrame, truth: Sequence[str] = TRUTH) -> DataFrame:
    """Predictions with the manifest's truth columns; bytes must be identical.

    Spark picks the join by size; nothing is forced to broadcast.
    """
    kept = predictions.drop(*[c for c in truth if c in predictions.columns])
    return kept.join(manifest.select("id", "sha256", *truth), ["id", "sha256"])


def truth_mismatches(predictions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Predictions that cannot be judged: unknown id, other bytes, repeated id."""
    known = manifest.select("id", F.col("sha256").alias("_expected"))
    first = predictions.join(known, "id", "left").select("id", F.when(F.col("_expected").isNull(), "unknown_id").when(
        F.col("_expected") != F.col("sha256"), "hash_mismatch").alias("problem")).filter("problem is not null")
    again = predictions.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "id", F.lit("duplicate_id").alias("problem"))
    return first.unionByName(again)


def fill_not_attempted(predictions: DataFrame, manifest: DataFrame, outcome: Sequence[str] = (
        "decision", "confidence", "error", "elapsed_ms")) -> DataFrame:
    """Every manifest row once; one without a prediction is an error row."""
    found = predictions.select("id", *outcome, F.lit(True).alias("_seen"))
    out = manifest.join(found, "id", "left")
    return out.withColumn("error", F.when(F.col("_seen").isNull(), "not_attempted").otherwise(
        F.col("error"))).drop("_seen")


def resume_pending(manifest: DataFrame, done: DataFrame, retry_errors: bool = False) -> DataFrame:
    finished = done.filter(F.col("error").isNull()) if retry_errors else done
    return manifest.join(finished.select("id"), "id", "left_anti")


def paired_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Both runs side by side, unmatched ids kept for the pairing check."""
    side = lambda df, name: df.select("id", *[F.col(c).alias(f"{name}_{c}") for c in (
        "sha256", "group_id", "label", "decision", "error")], F.lit(True).alias(f"{name}_seen"))
    return side(before, "before").join(side(after, "after"), "id", "full_outer")


def pair_violations(before: DataFrame, after: DataFrame) -> DataFrame:
    rows = paired_rows(before, after)
    differs = lambda c: ~F.col(f"before_{c}").eqNullSafe(F.col(f"after_{c}"))
    return rows.select("id", F.when(F.col("before_seen").isNull(), "missing_before").when(
        F.col("after_seen").isNull(), "missing_after").when(differs("sha256"), "hash_mismatch").when(
        differs("group_id"), "group_mismatch").when(differs("label"), "label_mismatch").alias("problem")).filter(
        "problem is not null")


def pairs(before: DataFrame, after: DataFrame) -> DataFrame:
    return paired_rows(before, after).filter("before_seen and after_seen").select(
        "id", F.col("before_group_id").alias("group_id"), F.col("before_label").alias("label"),
        "before_decision", "before_error", "after_decision", "after_error")


def _state(side: str) -> Column:
    return F.when(completed(F.col(f"{side}_error"), F.col(f"{side}_decision")),
                  F.col(f"{side}_decision")).otherwise("error")


def transitions(paired: DataFrame) -> DataFrame:
    """How decisions moved, positives and negatives apart; error is a state."""
    return paired.groupBy(
        F.when(is_positive(F.col("label")), "ai").otherwise("non_ai").alias("class"),
        _state("before").alias("before"), _state("after").alias("after")).agg(F.count(F.lit(1)).alias("n"))


def mcnemar(paired: DataFrame) -> DataFrame:
    """Discordant positives and the exact two-sided p."""
    rows = paired.filter(is_positive(F.col("label")))
    old, new = _state("before") == "ai", _state("after") == "ai"
    counts = rows.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(~old & new).alias("improved"),
                      F.count_if(old & ~new).alias("regressed"))
    return counts.withColumns({
        "recall_difference": ratio((F.col("improved") - F.col("regressed")).cast("double"), F.col("pairs")),
        "p_value": mcnemar_exact(F.col("improved"), F.col("regressed"))})


def quantiles(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Measured count, linear median and p95, nearest-rank p95 and maximum.

    Exact, from counts per distinct value and their running sums, so no group's
    values meet in one buffer.
    """
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))  # a struct, so that null keys join too
    rows = df.select(key.alias("_key"), F.col(value).alias("_value"))
    counts = rows.filter("_value IS NOT NULL").groupBy("_key", "_value").agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_sums(counts.withColumn("_band", score_bucket(F.col("_value"))), ["_key"], "_band", ["_value"], {"_upto": F.col("_n")})
    every = rows.select("_key").distinct() if keys else df.sparkSession.range(1).select(key.alias("_key"))
    met = every.join(counts.groupBy("_key").agg(F.sum("_n").alias("_total")), "_key", "left").join(ranked, "_key", "left")
    total, place = F.col("_total"), lambda q: (F.max("_total") - 1) * q
    reached = lambda at: F.min(F.when(F.col("_upto") > at, F.col("_value")))

    def linear(q: float) -> Column:
        low, high = reached(F.floor((total - 1) * q)), reached(F.ceil((total - 1) * q))
        between = (F.ceil(place(q)) - place(q)) * low + (place(q) - F.floor(place(q))) * high
        return F.when(F.ceil(place(q)) == F.floor(place(q)), low.cast("double")).otherwise(between)

    return met.groupBy("_key").agg(
        F.coalesce(F.max("_total"), F.lit(0)).alias("measured"), linear(0.5).alias("median"), linear(0.95).alias("p95"),
        reached(F.ceil(total * 0.95) - 1).cast("double").alias("p95_nearest"), F.max("_value").alias("max")).select(
        *[F.col(f"_key.{k}").alias(k) for k in keys], "measured", "median", "p95", "p95_nearest", "max")


def execution_by_pass(passes: DataFrame) -> DataFrame:
    """Recorded attempts per pass kind, mode and model; missing counts are not zeros."""
    c, key = F.col, ("kind", "mode", "model")
    times = quantiles(passes, "elapsed_ms", key).select(F.struct(*key).alias("_key"), F.col("median").alias("median_ms"), F.col("p95").alias("p95_ms"))
    return passes.groupBy(F.struct(*key).alias("_key")).agg(
        F.count(F.lit(1)).alias("observed"), F.count_if(c("status") == "complete").alias("complete"),
        F.count_if(c("status") == "failed").alias("failed"),
        F.count_if(~truthy(c("status").isin("complete", "failed"))).alias("unknown"),
        F.count_if((c("status") == "complete") & ~c("valid_for_corroboration")).alias("complete_invalid"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.count_if(c("input_tokens").isNull()).alias("missing_input"),
        F.count_if(c("output_tokens").isNull()).alias("missing_output"),
        F.count("elapsed_ms").alias("measured")).join(times, "_key").select("_key.*", "*").drop("_key")


def usage_totals(passes: DataFrame) -> DataFrame:
    c = F.col
    return passes.agg(
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.count_if(c("input_tokens").isNull() | c("output_tokens").isNull()).alias("missing_usage_passes"),
        F.count_if(~truthy(c("status") == "complete")).alias("failed_passes"))


def scan_flags(scans: DataFrame, passes: DataFrame) -> DataFrame:
    """Each scan with its trace flags; a scan without passes has no trace."""
    c = F.col
    flags = passes.groupBy("clip_id").agg(
        F.max((c("status") == "failed").cast("int")).alias("f"),
        F.max(truthy((c("status") == "complete") & ~c("valid_for_corroboration")).cast("int")).alias("i"))
    return scans.join(flags, "clip_id", "left").withColumns({
        "no_trace": c("f").isNull(), "failed_pass": truthy(c("f") == 1),
        "invalid_corroboration": truthy(c("i") == 1)}).drop("f", "i")


def parent_child(children: DataFrame, originals: DataFrame) -> DataFrame:
    """Children with their original; ``matches`` shows whether exactly one exists."""
    return children.join(originals.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("matches"), F.min("id").alias("parent_id")), "group_id", "left").withColumn(
        "matches", F.coalesce("matches", F.lit(0)))
