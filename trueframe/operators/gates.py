"""Cohort counts, parent roll-ups and frozen acceptance gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import first_of, is_positive, truthy
from ..functions.stats import ratio

AI, CLEAR, UNSETTLED = "persistent_ai_indicators", "no_clear_indicators", "inconclusive"
FAILED = ("technical_error", "not_attempted")


def cohort_counts(rows: DataFrame, keys: Sequence[str] = ("cohort",)) -> DataFrame:
    said = lambda *v: F.count_if(F.col("decision").isin(*v))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), said(AI).alias("ai"), said(CLEAR).alias("clear"),
        said(UNSETTLED).alias("inconclusive"), said("technical_error").alias("technical_error"),
        said("not_attempted").alias("not_attempted"),
        F.count_if(F.col("isolated") > 0).alias("cases_with_isolated"), F.sum("isolated").alias("isolated_alerts"),
        F.count_if((F.col("decision") == UNSETTLED) | (F.col("isolated") > 0)).alias("review_required"))


def parent_rollup(rows: DataFrame) -> DataFrame:
    """One decision per (cohort, parent): failure over alert over unsettled over clear."""
    rank = first_of((F.col("decision").isin(*FAILED), 3), (F.col("decision") == AI, 2),
                    (F.col("decision") == UNSETTLED, 1), otherwise=0)
    return rows.groupBy("cohort", "parent_id").agg(
        F.max(rank).alias("r"), F.max((F.col("decision") == AI).cast("int")).alias("a"),
        F.count(F.lit(1)).alias("files"), F.sum("isolated").alias("isolated_alerts"),
        F.count_if(F.col("isolated") > 0).alias("cases_with_isolated")).select(
        "cohort", "parent_id", first_of((F.col("r") == 3, "technical_error"), (F.col("r") == 2, AI),
                                        (F.col("r") == 1, UNSETTLED), otherwise=CLEAR).alias("decision"),
        (F.col("a") == 1).alias("has_alert"), "files", "isolated_alerts", "cases_with_isolated")


def gate_table(spark, rules: Sequence[tuple]) -> DataFrame:
    """(gate, cohort, quality or null, unit file/parent, decision, low or null, high or null)."""
    return spark.createDataFrame(list(rules), "gate string, cohort string, quality string, unit string, "
                                              "decision string, low long, high long")


def acceptance_gates(rows: DataFrame, gates: DataFrame) -> DataFrame:
    """Observed count of each gate against its bounds; a gate with no rows counts 0."""
    files = rows.groupBy("cohort", "quality", "decision").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "unit", F.lit("file"))
    parents = parent_rollup(rows).groupBy("cohort", "decision").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "unit", F.lit("parent")).withColumn("quality", F.lit(None).cast("string"))
    counts = files.unionByName(parents).withColumnsRenamed({c: f"c_{c}" for c in ("cohort", "quality", "unit", "decision")})
    # counts hold at most cohorts x qualities x decisions rows
    hit = gates.join(counts, (F.col("cohort") == F.col("c_cohort")) & (F.col("unit") == F.col("c_unit")) & (
        F.col("decision") == F.col("c_decision")) & (F.col("quality").isNull() | F.col("quality").eqNullSafe(F.col("c_quality"))), "left")
    seen = hit.groupBy("gate", "low", "high").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("observed"))
    return seen.select("gate", "observed", "low", "high", (
        (F.col("low").isNull() | (F.col("observed") >= F.col("low")))
        & (F.col("high").isNull() | (F.col("observed") <= F.col("high")))).alias("passed"))


def head_delta(pairs: DataFrame) -> DataFrame:
    """Two heads on the same clips: changed decisions, net gain on positives, new
    false flags. Only clips where both heads decided are compared."""
    both = pairs.filter(F.col("candidate").isNotNull() & F.col("control").isNotNull())
    a, b, pos = F.col("candidate"), F.col("control"), is_positive(F.col("label"))
    return both.agg(
        F.count(F.lit(1)).alias("compared"), F.count_if(a != b).alias("changed"),
        (F.count_if(pos & a) - F.count_if(pos & b)).alias("net_ai_gain"),
        F.count_if(~pos & a & ~b).alias("new_false_flags"))


def robustness_matrix(rows: DataFrame, qualities: Sequence[str] = ("original", "mild", "severe")) -> DataFrame:
    """Worst outcome of each source at each quality, one column per quality."""
    rank = first_of((F.col("decision").isin(*FAILED), 3), (F.col("decision") == UNSETTLED, 2),
                    (F.col("decision") == CLEAR, 1), otherwise=0)
    worst = rows.groupBy("parent_id").pivot("quality", list(qualities)).agg(F.max(rank))
    name = lambda q: first_of((F.col(q) == 3, "technical_error"), (F.col(q) == 2, UNSETTLED),
                              (F.col(q) == 1, CLEAR), (F.col(q) == 0, AI))
    return worst.select("parent_id", *[name(q).alias(q) for q in qualities])


def stage_gate(cases: DataFrame, windows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Whether every case of a stage is error-free, correct and agrees with its raw scores."""
    hits = windows.groupBy("id").agg(F.max(F.when(F.col("score") >= threshold, 1).otherwise(0)).alias("hit"))
    pos = is_positive(F.col("label"))
    good = (F.col("error").isNull() & truthy(F.col("decision") == F.when(pos, "ai").otherwise("not_ai"))
            & truthy((F.col("hit") == 1) == pos))
    return cases.join(hits, "id", "left").groupBy("stage").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(~truthy(good)).alias("failed"),
        F.bool_and(truthy(good)).alias("passed"))


def quota_check(rows: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells whose count or byte total is not the planned one; null keys are a cell."""
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("total_bytes"))
    a = found.select(F.to_json(F.struct(*keys)).alias("cell"), "n", "total_bytes")
    b = expected.select(F.to_json(F.struct(*keys)).alias("cell"), F.col("n").alias("planned"))
    return a.join(b, "cell", "full_outer").select(
        "cell", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("planned", F.lit(0)).alias("planned"),
        F.coalesce("total_bytes", F.lit(0)).alias("total_bytes"),
        F.col("n").eqNullSafe(F.col("planned")).alias("met"))


def byte_totals(rows: DataFrame, header: int = 30, extra_max: int = 4096) -> DataFrame:
    """Sums that bound the ranged reads of the selected archive members."""
    out = rows.agg(F.count(F.lit(1)).alias("members"), F.sum("compressed_bytes").alias("compressed"),
                   F.sum("uncompressed_bytes").alias("uncompressed"), F.sum(F.octet_length("name")).cast("long").alias("names"))
    return out.withColumn("headers", header * F.col("members")).withColumn("extra_max", extra_max * F.col("members")).withColumn(
        "first_attempt_max", F.col("compressed") + F.col("headers") + F.col("names") + F.col("extra_max"))


def cohort_shares(counts: DataFrame) -> DataFrame:
    """Detection and clear shares of each cohort row, null without cases."""
    return counts.withColumns({"detected_share": ratio(F.col("ai"), F.col("total")),
                               "clear_share": ratio(F.col("clear"), F.col("total"))})
