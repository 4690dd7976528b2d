"""Time-sampled evidence: validity, runs, coverage, verdicts and ledgers.

Samples are (case_id, <order columns>, position DECIMAL, score). They are read
in received order and never sorted by position; gaps are DECIMAL differences.
``bucket`` splits a case along that order (see ``ordered``).
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import codes, first_of, truthy
from .ordered import adjacent_pairs, islands, prefix_sums, row_rank

SCORE_THRESHOLD = 0.5
MAX_POSITIVE_GAP = Decimal("0.6")
FIRST_SAMPLE_MAX = Decimal("0.1")
MAX_GAP = Decimal("0.6")
TAIL_GAP = Decimal("0.6")


def finite(value: Column) -> Column:
    """A real number: not null, not NaN, not infinite."""
    as_double = value.cast("double")
    return value.isNotNull() & ~F.isnan(as_double) & (F.abs(as_double) < float("inf"))


def sample_validity(samples: DataFrame, duration: Column, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """Adds valid, positive (null when invalid) and issue codes to each sample."""
    here = finite(F.col("position")) & (F.col("position") >= 0) & truthy(F.col("position") < duration)
    scored = finite(F.col("score")) & F.col("score").between(0, 1)
    valid = here & scored
    return samples.withColumns({
        "valid": valid,
        "positive": F.when(valid, F.col("score") >= threshold),
        "issues": codes((~here, "position_not_in_media"), (~scored, "score_not_in_unit_interval"))})


def persistent_runs(samples: DataFrame, order: Sequence[str], bucket: str, *,
                    max_gap: Decimal = MAX_POSITIVE_GAP, min_samples: int = 2) -> DataFrame:
    """Runs of neighbouring positive samples; shorter ones are isolated alerts.

    An invalid or negative sample between two positives breaks the run.
    """
    gap = lambda a, b: b["position"] - a["position"]
    runs = islands(samples, ["case_id"], bucket, order, F.col("positive"),
                   lambda a, b: (gap(a, b) > 0) & (gap(a, b) <= F.lit(max_gap)), ["position"],
                   {"max_score": (F.col("score"), "max")})
    return runs.select(
        "case_id", *[F.col("first")[c].alias(f"first_{c}") for c in order], "n",
        F.col("first.position").alias("first_position"), F.col("last.position").alias("last_position"), "max_score",
        F.when(F.col("n") >= min_samples, "persistent").otherwise("isolated").alias("kind"))


def coverage_issues(samples: DataFrame, cases: DataFrame, order: Sequence[str], bucket: str, *,
                    first_max: Decimal = FIRST_SAMPLE_MAX, max_gap: Decimal = MAX_GAP,
                    tail_gap: Decimal = TAIL_GAP) -> DataFrame:
    """One row per coverage problem of a case: (case_id, issue, at the later sample's order)."""
    here = samples.join(cases.select("case_id"), "case_id", "left_semi")
    by = F.struct(*order)
    ends = here.groupBy("case_id").agg(
        F.count_if(~F.col("valid")).alias("invalid"),
        F.min_by(F.struct("position", "valid"), by).alias("first"),
        F.max_by(F.struct("position", "valid"), by).alias("last"))
    whole = cases.select("case_id", F.col("duration").cast("decimal(18,9)").alias("duration")).join(
        ends, "case_id", "left").select("case_id", F.explode(codes(
            (F.col("first").isNull(), "no_samples"),
            (F.col("invalid") > 0, "invalid_samples"),
            (F.col("first.valid") & (F.col("first.position") > F.lit(first_max)), "initial_coverage_gap"),
            (F.col("last.valid") & (F.col("duration") - F.col("last.position") > F.lit(tail_gap)),
             "terminal_coverage_gap"))).alias("issue"), F.lit(None).cast("long").alias("at"))
    pairs = adjacent_pairs(here, ["case_id"], bucket, order, ["position", "valid"])
    gap = F.col("cur.position") - F.col("prev.position")
    both = F.col("prev.valid") & F.col("cur.valid")
    inner = pairs.select("case_id", first_of(
        (both & (gap <= 0), "positions_not_increasing"), (both & (gap > F.lit(max_gap)), "coverage_gap")).alias("issue"),
        F.col("cur")[order[-1]].cast("long").alias("at")).filter("issue is not null")
    return whole.unionByName(inner)


def temporal_verdict(cases: DataFrame, issues: DataFrame, runs: DataFrame,
                     technical: Column | None = None) -> DataFrame:
    """Verdict per case. Incomplete coverage can keep alerts but decides nothing."""
    bad = issues.groupBy("case_id").agg(F.count(F.lit(1)).alias("coverage_issues"))
    hits = runs.groupBy("case_id").agg(F.count_if(F.col("kind") == "persistent").alias("persistent"),
                                       F.count_if(F.col("kind") == "isolated").alias("isolated"))
    rows = cases.join(bad, "case_id", "left").join(hits, "case_id", "left").fillna(
        0, ["coverage_issues", "persistent", "isolated"])
    usable = (F.col("duration") > 0) & (truthy(technical) if technical is not None else F.lit(True))
    done = usable & (F.col("coverage_issues") == 0)
    verdict = first_of((~truthy(done), "inconclusive"), (F.col("persistent") > 0, "persistent_ai_indicators"),
                       (F.col("isolated") > 0, "inconclusive"), otherwise="no_clear_indicators")
    return rows.withColumns({"complete": truthy(done), "verdict": verdict}).withColumn(
        "review_required", (F.col("verdict") == "inconclusive") | (F.col("isolated") > 0))


def max_score_verdict(samples: DataFrame, cases: DataFrame, order: Sequence[str], bucket: str, *,
                      first_max: float = 0.1, max_gap: float = 0.6, tail_gap: float = 0.6,
                      hit_from: float = 3.0, hit_to: float = 5.0, mixed: Column | None = None) -> DataFrame:
    """The older rule: any positive sample decides, with a 1e-9 tolerance on gaps.

    Every planned case stays; one without samples is not covered. Cases for
    which ``mixed`` holds also tell whether every hit falls in their interval.
    """
    pos = F.col("position").cast("double")
    hit = F.col("valid") & (F.col("score") >= SCORE_THRESHOLD)
    by = F.struct(*order)
    facts = samples.groupBy("case_id").agg(
        F.max(F.when(F.col("valid"), F.col("score"))).alias("max_score"),
        F.count_if(~F.col("valid")).alias("invalid"), F.count_if(hit).alias("hits"),
        F.count_if(hit & (pos >= hit_from) & (pos < hit_to)).alias("hits_inside"),
        F.min_by(pos, by).alias("first"), F.max_by(pos, by).alias("last"))
    step = F.col("cur.position").cast("double") - F.col("prev.position").cast("double")
    gaps = adjacent_pairs(samples, ["case_id"], bucket, order, ["position"]).groupBy("case_id").agg(
        F.count_if((step <= 0) | (step > max_gap + 1e-9)).alias("broken"))
    rows = cases.join(facts, "case_id", "left").join(gaps, "case_id", "left").fillna(0, ["broken", "hits"])
    covered = truthy((F.col("invalid") == 0) & (F.col("first") <= first_max) & (F.col("broken") == 0)
                     & (F.col("duration") - F.col("last") <= tail_gap + 1e-9))
    located = (F.col("hits") > 0) & (F.col("hits") == F.col("hits_inside"))
    return rows.select(
        "case_id", "max_score", (F.col("max_score") >= SCORE_THRESHOLD).alias("any_positive"),
        covered.alias("covered"),
        F.when(covered, F.when(F.col("max_score") >= SCORE_THRESHOLD, "ai").otherwise("not_ai")).alias("decision"),
        (located if mixed is None else F.when(mixed, located)).alias("localized"))


def verdict_stability(recomputed: DataFrame, saved: DataFrame) -> DataFrame:
    """Cases whose saved verdict is not what the rule gives now (nulls compare equal)."""
    return recomputed.select("case_id", "verdict").join(
        saved.select("case_id", F.col("verdict").alias("saved")), "case_id", "full_outer").filter(
        ~F.col("verdict").eqNullSafe(F.col("saved")))


def reserved_operations(duration: Column, interval: float = 0.5, per_sample: int = 5) -> Column:
    return per_sample * (F.ceil(duration / interval) + 1)


def op_reservation(runs: DataFrame) -> DataFrame:
    """Accounting issues of each run: (id, duration, frames, operations)."""
    return runs.withColumn("reserved", reserved_operations(F.col("duration"))).withColumn("issues", codes(
        (F.col("operations").isNull() | (F.col("operations") < 0), "unknown_operations"),
        (F.col("operations") > F.col("reserved"), "operations_exceed_reservation"),
        (F.col("frames") > F.col("reserved") / 5, "excess_frames"),
        (~F.col("operations").eqNullSafe(5 * F.col("frames")), "operations_frame_count_mismatch")))


def op_ledger(runs: DataFrame, cap: int, block: int = 4096) -> DataFrame:
    """Running total of reported operations in run order, checked against the
    saved total, with the rows past the cap marked."""
    scanned = prefix_sums(runs, [], F.col("run_no"), [F.col("run_no")], {"observed": F.coalesce(F.col("reported"), F.lit(0))}, block)
    return scanned.select("run_no", "reported", "observed", "saved",
                          (~F.col("observed").eqNullSafe(F.col("saved"))).alias("ledger_mismatch"),
                          (F.col("observed") > cap).alias("over_cap"))


def byte_ledger(events: DataFrame, budget: int, block: int = 4096) -> DataFrame:
    """Reservations accumulate and are never refunded; sequence must be gapless."""
    reserve = F.when(F.col("kind") == "reserve", F.col("bytes")).otherwise(0)
    scanned = prefix_sums(events, [], F.col("seq"), [F.col("seq")], {"reserved": reserve, "expected": F.lit(1)}, block)
    return scanned.select("seq", "kind", "reserved", first_of(
        (F.col("sequence") != F.col("expected") - 1, "sequence_gap"),
        ((F.col("kind") == "reserve") & (F.col("bytes") <= 0), "invalid_reservation"),
        ((F.col("kind") == "reserve") & (F.col("reserved") > budget), "over_budget")).alias("problem"))


def error_streak(rows: DataFrame, order: Sequence[str], bucket: str, length: int = 3) -> DataFrame:
    """First point of each run where ``length`` consecutive errors are identical,
    and how many rows came after it and would not have been started.

    Rows that tie in ``order`` are rows of their own, so they are counted by place."""
    placed = row_rank(rows, ["case_id"], bucket, [F.col(c) for c in order], "_place")
    streaks = islands(placed, ["case_id"], bucket, ["_place", *order], F.col("error").isNotNull(),
                      lambda a, b: a["error"] == b["error"], ["error"], keep_first=length)
    at = F.element_at("firsts", length)
    stop = streaks.filter(F.col("n") >= length).groupBy("case_id").agg(F.min(at).alias("stop"), F.min_by("first.error", at).alias("error"))
    whole = rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("rows"))
    return stop.join(whole, "case_id").select(
        "case_id", *[F.col("stop")[c].alias(f"stop_{c}") for c in order], "error", (F.col("rows") - F.col("stop._place")).alias("not_started"))


def sample_flag_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("case_id").agg(
        F.count_if(F.col("valid") & F.col("positive")).alias("flagged"), F.count(F.lit(1)).alias("total"))


def paired_positions(original: DataFrame, degraded: DataFrame, keys: Sequence[str] = ("parent_id", "position")) -> DataFrame:
    """Samples of an original and its derivative matched on position, or on one side only."""
    left = original.select(*keys, F.col("score").alias("original_score"), F.lit(True).alias("_l"))
    right = degraded.select(*keys, F.col("score").alias("degraded_score"), F.lit(True).alias("_r"))
    return left.join(right, list(keys), "full_outer").withColumn("side", first_of(
        (F.col("_l").isNull(), "degraded_only"), (F.col("_r").isNull(), "original_only"), otherwise="both")).drop("_l", "_r")


def screen_admission(cases: DataFrame, cap: int, max_bytes: int = 50_000_000) -> tuple[DataFrame, DataFrame]:
    """Problems of a planned case list, and its summed reservation against the cap."""
    repeats = lambda key, code: cases.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("i")).filter(
        "n > 1").select(F.col("i").alias("id"), F.lit(code).alias("problem"))
    bounds = cases.select("id", F.explode(codes(
        (F.col("duration").isNull() | (F.col("duration") <= 0) | (F.col("duration") >= 60), "unsupported_duration"),
        (F.col("bytes").isNull() | ~F.col("bytes").between(1, max_bytes), "media_byte_limit"))).alias("problem"))
    total = cases.agg(F.sum(reserved_operations(F.col("duration"))).alias("reserved")).withColumn(
        "within_cap", F.col("reserved") <= cap)
    return bounds.unionByName(repeats("id", "duplicate_id")).unionByName(repeats("sha256", "duplicate_bytes")), total
