"""Decision, band and reject rules as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DECISIONS = ("ai", "not_ai", "abstain")

# Verdict wording accepted for each decision.
VERDICT_WORDS = {
    "ai": ("probably ai", "likely ai", "likely synthetic", "ai detected", "ai evidence found"),
    "not_ai": ("probably not ai", "unlikely ai", "unlikely to be ai", "likely authentic"),
    "abstain": ("inconclusive", "uncertain", "not enough evidence", "no reliable evidence of ai found"),
}

# Error text patterns in order of priority.
ERROR_PATTERNS = (
    (r"(?i)quota|429|rate.limit", "ProviderRateLimit"),
    (r"(?i)401|403|permission|api.key|unauthorized|authentication", "ProviderAuthentication"),
    (r"(?i)timeout|timed.out|abort", "OperationalTimeout"),
    (r"(?i)schema|json|parse|invalid", "ResponseValidationError"),
    (r"(?i)upload|processing|file", "MediaProcessingError"),
)


def first_of(*cases: tuple[Column, object], otherwise: object = None) -> Column:
    """First matching case; later conditions are not reached."""
    chain = F
    for condition, value in cases:
        chain = chain.when(condition, value if isinstance(value, Column) else F.lit(value))
    return chain.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def codes(*cases: tuple[Column, str]) -> Column:
    """Array of the codes whose condition is true (null counts as false)."""
    return F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in cases]))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def truthy(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def is_positive(label: Column) -> Column:
    return label.isin("ai", "mixed")


def is_negative(label: Column) -> Column:
    return label.isin("real", "cgi")


def completed(error: Column, decision: Column) -> Column:
    """Finished without an error and with a known decision."""
    return error.isNull() & truthy(decision.isin(*DECISIONS))


def decision_of(decision: Column, verdict: Column) -> Column:
    """An explicit decision wins; otherwise the verdict wording decides; else null."""
    word = F.lower(F.coalesce(verdict, F.lit("")))
    return F.coalesce(
        F.when(decision.isin(*DECISIONS), decision),
        first_of(*[(word.isin(*words), name) for name, words in VERDICT_WORDS.items()]))


def score_band(likelihood: Column) -> tuple[Column, Column, Column]:
    """Clamped whole score, decision and confidence band of the plain rule."""
    # floor(x + .5) rounds halves up, as the published rule does
    score = F.when(likelihood.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(99), F.floor(likelihood + 0.5)))).cast("int")
    return score, first_of((score >= 50, "ai"), otherwise="not_ai"), first_of(
        ((score >= 85) | (score <= 15), "High"), ((score >= 65) | (score <= 35), "Medium"), otherwise="Low")


def disagreement_band(prob: Column, disagreement: Column) -> tuple[Column, Column]:
    """Verdict and confidence when detector branches may disagree."""
    return (first_of((prob > 0.5, "ai_generated"), otherwise="real"),
            first_of((disagreement > 0.4, "low"), (prob > 0.85, "high"), (prob > 0.65, "medium"),
                     (prob > 0.35, "low"), otherwise="high"))


def error_category(message: Column) -> Column:
    return first_of(
        (message.startswith("IdentityMismatch:"), message),
        *[(message.rlike(pattern), name) for pattern, name in ERROR_PATTERNS],
        otherwise="UnclassifiedOperationalError")


def media_reject(size: Column, duration: Column, width: Column, height: Column, rate: Column, *,
                 max_bytes: int, max_seconds: float, max_dimension: int = 4096, max_rate: float = 240) -> Column:
    """First media bound that fails; null when all hold."""
    return first_of(
        (size.isNull() | (size <= 0) | (size > max_bytes), "size_outside_bound"),
        (duration.isNull() | (duration <= 0) | (duration > max_seconds), "duration_outside_bound"),
        (width.isNull() | height.isNull() | ~width.between(1, max_dimension) | ~height.between(1, max_dimension),
         "dimensions_outside_bound"),
        (rate.isNull() | (rate <= 0) | (rate > max_rate), "rate_outside_bound"))


def quality_reject(frames: Column, width: Column, height: Column, rate: Column, *,
                   min_frames: int, min_resolution: int, min_seconds: float) -> Column:
    """First quality floor that fails; null when the clip may be used."""
    seconds = F.when(rate > 0, frames / rate).otherwise(F.lit(0.0))
    return first_of((frames < min_frames, "too_few_frames"),
                    (F.least(width, height) < min_resolution, "low_resolution"),
                    (seconds < min_seconds, "too_short"))
