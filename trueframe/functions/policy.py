"""Verdict rules over one clip report per row.

A report row has ai_likelihood, visual_classification, visual_assessment,
audio_assessment, identity_manipulation, evidence_sufficiency, ``moments``
(array of timestamp, severity, category), the inspection fields
review_agreement, visual_coverage, temporal_coverage, audio_coverage,
invalid_observations, duration, and the source fields provenance_*,
disclosed, creator_admission. Reasons are stable codes, not sentences.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import codes, first_of, truthy

TIMESTAMP = r"^(?:\d{1,2}:)?\d{1,3}:\d{2}(?:\.\d{1,3})?\z"


def moment_seconds(text: Column) -> Column:
    """"[H:]M:SS.s" as seconds; null when malformed or a part is 60 or more."""
    parts = F.transform(F.split(text, ":"), lambda p: p.try_cast("double"))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60 + p)
    fits = (F.element_at(parts, -1) < 60) & ((F.size(parts) < 3) | (F.get(parts, F.lit(1)) < 60))
    # the guard keeps split from running on text that is not a timestamp
    return F.when(text.rlike(TIMESTAMP), F.when(fits, total))


def moment_invalid(moment: Column, duration: Column) -> Column:
    seconds = moment_seconds(moment["timestamp"])
    return seconds.isNull() | truthy(seconds > duration)


def modalities() -> dict[str, Column]:
    c = F.col
    return {
        "visual": truthy(c("visual_assessment").isin("generated", "edited")
                         | c("visual_classification").isin("likely_ai_generated", "mixed_or_ai_edited")),
        "audio": truthy(c("audio_assessment").isin("synthetic", "likely_synthetic")),
        "identity": truthy(c("identity_manipulation").isin("face_swap", "lip_sync_manipulation"))}


def direction() -> Column:
    c = F.col
    positive = (c("visual_classification").isin("likely_ai_generated", "possibly_ai_generated", "mixed_or_ai_edited")
                | c("visual_assessment").isin("generated", "edited")
                | c("audio_assessment").isin("synthetic", "likely_synthetic")
                | c("identity_manipulation").isin("face_swap", "lip_sync_manipulation"))
    negative = (c("visual_classification") == "likely_not_ai_generated") & (c("visual_assessment") == "likely_authentic")
    return first_of((truthy(positive), "positive"), (truthy(negative), "negative"), otherwise="uncertain")


def profile() -> Column:
    """Direction and positive modalities of a pass, equal when two passes agree."""
    c = F.col
    flag = lambda cond: F.when(truthy(cond), "1").otherwise("0")
    return F.concat_ws("/", direction(), flag(c("visual_assessment").isin("generated", "edited")),
                       flag(c("audio_assessment").isin("synthetic", "likely_synthetic")),
                       flag(c("identity_manipulation").isin("face_swap", "lip_sync_manipulation")))


def substantive() -> Column:
    """Valid moments of medium or high severity."""
    return F.filter("moments", lambda m: m["severity"].isin("medium", "high") & ~moment_invalid(m, F.col("duration")))


def invalid_count() -> Column:
    return F.size(F.filter("moments", lambda m: moment_invalid(m, F.col("duration"))))


def grounding() -> dict[str, Column]:
    """Which positive modalities a substantive moment supports."""
    pos = modalities()
    strong = F.col("_strong")
    has = lambda test: F.exists(strong, test)
    lips = truthy(F.col("identity_manipulation") == "lip_sync_manipulation")
    return {
        "visual": pos["visual"] & has(lambda m: m["category"] != "audio"),
        "audio": pos["audio"] & has(lambda m: m["category"] == "audio"),
        "identity": pos["identity"] & has(lambda m: (m["category"] == "identity") | (lips & (m["category"] == "audio")))}


def consistency_codes(has_audio: Column | None = None) -> Column:
    """Contradictions inside one report; needs ``_strong`` (see ``substantive``)."""
    c, pos = F.col, modalities()
    any_pos = pos["visual"] | pos["audio"] | pos["identity"]
    score = c("ai_likelihood")
    says_no = truthy(c("visual_classification") == "likely_not_ai_generated")
    silent = c("audio_coverage").isin("unavailable", "no_audio")
    if has_audio is not None:
        silent = silent | ~has_audio
    whole = truthy((score == F.floor(score)) & score.between(1, 99)) & ~F.isnan(score)
    return codes(
        (~whole, "score_invalid"),
        ((score >= 65) & ~any_pos & says_no, "strong_score_against_visuals"),
        (pos["visual"] & says_no, "visual_assessment_against_classification"),
        ((c("visual_classification") == "likely_ai_generated") & (c("visual_assessment") == "likely_authentic"),
         "classification_against_visual_assessment"),
        ((pos["visual"] | pos["identity"]) & (c("visual_coverage") == "unavailable"), "visual_finding_without_inspection"),
        (pos["audio"] & silent, "audio_finding_without_audio"),
        ((F.size("_strong") > 0) & ~any_pos & says_no, "moments_against_clear_classification"))


def pass_codes(has_audio: Column) -> Column:
    """Problems that keep one pass from corroborating another."""
    c, way = F.col, direction()
    ground = grounding()
    uncovered = (c("identity_manipulation") != "none_detected") | (has_audio & (c("audio_assessment") != "likely_recorded"))
    return F.concat(consistency_codes(has_audio), codes(
        (invalid_count() > 0, "moment_outside_clip"),
        (~c("evidence_sufficiency").eqNullSafe("sufficient"), "evidence_not_sufficient"),
        ((way == "negative") & uncovered, "negative_left_modality_open"),
        ((way == "positive") & ~(ground["visual"] | ground["audio"] | ground["identity"]), "positive_without_moment")))


def base_score(likelihood: Column) -> Column:
    """Kept for evaluation only: clamped to 1..99, 50 when not a number."""
    known = F.when(~F.isnan(likelihood) & (F.abs(likelihood) < float("inf")), likelihood)
    return F.greatest(F.lit(1), F.least(F.lit(99), F.floor(F.coalesce(known, F.lit(50.0)) + 0.5))).cast("int")
