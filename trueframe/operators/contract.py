"""A nested document's contract as a tree of rules, with the path of every violation.

A contract is a value (a named test), a struct of contracts, a list of one
contract, or any of these made optional. ``violations_of`` turns it into one
Column expression, so that a document is checked in one pass where it is read.
Null is a violation unless the value is optional; below a null struct or list
nothing else is reported. Optional text and flags have no rule, for a typed
column cannot break one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import truthy

Test = Callable[[Column], Column]


@dataclass(frozen=True)
class Value:
    rule: str
    test: Test
    values: tuple = ()


@dataclass(frozen=True)
class Struct:
    fields: dict[str, Contract]


@dataclass(frozen=True)
class Items:
    item: Contract
    least: int = 0
    most: int | None = None


@dataclass(frozen=True)
class Optional:
    of: Contract


Contract = Value | Struct | Items | Optional


def one_of(*values: object) -> Value:
    return Value("value", lambda c: c.isin(*values), values)


def between(low: float, high: float) -> Value:
    return Value("range", lambda c: c.between(low, high))


def matching(pattern: str) -> Value:
    return Value("format", lambda c: c.rlike(pattern))


TEXT = Value("missing", lambda c: c.isNotNull())
FILLED = Value("length", lambda c: F.length(c) >= 1)
FLAG = Value("missing", lambda c: c.isNotNull())
FINITE = Value("finite", lambda c: ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
POSITIVE = Value("positive", lambda c: (c > 0) & ~F.isnan(c.cast("double")))
NOT_NEGATIVE = Value("not_negative", lambda c: (c >= 0) & ~F.isnan(c.cast("double")))
COUNT = Value("count", lambda c: (c >= 0) & (c == F.floor(c)))
URL = matching(r"^(?i:https?)://[^\s/]+\S*\z")
DIGEST = matching(r"^[a-f0-9]{64}\z")
TEXTS = Items(TEXT)

_KIND = "array<struct<path:string,rule:string>>"


def _none() -> Column:
    return F.array().cast(_KIND)


def _one(path: Column, rule: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule")))


def violations_of(contract: Contract, value: Column, path: Column) -> Column:
    """Array of (path, rule) that ``value`` breaks; list items are numbered from 0."""
    if isinstance(contract, Optional):
        return F.when(value.isNull(), _none()).otherwise(violations_of(contract.of, value, path))
    if isinstance(contract, Value):
        return F.when(truthy(contract.test(value)), _none()).otherwise(_one(path, contract.rule))
    if isinstance(contract, Struct):
        below = [violations_of(child, value[name], F.concat(path, F.lit(f".{name}"))) for name, child in contract.fields.items()]
        return F.when(value.isNull(), _one(path, "missing")).otherwise(F.concat(*below))
    sized = F.size(value) >= contract.least
    if contract.most is not None:
        sized &= F.size(value) <= contract.most
    items = F.flatten(F.transform(value, lambda item, at: violations_of(
        contract.item, item, F.concat(path, F.lit("["), at.cast("string"), F.lit("]")))))
    return F.when(value.isNull(), _one(path, "missing")).otherwise(F.concat(
        F.when(sized, _none()).otherwise(_one(path, "size")), items))


# The report document's enumerations and bounds.
MOMENT = Struct({
    "timestamp": FILLED, "observation": FILLED, "severity": one_of("low", "medium", "high"),
    "category": one_of("anatomy", "text", "physics", "identity", "temporal", "lighting", "audio", "camera", "other")})
CLASSIFICATION = one_of("likely_ai_generated", "possibly_ai_generated", "mixed_or_ai_edited", "likely_not_ai_generated", "inconclusive")
FINDINGS = {
    "ai_likelihood": between(1, 99), "visual_classification": CLASSIFICATION,
    "visual_assessment": one_of("generated", "edited", "likely_authentic", "inconclusive"),
    "audio_assessment": one_of("synthetic", "likely_synthetic", "likely_recorded", "inconclusive"),
    "identity_manipulation": one_of("face_swap", "lip_sync_manipulation", "none_detected", "inconclusive"),
    "content_type": one_of("camera_footage", "animation", "cgi", "mixed", "unknown"),
    "summary": FILLED, "suspicious_moments": Items(MOMENT), "evidence_against_ai": TEXTS, "alternative_explanations": TEXTS,
    "limitations": TEXTS, "agentic_processing_observed": FLAG,
    "evidence_sufficiency": Optional(one_of("sufficient", "limited", "insufficient")), "quality_issues": Optional(TEXTS)}
PASS = Struct({
    "kind": one_of("sweep", "review", "adjudication"), "mode": one_of("static", "agentic"), "model": TEXT, "fps": Optional(POSITIVE),
    "status": one_of("complete", "failed"), "elapsed_ms": NOT_NEGATIVE, "ai_likelihood": Optional(between(1, 99)),
    "classification": Optional(CLASSIFICATION), "summary": TEXT, "input_tokens": Optional(NOT_NEGATIVE), "output_tokens": Optional(NOT_NEGATIVE),
    "intervals": Items(Struct({"start_seconds": NOT_NEGATIVE, "end_seconds": NOT_NEGATIVE, "fps": Optional(POSITIVE)})),
    "raw_analysis": Optional(Struct(FINDINGS)), "consistency_issues": Optional(TEXTS)})
INSPECTION = Struct({
    "visual_coverage": one_of("adequate", "limited", "unavailable"), "temporal_coverage": one_of("adequate", "limited", "unknown"),
    "audio_coverage": one_of("adequate", "limited", "unavailable", "no_audio"), "issues": TEXTS,
    "review_agreement": one_of("agree", "resolved", "disagree", "not_available"),
    "strategy": one_of("sweep_and_review"), "coverage_basis": one_of("requested_sampling_and_model_report"),
    "duration_seconds": Optional(NOT_NEGATIVE), "passes": Items(PASS)})
COMMENTS = Struct({
    "status": one_of("complete", "unavailable", "comments_disabled", "failed"), "sample_size": COUNT, "comments_claiming_ai": COUNT,
    "comments_claiming_real": COUNT, "creator_admission_found": FLAG, "credible_source_claim_found": FLAG, "comment_summary": TEXT})
UNIT, HTTP_STATUS = between(0, 1), between(100, 599)
SPECIALIST = Struct({
    "schema_version": one_of(1), "provider": one_of("sightengine"), "model": one_of("genai"),
    "policy_version": one_of("sightengine-temporal-evidence-v1"), "policy_fingerprint": DIGEST,
    "status": one_of("complete", "limited", "unavailable"),
    "verdict": one_of("persistent_ai_indicators", "no_clear_indicators", "inconclusive"), "confidence": one_of("Not calibrated"),
    "review_required": FLAG, "source_sha256": Optional(DIGEST),
    "samples": Items(Struct({
        "index": COUNT, "raw_position_milliseconds": Optional(FINITE), "position_seconds": Optional(FINITE),
        "ai_generated": Optional(FINITE), "valid": FLAG, "issues": TEXTS})),
    "persistent_runs": Items(Struct({
        "sample_indices": Items(COUNT, least=2), "sampled_positions_seconds": Items(FINITE, least=2), "sample_scores": Items(UNIT, least=2),
        "first_sample_seconds": FINITE, "last_sample_seconds": FINITE,
        "extent_meaning": one_of("sample_endpoints_only_not_a_continuous_AI_interval"), "adjacent_samples_are_independent": one_of(False)})),
    "isolated_alerts": Items(Struct({
        "sample_index": COUNT, "position_seconds": FINITE, "ai_generated": UNIT, "status": one_of("unresolved")})),
    "coverage": Struct({
        "complete": FLAG, "duration_seconds": Optional(POSITIVE), "declared_interval_seconds": Optional(FINITE), "issues": TEXTS,
        "sampled_positions_seconds": Items(FINITE), "insufficient_for_subsecond_exclusion": one_of(True),
        "basis": one_of("caller_declaration_and_returned_sample_positions_not_every_frame_inspection")}),
    "technical_issues": TEXTS, "decision_reasons": TEXTS,
    "failure_code": Optional(one_of(
        "not_configured", "server_only", "unsupported_input", "media_receipt_mismatch", "access_refused", "quota_or_rate_limit",
        "http_error", "network_error", "timeout", "response_too_large", "provider_rejected", "malformed_response", "accounting_mismatch",
        "incomplete_coverage")),
    "request": Struct({
        "submission_attempted": FLAG, "operations": Optional(COUNT), "http_status": Optional(HTTP_STATUS), "elapsed_ms": NOT_NEGATIVE,
        "transport": Optional(one_of("sync", "async")), "upload": Optional(one_of("direct", "upload_api")), "poll_count": Optional(COUNT),
        "stage": Optional(one_of("validation", "create_upload", "upload", "submit", "poll", "complete"))}),
    "not_proof_of_origin": one_of(True), "scores_are_calibrated_probabilities": one_of(False),
    "adjacent_samples_are_independent": one_of(False)})
RESULT = Struct({
    "specialist_evidence": Optional(SPECIALIST), "id": FILLED,
    "source": Struct({
        "platform": one_of("youtube", "tiktok", "instagram", "x", "upload"), "platform_video_id": FILLED, "canonical_key": FILLED,
        "canonical_url": Optional(URL), "input_url": Optional(URL)}),
    "base_score": between(1, 99), "final_score": between(1, 99),
    "verdict": one_of("AI indicators detected", "No clear AI indicators", "Inconclusive", "AI use disclosed", "Verified AI provenance"),
    "confidence": one_of("Not calibrated", "Verified provenance"), "assessment_status": one_of("complete", "limited", "conflicting"),
    "review_required": FLAG, "decision_reasons": Items(FILLED, least=1), "evidence_label": FILLED,
    "adjustments": Items(Struct({"source": TEXT, "rule": TEXT, "score_before": FINITE, "score_after": FINITE, "delta": FINITE, "reason": TEXT})),
    "video_analysis": Struct({**FINDINGS, "inspection": Optional(INSPECTION)}),
    "provenance": Struct({
        "status": one_of("found", "not_found", "unavailable", "invalid", "error"), "embedded": FLAG,
        "indicates_generative_ai": FLAG, "digital_source_types": TEXTS,
        "validation_messages": TEXTS, "note": TEXT}),
    "youtube": Optional(Struct({
        "status": one_of("complete", "unavailable", "failed"),
        "metadata": Optional(Struct({
            "thumbnail_url": Optional(URL), "contains_synthetic_media": FLAG,
            "has_explicit_ai_disclosure": FLAG, "disclosure_reasons": TEXTS})),
        "comments": COMMENTS})),
    "media_receipt": Optional(Struct({
        "sha256": DIGEST, "duration_seconds": POSITIVE, "width": POSITIVE, "height": POSITIVE, "fps": Optional(POSITIVE),
        "has_audio": FLAG, "size_bytes": POSITIVE, "mime_type": TEXT})),
    "social_context": Optional(Struct({
        "platform": one_of("instagram", "tiktok", "x"), "media_id": TEXT, "disclosure_reasons": TEXTS})),
    "detector_fingerprint": FILLED, "analyzed_at": FILLED, "analyzer_version": FILLED, "model": FILLED,
    "video_processing": one_of("agentic", "static"), "cache_hit": FLAG, "limitations": TEXTS})


def validate_document(reports: DataFrame, key: str, document: str, contract: Contract = RESULT) -> DataFrame:
    """One row per violation: key, path, rule."""
    return reports.select(key, F.explode(violations_of(contract, F.col(document), F.lit("result"))).alias("_v")).select(key, "_v.*")
