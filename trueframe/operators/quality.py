"""Data-quality rules as violation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import codes, truthy

LABELS = ("real", "ai", "cgi", "mixed")
SPLITS = ("development", "calibration", "holdout")
REQUIRED = ("group_id", "split", "path", "sha256", "source_url", "license", "ground_truth")
# Report enumerations.
ENUMS = {
    "visual_classification": ("likely_ai_generated", "possibly_ai_generated", "mixed_or_ai_edited", "likely_not_ai_generated", "inconclusive"),
    "visual_assessment": ("generated", "edited", "likely_authentic", "inconclusive"),
    "audio_assessment": ("synthetic", "likely_synthetic", "likely_recorded", "inconclusive"),
    "identity_manipulation": ("face_swap", "lip_sync_manipulation", "none_detected", "inconclusive"),
    "evidence_sufficiency": ("sufficient", "limited", "insufficient"),
    "review_agreement": ("agree", "resolved", "disagree", "not_available"),
    "visual_coverage": ("adequate", "limited", "unavailable"),
    "temporal_coverage": ("adequate", "limited", "unknown"),
    "audio_coverage": ("adequate", "limited", "unavailable", "no_audio"),
}
SEVERITIES = ("low", "medium", "high")
CATEGORIES = ("anatomy", "text", "physics", "identity", "temporal", "lighting", "audio", "camera", "other")
PLATFORMS = ("youtube", "tiktok", "instagram", "x", "upload")
STATUSES = ("pending", "complete", "failed")


def violations(df: DataFrame, key: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row per broken rule; a rule whose condition is null is broken."""
    return df.select(key, F.explode(codes(*[(~truthy(ok), rule) for rule, ok in rules])).alias("rule"))


def duplicates(df: DataFrame, key: str, rule: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        key, F.lit(rule).alias("rule"))


def filled(name: str) -> Column:
    return F.col(name).isNotNull() & (F.col(name) != "")


def validate_manifest(manifest: DataFrame) -> DataFrame:
    """Missing fields, unknown label or split, and ids that are missing or repeated."""
    rules = [("missing_id", filled("id")), *[(f"missing_{f}", filled(f)) for f in REQUIRED],
             ("unknown_label", F.col("label").isin(*LABELS)), ("unknown_split", F.col("split").isin(*SPLITS))]
    return violations(manifest, "id", rules).unionByName(duplicates(manifest, "id", "duplicate_id"))


def validate_result(reports: DataFrame) -> DataFrame:
    """Enumerations, ranges, lengths and array sizes of a report document."""
    c = F.col
    optional = ("evidence_sufficiency", "review_agreement", "visual_coverage", "temporal_coverage", "audio_coverage")
    rules = [(f"{name}_value", c(name).isin(*values) | (c(name).isNull() if name in optional else F.lit(False)))
             for name, values in ENUMS.items()]
    every = lambda test: F.forall("moments", test)
    rules += [("ai_likelihood_range", (c("ai_likelihood") == F.floor("ai_likelihood")) & c("ai_likelihood").between(1, 99)),
              ("moments_count", F.size("moments") <= 3),
              ("moment_timestamp_length", every(lambda m: F.length(m["timestamp"]).between(1, 16))),
              ("moment_severity", every(lambda m: m["severity"].isin(*SEVERITIES))),
              ("moment_category", every(lambda m: m["category"].isin(*CATEGORIES))),
              ("summary_length", F.length("summary").between(1, 1000)),
              ("limitations_size", (F.size("limitations") <= 5) & F.forall("limitations", lambda x: F.length(x).between(1, 500)))]
    return violations(reports, "clip_id", rules)


def validate_cache_row(rows: DataFrame, key: str = "event_id") -> DataFrame:
    c = F.col
    return violations(rows, key, [
        ("canonical_key_null", c("canonical_key").isNotNull()), ("platform_domain", c("platform").isin(*PLATFORMS)),
        ("status_domain", c("status").isin(*STATUSES)), ("final_score_range", c("final_score").between(1, 99)),
        ("analyzer_version_null", c("analyzer_version").isNotNull()), ("expires_null", c("expires_us").isNotNull())])


def validate_census(entries: DataFrame, pattern: str, max_member: int = 8 << 20, central_offset: int = 99_000_000_000) -> DataFrame:
    """Archive entries with an unexpected name, flag, method, size, checksum or offset."""
    c = F.col
    allowed = 0x806
    return violations(entries, "name", [
        ("name_pattern", c("name").rlike(pattern)), ("flags", c("flags").bitwiseAND(F.lit(~allowed)) == 0),
        ("method", c("method").isin(0, 8)), ("deflate_flags_on_stored", (c("method") == 8) | (c("flags").bitwiseAND(F.lit(6)) == 0)),
        ("compressed_size", c("compressed_bytes").between(1, max_member)), ("uncompressed_size", c("uncompressed_bytes").between(1, max_member)),
        ("crc32", c("crc32").rlike(r"^[0-9a-f]{8}\z")), ("offset", (c("local_header_offset") >= 0) & (c("local_header_offset") < central_offset))])


def cohort_select(manifest: DataFrame, split: str = "all", limit: int | None = None) -> DataFrame:
    """Rows of a split; ``limit`` is the run's own option and takes the first ids."""
    rows = manifest if split == "all" else manifest.filter(F.col("split") == split)
    return rows if limit is None else rows.orderBy("id").limit(limit)


def plan_counts(selected: DataFrame) -> DataFrame:
    return selected.rollup("label").agg(F.count(F.lit(1)).alias("clips"), F.count_distinct("group_id").alias("groups"))


def reusable(fingerprint: str, version: str) -> Column:
    """Whether a stored result may be served again: current detector, at least
    two passes, none failed, and media that matches its platform's key."""
    c = F.col
    receipt = c("receipt_sha256")
    return truthy(
        (c("detector_fingerprint") == fingerprint) & (c("analyzer_version") == version) & (c("result_key") == c("canonical_key"))
        & (F.size("passes") >= 2) & ~F.exists("passes", lambda p: p["status"] == "failed")
        & ((c("platform") == "youtube") | receipt.isNotNull())
        & F.when(c("platform") == "upload", (receipt == c("platform_video_id")) & (c("canonical_key") == F.concat(F.lit("upload:"), receipt))
                 & c("canonical_url").isNull()).otherwise(c("canonical_url").isNotNull()))


def identity_check(runs: DataFrame, passes: DataFrame, model: str) -> DataFrame:
    """Mismatch codes of each run against the expected model, modes and bytes."""
    c = F.col
    facts = passes.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c("model") != model).alias("other_model"),
        F.count_if((c("kind") == "sweep") & (c("mode") == "static") & (c("fps") == 2)).alias("sweeps"),
        F.count_if((c("kind") == "review") & (c("mode") == "agentic") & c("fps").isNull()).alias("reviews"))
    rows = runs.join(facts, "clip_id", "left")
    return rows.select("clip_id", codes(
        (~truthy(c("media_sha256") == c("expected_sha256")), "media_hash"), (truthy(c("cache_hit")), "cache"),
        (~truthy(c("n") >= 2), "missing_pass_receipts"), (truthy(c("other_model") > 0), "pass_model"),
        (~truthy(c("sweeps") > 0), "sweep_configuration"), (~truthy(c("reviews") > 0), "review_configuration"),
        (~truthy(c("decision").isin("ai", "not_ai", "abstain")), "decision_schema")).alias("mismatches"))
