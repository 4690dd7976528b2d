"""Verdict jobs: the rule waterfall, fusion, replay and pass agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import policy as p
from ..functions.rules import codes, first_of, truthy

# Verdict, label and status wording of each rule's outcome.
VERIFIED, DISCLOSED, DETECTED = "Verified AI provenance", "AI use disclosed", "AI indicators detected"
CLEAR, OPEN = "No clear AI indicators", "Inconclusive"
SCORE_FIELDS = ("verdict", "confidence", "evidence_label", "assessment_status", "review_required", "base_score", "reasons")


def with_findings(reports: DataFrame) -> DataFrame:
    """Adds what every rule reads: strong moments, grounded modalities, codes."""
    ready = reports.withColumn("_strong", p.substantive()).withColumns({
        **{f"_{k}": v for k, v in p.modalities().items()}})
    return ready.withColumns({
        **{f"_g_{k}": v for k, v in p.grounding().items()},
        "_invalid": p.invalid_count(), "consistency": p.consistency_codes()})


def verdict_waterfall(reports: DataFrame) -> DataFrame:
    """First matching rule decides; scores are carried along and never decide."""
    c = F.col
    rows = with_findings(reports)
    any_pos = c("_visual") | c("_audio") | c("_identity")
    grounded = c("_g_visual") | c("_g_audio") | c("_g_identity")
    inspected = c("visual_coverage").isNotNull()
    adequate = truthy((c("visual_coverage") == "adequate") & (c("temporal_coverage") == "adequate")
                      & c("audio_coverage").isin("adequate", "no_audio"))
    reviewed = truthy(c("review_agreement").isin("agree", "resolved"))
    sufficient = truthy(c("evidence_sufficiency") == "sufficient")
    discarded = truthy(c("invalid_observations"))
    complete = adequate & reviewed & sufficient & (c("_invalid") == 0) & ~discarded
    beyond_audio = (c("_g_visual") & (c("visual_assessment").isin("generated", "edited")
                                      | (c("visual_classification") == "likely_ai_generated")))
    identity_seen = c("_identity") & F.exists("_strong", lambda m: m["category"] == "identity")
    audio_only = (c("_g_audio") | (c("_g_identity") & ~identity_seen)) & ~truthy(beyond_audio) & ~identity_seen
    negative = truthy((c("visual_classification") == "likely_not_ai_generated") & (c("visual_assessment") == "likely_authentic")
                      & ((c("audio_assessment") == "likely_recorded") | (c("audio_coverage") == "no_audio"))
                      & (c("identity_manipulation") == "none_detected")) & (F.size("_strong") == 0)
    conflicts = F.concat("consistency", codes((c("review_agreement") == "disagree", "passes_disagree")))
    shown = lambda name: truthy(c(name))

    rule = first_of(
        (truthy(c("provenance_status") == "found") & shown("provenance_generative") & shown("provenance_valid") & shown("provenance_trusted"), 1),
        (shown("disclosed") | shown("creator_admission"), 2),
        (F.size(conflicts) > 0, 3), (audio_only, 4),
        (grounded & ~c("evidence_sufficiency").eqNullSafe("insufficient"), 5),
        (any_pos, 6), (complete & negative, 7), otherwise=8)
    limits = codes(
        (c("_invalid") > 0, "moment_outside_clip"), (discarded, "observations_discarded"),
        (~inspected, "inspection_unknown"), (inspected & ~adequate, "coverage_limited"),
        (inspected & ~reviewed, "no_agreeing_review"), (~sufficient, "evidence_not_sufficient"))
    found = codes((c("_g_visual"), "visual_supported"), (c("_g_audio"), "audio_supported"), (c("_g_identity"), "identity_supported"))
    one = lambda code: F.array(F.lit(code))
    r = c("rule")
    out = rows.withColumns({"rule": rule, "_conflicts": conflicts, "_limits": limits, "_found": found, "_complete": complete})
    status = first_of((r.isin(1, 2, 7), "complete"), (r == 3, "conflicting"),
                      ((r == 5) & c("_complete"), "complete"), otherwise="limited")
    out = out.withColumns({
        "verdict": first_of((r == 1, VERIFIED), (r == 2, DISCLOSED), (r == 5, DETECTED), (r == 7, CLEAR), otherwise=OPEN),
        "confidence": first_of((r == 1, "Verified provenance"), otherwise="Not calibrated"),
        "evidence_label": first_of(
            (r == 1, "Verified synthetic"), (r == 2, "Disclosed synthetic or altered"),
            ((r == 5) & (c("visual_classification") == "mixed_or_ai_edited"), "Mixed or AI-edited"),
            (r == 5, "AI indicators observed"), (r == 7, "No reliable evidence of AI found"), otherwise="Inconclusive"),
        "assessment_status": status, "review_required": status != "complete", "base_score": p.base_score(c("ai_likelihood")),
        "reasons": F.array_distinct(F.when(r == 1, one("trusted_credential"))
                                    .when(r == 2, F.when(truthy(c("creator_admission")), one("creator_comment")).otherwise(one("source_disclosure")))
                                    .when(r == 3, c("_conflicts")).when(r == 4, F.concat(one("audio_only"), c("_limits")))
                                    .when(r == 5, F.concat(c("_found"), c("_limits")))
                                    .when(r == 6, F.concat(F.when(grounded, one("evidence_insufficient")).otherwise(one("no_matching_moment")), c("_limits")))
                                    .when(r == 7, one("passes_agree_clear")).otherwise(F.concat(one("no_consistent_conclusion"), c("_limits"))))})
    return out.drop(*[n for n in out.columns if n.startswith("_")])


def specialist_fusion(scored: DataFrame, temporal: DataFrame) -> DataFrame:
    """Waterfall result with the temporal verdict of the same clip.

    Provenance and disclosure stand. Persistent hits decide; isolated alerts
    and incomplete scans settle nothing; scores are never averaged.
    """
    c = F.col
    seen = temporal.select("clip_id", F.lit(True).alias("_t"), c("complete").alias("_done"), c("verdict").alias("_tv"),
                           c("persistent").alias("_runs"), c("isolated").alias("_alone"))
    rows = scored.join(seen, "clip_id", "left")
    stands = c("_t").isNull() | c("verdict").isin(VERIFIED, DISCLOSED)
    hits = truthy(c("_done") & (c("_tv") == "persistent_ai_indicators") & (c("_runs") > 0))
    quiet = truthy(c("_done") & (c("_tv") == "no_clear_indicators") & (c("_alone") == 0))
    open_status = F.when(c("assessment_status") == "conflicting", "conflicting").otherwise("limited")
    case = first_of((stands, 0), (hits, 1), (~quiet, 2), (c("verdict") == CLEAR, 3), otherwise=4)
    rows = rows.withColumn("fusion_rule", case).withColumn("_was", c("verdict"))
    f, was = c("fusion_rule"), c("_was")
    reason = first_of((f == 1, "specialist_repeated"), ((f == 2) & truthy(c("_done") & (c("_alone") > 0)), "specialist_isolated"),
                      (f == 2, "specialist_incomplete"), (f == 3, "specialist_and_review_clear"), (f == 4, "specialist_quiet_unsettled"))
    return rows.withColumns({
        "verdict": F.when(f == 1, DETECTED).when(f.isin(2, 4), OPEN).otherwise(was),
        "evidence_label": F.when(f == 1, "AI indicators observed").when(f.isin(2, 4), "Inconclusive").otherwise(c("evidence_label")),
        "assessment_status": F.when(f == 1, "complete").when(f == 2, open_status).when(
            f == 4, F.when(was == DETECTED, "conflicting").otherwise(open_status)).otherwise(c("assessment_status")),
        "review_required": F.when(f.isin(1, 2, 4), True).otherwise(c("review_required")),
        "confidence": F.when(f > 0, "Not calibrated").otherwise(c("confidence")),
        "reasons": F.when(f == 0, c("reasons")).otherwise(F.concat(F.array(reason), F.when(f.isin(1, 3), F.array().cast("array<string>")).otherwise(c("reasons"))))
    }).drop("_t", "_done", "_tv", "_runs", "_alone", "_was")


def decision_of_verdict(verdict: Column) -> Column:
    return first_of((verdict == OPEN, "abstain"), (verdict == CLEAR, "not_ai"), (verdict.isin(DETECTED, DISCLOSED, VERIFIED), "ai"))


def score_replay(reports: DataFrame, saved: DataFrame, fields: Sequence[str] = SCORE_FIELDS) -> DataFrame:
    """Saved reports scored again: which fields changed, and whether the decision did.

    A report without a saved row, and a saved row without a report, is a row with
    its problem and nothing compared.
    """
    again = verdict_waterfall(reports).select("clip_id", F.lit(True).alias("_new"), *fields)
    old = saved.select("clip_id", F.lit(True).alias("_old"), *[F.col(f).alias(f"_old_{f}") for f in fields])
    both = F.col("_new").isNotNull() & F.col("_old").isNotNull()
    changed = codes(*[(both & ~F.col(f).eqNullSafe(F.col(f"_old_{f}")), f) for f in fields])
    was, now = decision_of_verdict(F.col("_old_verdict")), decision_of_verdict(F.col("verdict"))
    return again.join(old, "clip_id", "full_outer").select(
        "clip_id", was.alias("original_decision"), now.alias("replayed_decision"),
        F.when(both, ~was.eqNullSafe(now)).alias("decision_changed"), changed.alias("changed_fields"),
        first_of((F.col("_old").isNull(), "not_saved"), (F.col("_new").isNull(), "not_replayed")).alias("problem"))


def pass_validity(reports: DataFrame, has_audio: Column) -> DataFrame:
    """Issues of each pass report and whether it may corroborate another pass."""
    ready = reports.withColumn("_strong", p.substantive())
    return ready.withColumns({"issues": F.array_distinct(p.pass_codes(has_audio)), "direction": p.direction(), "profile": p.profile()}).withColumn(
        "valid", (F.size("issues") == 0) & (F.col("direction") != "uncertain")).drop("_strong")


def pass_agreement(passes: DataFrame) -> DataFrame:
    """Two planned passes of a clip, and a third one if it was needed.

    Input: one row per finished or failed pass with clip_id, kind, ordinal,
    status, profile, valid, flawed, sufficiency, audio. The first pass of each
    kind counts. A clip whose first passes both failed stays, as not available.
    """
    c = F.col
    record = F.struct("profile", "valid", "flawed", "sufficiency", "audio", "kind")
    pick = lambda kind: F.min_by(F.when(c("status") == "complete", record), F.when(c("kind") == kind, c("ordinal")))
    rows = passes.groupBy("clip_id").agg(*[pick(k).alias(k) for k in ("sweep", "review", "adjudication")]).withColumns({
        k: F.when(c(f"{k}.kind") == k, c(k)) for k in ("sweep", "review", "adjudication")})
    s, r, a = c("sweep"), c("review"), c("adjudication")
    both = s.isNotNull() & r.isNotNull()
    match = truthy(both & (s["profile"] == r["profile"]))
    needed = both & (~match | truthy(s["flawed"] | r["flawed"]))
    third = needed & a.isNotNull()
    backs = lambda x: truthy(x["valid"] & (x["profile"] == a["profile"]))
    resolved = third & truthy(a["valid"]) & (backs(s) | backs(r))
    chosen = F.when(third, a).when(truthy(s["valid"]), s).when(truthy(r["valid"]), r).otherwise(F.coalesce(s, r))
    agreement = first_of((resolved, "resolved"), (match & truthy(s["valid"] & r["valid"]) & ~needed, "agree"),
                         (needed, "disagree"), otherwise="not_available")
    return rows.withColumns({"initial": s.isNotNull().cast("int") + r.isNotNull().cast("int"), "needed": needed,
                             "agreement": agreement, "selected": chosen, "third": third})


def clip_coverage(agreed: DataFrame, media: DataFrame) -> DataFrame:
    """Visual, temporal and audio coverage of a clip from its passes and media facts."""
    c = F.col
    rows = agreed.join(media.select("clip_id", "duration", "width", "height", "has_audio"), "clip_id", "left")
    s, r, a, chosen = c("sweep"), c("review"), c("adjudication"), c("selected")
    enough = lambda x: x["sufficiency"].eqNullSafe("sufficient")
    same = lambda x: truthy(x["valid"] & (x["profile"] == chosen["profile"]))
    resolved = c("agreement") == "resolved"
    usable = F.when(resolved, (~same(s) | enough(s)) & (~same(r) | enough(r)) & (~same(a) | enough(a))).otherwise(
        (s.isNull() | enough(s)) & (r.isNull() | enough(r)))
    small = truthy((c("width") > 0) & (c("height") > 0) & (F.least("width", "height") < 240))
    readable = enough(chosen) & usable & ~small
    timed = truthy(c("duration") > 0)
    swept = (s.isNotNull() & enough(s)) | (c("third") & enough(a))
    return rows.select(
        "clip_id", "agreement",
        F.when(readable, "adequate").otherwise("limited").alias("visual_coverage"),
        F.when(swept & timed, "adequate").otherwise("limited").alias("temporal_coverage"),
        first_of((~F.coalesce("has_audio", F.lit(True)), "no_audio"), (readable & truthy(chosen["audio"] != "inconclusive"), "adequate"),
                 otherwise="limited").alias("audio_coverage"),
        codes((c("initial") < 2, "one_pass_completed"), (~readable, "detail_insufficient"), (~timed, "duration_unknown"),
              (c("needed") & resolved, "third_pass_resolved"), (c("needed") & ~resolved, "third_pass_unresolved")).alias("issues"))


def assemble_result(scored: DataFrame, context: DataFrame) -> DataFrame:
    """Final row: score fields plus the conditional, distinct limitation codes."""
    c = F.col
    always = F.array(*[F.lit(x) for x in ("not_proof_of_origin", "sampling_was_requested", "missing_watermark_is_neutral")])
    extra = codes((~truthy(c("agentic_observed")), "agentic_call_not_observed"),
                  (c("provenance_state").isin("unavailable", "error"), "provenance_unavailable"),
                  (c("context_state").isNotNull() & (c("context_state") != "complete"), "platform_context_incomplete"))
    return scored.join(context, "clip_id", "left").withColumn("limitations", F.array_distinct(F.concat(
        always, F.coalesce("clip_limitations", F.array().cast("array<string>")), extra)))


def review_label(clips: DataFrame) -> DataFrame:
    """Review and coverage wording from agreement and which passes completed.

    ``kinds`` is the array of completed pass kinds of the clip.
    """
    c = F.col
    done = F.size("kinds")
    has = lambda k: F.array_contains("kinds", k)
    label = first_of(
        (c("agreement").isNull() | (c("agreement") == "not_available"), "Review incomplete"),
        (c("agreement") == "disagree", "Reviews disagree"),
        ((c("agreement") == "resolved") & has("adjudication") & (done >= 2), "Difference resolved by follow-up"),
        ((c("agreement") == "agree") & has("sweep") & has("review"), "Separate reviews agree"), otherwise="Review incomplete")
    cover = first_of(
        (c("agreement").isNull() | (done <= 0), "none"),
        (has("sweep") & has("review") & (c("temporal_coverage") == "adequate"), "sweep_and_review"),
        (has("sweep") & (c("temporal_coverage") == "adequate"), "sweep_only"), otherwise="partial")
    return clips.withColumns({"review_label": label, "coverage_basis": cover})
