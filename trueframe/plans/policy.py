"""Verdict, fusion, replay and pass agreement queries."""

from pyspark.sql import functions as F

from ..functions import policy as fp
from ..operators import policy as p
from ..operators.shots import overlap_free_topk
from .registry import query


def reports(t):
    """Clip reports with their moments as an array."""
    moment = lambda k: F.when(F.col(f"m{k}_time").isNotNull(), F.struct(
        F.col(f"m{k}_time").alias("timestamp"), F.col(f"m{k}_severity").alias("severity"), F.col(f"m{k}_category").alias("category")))
    return t.clips.withColumn("moments", F.array_compact(F.array(moment(1), moment(2))))


SECS = lambda c: (
    f"CASE WHEN regexp_full_match({c}, '(?:[0-9]{{1,2}}:)?[0-9]{{1,3}}:[0-9]{{2}}(?:[.][0-9]{{1,3}})?') AND split_part({c},':',2)::DOUBLE < 60 "
    f"THEN split_part({c},':',1)::DOUBLE*60 + split_part({c},':',2)::DOUBLE END").replace("{", "{{").replace("}", "}}")
FINDINGS = "s0 AS (SELECT *, " + SECS("m1_time") + " AS s1, " + SECS("m2_time") + """ AS s2 FROM {clips}),
 s1 AS (SELECT *, m1_time IS NOT NULL AND (s1 IS NULL OR coalesce(s1 > duration, FALSE)) AS bad1, m2_time IS NOT NULL AND (s2 IS NULL OR coalesce(s2 > duration, FALSE)) AS bad2 FROM s0),
 s2 AS (SELECT *, m1_time IS NOT NULL AND NOT bad1 AND m1_severity<>'low' AS k1, m2_time IS NOT NULL AND NOT bad2 AND m2_severity<>'low' AS k2, bad1::INT+bad2::INT AS bad,
   visual_assessment IN ('generated','edited') OR visual_classification IN ('likely_ai_generated','mixed_or_ai_edited') AS v, audio_assessment IN ('synthetic','likely_synthetic') AS a,
   identity_manipulation IN ('face_swap','lip_sync_manipulation') AS i, identity_manipulation='lip_sync_manipulation' AS lips FROM s1),
 s3 AS (SELECT *, v OR a OR i AS anyp, (k1 AND m1_category='audio') OR (k2 AND m2_category='audio') AS ka, (k1 AND m1_category<>'audio') OR (k2 AND m2_category<>'audio') AS kn,
   (k1 AND m1_category='identity') OR (k2 AND m2_category='identity') AS ki FROM s2),
 s4 AS (SELECT *, v AND kn AS gv, a AND ka AS ga, i AND (ki OR (lips AND ka)) AS gi,
   CASE WHEN ai_likelihood<1 OR ai_likelihood>99 OR ai_likelihood<>floor(ai_likelihood) THEN '|score_invalid' ELSE '' END
   || CASE WHEN ai_likelihood>=65 AND NOT anyp AND visual_classification='likely_not_ai_generated' THEN '|strong_score_against_visuals' ELSE '' END
   || CASE WHEN v AND visual_classification='likely_not_ai_generated' THEN '|visual_assessment_against_classification' ELSE '' END
   || CASE WHEN visual_classification='likely_ai_generated' AND visual_assessment='likely_authentic' THEN '|classification_against_visual_assessment' ELSE '' END
   || CASE WHEN (v OR i) AND visual_coverage='unavailable' THEN '|visual_finding_without_inspection' ELSE '' END
   || CASE WHEN a AND audio_coverage IN ('unavailable','no_audio') THEN '|audio_finding_without_audio' ELSE '' END
   || CASE WHEN (k1 OR k2) AND NOT anyp AND visual_classification='likely_not_ai_generated' THEN '|moments_against_clear_classification' ELSE '' END AS cons FROM s3)"""

text = lambda c: F.concat(F.when(F.size(c) > 0, "|").otherwise(""), F.array_join(c, "|"))


@query("moment_seconds", "SELECT clip_id, m1_time AS timestamp, " + SECS("m1_time") + " AS seconds FROM {clips} WHERE m1_time IS NOT NULL UNION ALL SELECT clip_id, m2_time, "
       + SECS("m2_time") + " FROM {clips} WHERE m2_time IS NOT NULL")
def _(t):
    return reports(t).select("clip_id", F.explode("moments.timestamp").alias("timestamp")).withColumn("seconds", fp.moment_seconds(F.col("timestamp")))


@query("invalid_moments", "WITH " + FINDINGS + " SELECT clip_id, m1_time AS timestamp FROM s2 WHERE bad1 UNION ALL SELECT clip_id, m2_time FROM s2 WHERE bad2")
def _(t):
    return reports(t).select("clip_id", "duration", F.explode("moments").alias("m")).filter(
        fp.moment_invalid(F.col("m"), F.col("duration"))).select("clip_id", F.col("m.timestamp").alias("timestamp"))


@query("consistency_issues", "WITH " + FINDINGS + " SELECT clip_id, cons AS issues FROM s4 WHERE cons <> ''")
def _(t):
    return p.with_findings(reports(t)).filter(F.size("consistency") > 0).select("clip_id", text("consistency").alias("issues"))


DIRECTION = """CASE WHEN visual_classification IN ('likely_ai_generated','possibly_ai_generated','mixed_or_ai_edited') OR visual_assessment IN ('generated','edited') OR a OR i THEN 'positive'
   WHEN visual_classification='likely_not_ai_generated' AND visual_assessment='likely_authentic' THEN 'negative' ELSE 'uncertain' END"""


@query("modalities", "WITH " + FINDINGS + f""", d AS (SELECT *, {DIRECTION} AS direction FROM s4) SELECT clip_id, v AS visual, a AS audio, i AS identity, direction,
   direction || '/' || (visual_assessment IN ('generated','edited'))::INT || '/' || a::INT || '/' || i::INT AS profile FROM d""")
def _(t):
    return reports(t).select("clip_id", *[v.alias(k) for k, v in fp.modalities().items()], fp.direction().alias("direction"), fp.profile().alias("profile"))


@query("pass_validity", "WITH " + FINDINGS + f""", d AS (SELECT *, {DIRECTION} AS direction FROM s4), e AS (SELECT *, cons || CASE WHEN a AND clip_id % 4=0 AND audio_coverage NOT IN ('unavailable','no_audio') THEN '|audio_finding_without_audio' ELSE '' END
    || CASE WHEN bad>0 THEN '|moment_outside_clip' ELSE '' END || CASE WHEN evidence_sufficiency<>'sufficient' THEN '|evidence_not_sufficient' ELSE '' END
    || CASE WHEN direction='negative' AND (identity_manipulation<>'none_detected' OR (clip_id % 4<>0 AND audio_assessment<>'likely_recorded')) THEN '|negative_left_modality_open' ELSE '' END
    || CASE WHEN direction='positive' AND NOT (gv OR ga OR gi) THEN '|positive_without_moment' ELSE '' END AS issues FROM d)
  SELECT clip_id, list_aggregate(list_sort(string_split(issues,'|')),'string_agg','|') AS issues, issues='' AND direction<>'uncertain' AS valid FROM e""")
def _(t):
    checked = p.pass_validity(reports(t), F.col("clip_id") % 4 != 0)
    return checked.select("clip_id", F.concat(F.when(F.size("issues") > 0, "|").otherwise(""), F.array_join(F.array_sort("issues"), "|")).alias("issues"), "valid")


WATERFALL = FINDINGS + """, w0 AS (SELECT *, visual_coverage='adequate' AND temporal_coverage='adequate' AND audio_coverage IN ('adequate','no_audio') AS adequate, review_agreement IN ('agree','resolved') AS reviewed,
    evidence_sufficiency='sufficient' AS enough, gv AND (visual_assessment IN ('generated','edited') OR visual_classification='likely_ai_generated') AS beyond, i AND ki AS seen FROM s4),
  w1 AS (SELECT *, adequate AND reviewed AND enough AND bad=0 AND NOT invalid_observations AS complete,
    CASE WHEN provenance_status='found' AND coalesce(provenance_generative,FALSE) AND provenance_valid AND provenance_trusted THEN 1 WHEN disclosed OR creator_admission THEN 2 WHEN cons<>'' OR review_agreement='disagree' THEN 3
     WHEN (ga OR (gi AND NOT seen)) AND NOT beyond AND NOT seen THEN 4 WHEN (gv OR ga OR gi) AND evidence_sufficiency<>'insufficient' THEN 5 WHEN anyp THEN 6
     WHEN adequate AND reviewed AND enough AND bad=0 AND NOT invalid_observations AND visual_classification='likely_not_ai_generated' AND visual_assessment='likely_authentic'
       AND (audio_assessment='likely_recorded' OR audio_coverage='no_audio') AND identity_manipulation='none_detected' AND NOT (k1 OR k2) THEN 7 ELSE 8 END AS rule FROM w0),
  w2 AS (SELECT *, CASE WHEN bad>0 THEN '|moment_outside_clip' ELSE '' END || CASE WHEN invalid_observations THEN '|observations_discarded' ELSE '' END || CASE WHEN NOT adequate THEN '|coverage_limited' ELSE '' END
     || CASE WHEN NOT reviewed THEN '|no_agreeing_review' ELSE '' END || CASE WHEN NOT enough THEN '|evidence_not_sufficient' ELSE '' END AS lim FROM w1),
  wf AS (SELECT *, CASE rule WHEN 1 THEN 'Verified AI provenance' WHEN 2 THEN 'AI use disclosed' WHEN 5 THEN 'AI indicators detected' WHEN 7 THEN 'No clear AI indicators' ELSE 'Inconclusive' END AS verdict,
    CASE rule WHEN 1 THEN 'Verified provenance' ELSE 'Not calibrated' END AS confidence,
    CASE WHEN rule=1 THEN 'Verified synthetic' WHEN rule=2 THEN 'Disclosed synthetic or altered' WHEN rule=5 AND visual_classification='mixed_or_ai_edited' THEN 'Mixed or AI-edited'
      WHEN rule=5 THEN 'AI indicators observed' WHEN rule=7 THEN 'No reliable evidence of AI found' ELSE 'Inconclusive' END AS evidence_label,
    CASE WHEN rule IN (1,2,7) OR (rule=5 AND complete) THEN 'complete' WHEN rule=3 THEN 'conflicting' ELSE 'limited' END AS assessment_status,
    greatest(1,least(99,floor(ai_likelihood+0.5)))::INT AS base_score,
    CASE rule WHEN 1 THEN '|trusted_credential' WHEN 2 THEN CASE WHEN creator_admission THEN '|creator_comment' ELSE '|source_disclosure' END
      WHEN 3 THEN cons || CASE WHEN review_agreement='disagree' THEN '|passes_disagree' ELSE '' END WHEN 4 THEN '|audio_only' || lim
      WHEN 5 THEN CASE WHEN gv THEN '|visual_supported' ELSE '' END || CASE WHEN ga THEN '|audio_supported' ELSE '' END || CASE WHEN gi THEN '|identity_supported' ELSE '' END || lim
      WHEN 6 THEN CASE WHEN gv OR ga OR gi THEN '|evidence_insufficient' ELSE '|no_matching_moment' END || lim WHEN 7 THEN '|passes_agree_clear' ELSE '|no_consistent_conclusion' || lim END AS reasons FROM w2)"""
PUBLIC = "clip_id, verdict, confidence, evidence_label, assessment_status, assessment_status<>'complete' AS review_required, base_score, reasons"
# rule 6 may list evidence_insufficient and evidence_not_sufficient: both are kept


@query("verdict_waterfall", "WITH " + WATERFALL + f" SELECT rule, {PUBLIC} FROM wf")
def _(t):
    return p.verdict_waterfall(reports(t)).withColumn("reasons", text("reasons")).select("rule", "clip_id", *p.SCORE_FIELDS)


TEMPORAL = """tm AS (SELECT case_id AS clip_id, case_id % 4<>1 AS complete, CASE case_id % 3 WHEN 0 THEN 'persistent_ai_indicators' WHEN 1 THEN 'no_clear_indicators' ELSE 'inconclusive' END AS tv,
    CASE WHEN case_id % 3=0 THEN 2 ELSE 0 END AS runs, CASE WHEN case_id % 3=2 THEN 1 WHEN case_id % 7=0 THEN 3 ELSE 0 END AS alone FROM {cases} WHERE case_id % 10<>9)"""


@query("specialist_fusion", "WITH " + WATERFALL + ", " + TEMPORAL + """, f0 AS (SELECT wf.*, tm.complete AS done, tv, runs, alone, CASE WHEN tm.clip_id IS NULL OR verdict IN ('Verified AI provenance','AI use disclosed') THEN 0
     WHEN tm.complete AND tv='persistent_ai_indicators' AND runs>0 THEN 1 WHEN NOT (tm.complete AND tv='no_clear_indicators' AND alone=0) THEN 2 WHEN verdict='No clear AI indicators' THEN 3 ELSE 4 END AS f FROM wf LEFT JOIN tm ON wf.clip_id=tm.clip_id)
  SELECT clip_id, f AS fusion_rule, CASE WHEN f=1 THEN 'AI indicators detected' WHEN f IN (2,4) THEN 'Inconclusive' ELSE verdict END AS verdict,
    CASE WHEN f=1 THEN 'AI indicators observed' WHEN f IN (2,4) THEN 'Inconclusive' ELSE evidence_label END AS evidence_label,
    CASE WHEN f=1 THEN 'complete' WHEN f=4 AND verdict='AI indicators detected' THEN 'conflicting' WHEN f IN (2,4) THEN CASE WHEN assessment_status='conflicting' THEN 'conflicting' ELSE 'limited' END ELSE assessment_status END AS assessment_status,
    f IN (1,2,4) OR assessment_status<>'complete' AS review_required, CASE WHEN f>0 THEN 'Not calibrated' ELSE confidence END AS confidence,
    CASE WHEN f=0 THEN reasons ELSE CASE WHEN f=1 THEN '|specialist_repeated' WHEN f=2 AND done AND alone>0 THEN '|specialist_isolated' WHEN f=2 THEN '|specialist_incomplete' WHEN f=3 THEN '|specialist_and_review_clear' ELSE '|specialist_quiet_unsettled' END
      || CASE WHEN f IN (1,3) THEN '' ELSE reasons END END AS reasons FROM f0""")
def _(t):
    k = F.col("case_id")
    temporal = t.cases.filter("case_id % 10 <> 9").select(
        k.alias("clip_id"), (k % 4 != 1).alias("complete"),
        F.when(k % 3 == 0, "persistent_ai_indicators").when(k % 3 == 1, "no_clear_indicators").otherwise("inconclusive").alias("verdict"),
        F.when(k % 3 == 0, 2).otherwise(0).alias("persistent"), F.when(k % 3 == 2, 1).when(k % 7 == 0, 3).otherwise(0).alias("isolated"))
    fused = p.specialist_fusion(p.verdict_waterfall(reports(t)), temporal)
    return fused.withColumn("reasons", text("reasons")).select(
        "clip_id", "fusion_rule", "verdict", "evidence_label", "assessment_status", "review_required", "confidence", "reasons")


@query("score_replay", "WITH " + WATERFALL + """, sv AS (SELECT *, CASE WHEN clip_id % 6=0 THEN 'Inconclusive' ELSE verdict END AS ov, CASE WHEN clip_id % 9=0 THEN 42 ELSE base_score END AS ob FROM wf),
  d AS (SELECT *, CASE ov WHEN 'Inconclusive' THEN 'abstain' WHEN 'No clear AI indicators' THEN 'not_ai' ELSE 'ai' END AS od, CASE verdict WHEN 'Inconclusive' THEN 'abstain' WHEN 'No clear AI indicators' THEN 'not_ai' ELSE 'ai' END AS nd FROM sv),
  h AS (SELECT *, clip_id % 13 <> 5 AS old, clip_id % 17 <> 3 AS new FROM d)
  SELECT clip_id, CASE WHEN old THEN od END AS original_decision, CASE WHEN new THEN nd END AS replayed_decision, CASE WHEN old AND new THEN od<>nd END AS decision_changed,
    CASE WHEN old AND new THEN concat_ws('|', CASE WHEN ov<>verdict THEN 'verdict' END, CASE WHEN ob<>base_score THEN 'base_score' END) ELSE '' END AS changed_fields,
    CASE WHEN NOT old THEN 'not_saved' WHEN NOT new THEN 'not_replayed' END AS problem FROM h WHERE old OR new""")
def _(t):
    rows = reports(t)
    saved = p.verdict_waterfall(rows).withColumns({
        "verdict": F.when(F.col("clip_id") % 6 == 0, "Inconclusive").otherwise(F.col("verdict")),
        "base_score": F.when(F.col("clip_id") % 9 == 0, 42).otherwise(F.col("base_score"))})
    # some rows of either side are missing
    return p.score_replay(rows.filter("clip_id % 17 <> 3"), saved.filter("clip_id % 13 <> 5")).withColumn("changed_fields", F.array_join("changed_fields", "|"))


def pass_rows(t):
    n = F.col("n")
    return t.passes.select(
        "clip_id", "kind", F.col("turn").alias("ordinal"), "status",
        F.concat(F.lit("p"), (n % 2).cast("string")).alias("profile"), (n % 5 != 0).alias("valid"), (n % 5 == 0).alias("flawed"),
        F.when(n % 6 == 0, "limited").otherwise("sufficient").alias("sufficiency"), F.when(n % 9 == 0, "inconclusive").otherwise("likely_recorded").alias("audio"))


PICKS = """fs AS (SELECT clip_id, kind, status, 'p' || (n % 2) AS profile, n % 5<>0 AS valid, CASE WHEN n % 6=0 THEN 'limited' ELSE 'sufficient' END AS suf, CASE WHEN n % 9=0 THEN 'inconclusive' ELSE 'likely_recorded' END AS audio
     FROM {passes} QUALIFY row_number() OVER (PARTITION BY clip_id, kind ORDER BY turn)=1),
  pk AS (SELECT clip_id, """ + ", ".join(f"max({v}) FILTER (kind='{k}' AND status='complete') AS {k[0]}_{n}" for k in ("sweep", "review", "adjudication") for n, v in (("p", "profile"), ("v", "valid"), ("s", "suf"), ("a", "audio"))) + """ FROM fs GROUP BY 1),
  ag AS (SELECT *, (s_p IS NOT NULL)::INT+(r_p IS NOT NULL)::INT AS initial, coalesce(s_p=r_p,FALSE) AS m, s_p IS NOT NULL AND r_p IS NOT NULL AND (s_p<>r_p OR NOT s_v OR NOT r_v) AS needed FROM pk),
  ah AS (SELECT *, needed AND a_p IS NOT NULL AS third, needed AND a_p IS NOT NULL AND a_v AND (coalesce(s_v AND s_p=a_p,FALSE) OR coalesce(r_v AND r_p=a_p,FALSE)) AS res FROM ag),
  aj AS (SELECT *, CASE WHEN res THEN 'resolved' WHEN m AND s_v AND r_v THEN 'agree' WHEN needed THEN 'disagree' ELSE 'not_available' END AS agreement,
    CASE WHEN third THEN 'adjudication' WHEN s_v THEN 'sweep' WHEN r_v THEN 'review' WHEN s_p IS NOT NULL THEN 'sweep' WHEN r_p IS NOT NULL THEN 'review' END AS selected FROM ah)"""


@query("pass_agreement", "WITH " + PICKS + " SELECT clip_id, initial, needed, agreement, selected FROM aj")
def _(t):
    return p.pass_agreement(pass_rows(t)).select("clip_id", "initial", "needed", "agreement", F.col("selected.kind").alias("selected"))


@query("clip_coverage", "WITH " + PICKS + """, md AS (SELECT conv_id AS clip_id, CASE WHEN conv_id % 6=0 THEN NULL ELSE 20.0 END AS duration, 200+conv_id % 5*40 AS h, conv_id % 7<>0 AS has_audio FROM {conversations} GROUP BY 1),
  x AS (SELECT aj.*, md.*, CASE selected WHEN 'adjudication' THEN a_p WHEN 'sweep' THEN s_p ELSE r_p END AS cp, CASE selected WHEN 'adjudication' THEN a_s WHEN 'sweep' THEN s_s ELSE r_s END AS cs,
     CASE selected WHEN 'adjudication' THEN a_a WHEN 'sweep' THEN s_a ELSE r_a END AS ca FROM aj JOIN md ON aj.clip_id=md.clip_id),
  y AS (SELECT *, coalesce(cs='sufficient',FALSE) AND h>=240 AND CASE WHEN res THEN NOT coalesce(s_v AND s_p=cp AND s_s<>'sufficient',FALSE) AND NOT coalesce(r_v AND r_p=cp AND r_s<>'sufficient',FALSE) AND NOT coalesce(a_v AND a_p=cp AND a_s<>'sufficient',FALSE)
     ELSE coalesce(s_s='sufficient',TRUE) AND coalesce(r_s='sufficient',TRUE) END AS readable FROM x)
  SELECT clip_id, agreement, CASE WHEN readable THEN 'adequate' ELSE 'limited' END AS visual_coverage,
   CASE WHEN (coalesce(s_s='sufficient',FALSE) OR (third AND a_s='sufficient')) AND duration>0 THEN 'adequate' ELSE 'limited' END AS temporal_coverage,
   CASE WHEN NOT has_audio THEN 'no_audio' WHEN readable AND ca<>'inconclusive' THEN 'adequate' ELSE 'limited' END AS audio_coverage,
   concat_ws('|', CASE WHEN initial<2 THEN 'one_pass_completed' END, CASE WHEN NOT readable THEN 'detail_insufficient' END, CASE WHEN duration IS NULL THEN 'duration_unknown' END,
     CASE WHEN needed AND res THEN 'third_pass_resolved' END, CASE WHEN needed AND NOT res THEN 'third_pass_unresolved' END) AS issues FROM y""".replace("aj.*, md.*", "aj.*, md.duration, md.h, md.has_audio"))
def _(t):
    k = F.col("conv_id")
    media = t.conversations.select("conv_id").distinct().select(
        k.alias("clip_id"), F.when(k % 6 != 0, 20.0).alias("duration"), F.lit(640).alias("width"), (k % 5 * 40 + 200).alias("height"), (k % 7 != 0).alias("has_audio"))
    return p.clip_coverage(p.pass_agreement(pass_rows(t)), media).withColumn("issues", F.array_join("issues", "|"))


@query("assemble_result", "WITH " + WATERFALL + """ SELECT clip_id, verdict, assessment_status, 'not_proof_of_origin|sampling_was_requested|missing_watermark_is_neutral'
   || CASE WHEN h % 5=0 THEN '|dark_footage' ELSE '' END || CASE WHEN h % 3=0 THEN '|agentic_call_not_observed' ELSE '' END || CASE WHEN h2 % 6=0 THEN '|provenance_unavailable' ELSE '' END
   || CASE WHEN h2 % 4=1 THEN '|platform_context_incomplete' ELSE '' END AS limitations FROM wf""")
def _(t):
    h, h2 = F.col("h"), F.col("h2")
    context = t.clips.select(
        "clip_id", F.when(h % 5 == 0, F.array(F.lit("dark_footage"), F.lit("not_proof_of_origin"))).alias("clip_limitations"), (h % 3 != 0).alias("agentic_observed"),
        F.when(h2 % 6 == 0, "error").otherwise("not_found").alias("provenance_state"), F.when(h2 % 4 == 1, "failed").when(h2 % 4 == 2, "complete").alias("context_state"))
    return p.assemble_result(p.verdict_waterfall(reports(t)), context).select(
        "clip_id", "verdict", "assessment_status", F.array_join("limitations", "|").alias("limitations"))


@query("review_label", "WITH " + PICKS + """, k AS (SELECT clip_id, bool_or(kind='sweep' AND status='complete') AS s, bool_or(kind='review' AND status='complete') AS r, bool_or(kind='adjudication' AND status='complete') AS a FROM {passes} GROUP BY 1)
  SELECT k.clip_id, CASE WHEN agreement IS NULL OR agreement='not_available' THEN 'Review incomplete' WHEN agreement='disagree' THEN 'Reviews disagree' WHEN agreement='resolved' AND a AND s::INT+r::INT+a::INT>=2 THEN 'Difference resolved by follow-up'
     WHEN agreement='agree' AND s AND r THEN 'Separate reviews agree' ELSE 'Review incomplete' END AS review_label,
   CASE WHEN agreement IS NULL OR NOT (s OR r OR a) THEN 'none' WHEN s AND r AND k.clip_id % 3<>0 THEN 'sweep_and_review' WHEN s AND k.clip_id % 3<>0 THEN 'sweep_only' ELSE 'partial' END AS coverage_basis
  FROM k LEFT JOIN aj ON k.clip_id=aj.clip_id""")
def _(t):
    kinds = t.passes.groupBy("clip_id").agg(F.collect_set(F.when(F.col("status") == "complete", F.col("kind"))).alias("kinds"))  # at most three kinds
    agreed = p.pass_agreement(pass_rows(t)).select("clip_id", "agreement")
    rows = kinds.join(agreed, "clip_id", "left").withColumn(
        "temporal_coverage", F.when(F.col("clip_id") % 3 != 0, "adequate").otherwise("limited"))
    return p.review_label(rows).select("clip_id", "review_label", "coverage_basis")


@query("overlap_free_topk", "WITH " + FINDINGS + """, o AS (SELECT clip_id, duration, CASE WHEN m2_time IS NOT NULL AND (m1_time IS NULL OR
      (CASE m2_severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) < (CASE m1_severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END)) THEN [s2, CASE WHEN m1_time IS NOT NULL THEN s1 END] ELSE [s1, s2] END AS q, (m1_time IS NOT NULL)::INT + (m2_time IS NOT NULL)::INT AS moments FROM s1),
  z AS (SELECT clip_id, moments, list_transform(list_filter(q, lambda s: s IS NOT NULL AND s<=duration AND least(duration, s+2) > greatest(0, s-2)), lambda s: [greatest(0,s-2), least(duration,s+2)]) AS w FROM o),
  k AS (SELECT *, CASE WHEN len(w)=0 THEN 0 WHEN len(w)=1 OR (w[1][1]<=w[2][2] AND w[1][2]>=w[2][1]) THEN 1 ELSE 2 END AS kept FROM z)
  SELECT clip_id, i::INT AS window_no, w[i+1][1] AS start, w[i+1][2] AS "end", moments-kept AS left_out FROM (SELECT *, unnest(range(kept)) AS i FROM k)
  UNION ALL SELECT clip_id, NULL, NULL, NULL, moments FROM k WHERE kept=0""")
def _(t):
    out = overlap_free_topk(reports(t), fp.moment_seconds)
    return out.select("clip_id", F.posexplode_outer("windows").alias("window_no", "w"), "left_out").select(
        "clip_id", "window_no", "w.start", "w.end", "left_out")


@query("severity_top", """SELECT clip_id, timestamp, severity FROM (SELECT clip_id, m1_time AS timestamp, m1_severity AS severity, 1 AS k FROM {clips} WHERE m1_time IS NOT NULL
   UNION ALL SELECT clip_id, m2_time, m2_severity, 2 FROM {clips} WHERE m2_time IS NOT NULL)
   QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, k)=1""")
def _(t):
    rank = lambda m: F.when(m["severity"] == "high", 0).when(m["severity"] == "medium", 1).otherwise(2)
    top = F.get(F.array_sort(F.transform("moments", lambda m, i: F.struct(rank(m).alias("r"), i.alias("i"), m.alias("m")))), F.lit(0))
    return reports(t).filter(F.size("moments") > 0).select("clip_id", top["m"]["timestamp"].alias("timestamp"), top["m"]["severity"].alias("severity"))
