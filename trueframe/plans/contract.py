"""The whole result contract over nested documents that break one rule each."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import contract as k
from .registry import query

# Every value of the document and the rule it is held to, by the struct it is in.
PATHS = """
specialist_evidence schema_version:value provider:value model:value policy_version:value policy_fingerprint:format status:value verdict:value
  confidence:value review_required:missing source_sha256:format technical_issues[0]:missing decision_reasons[0]:missing failure_code:value
  not_proof_of_origin:value scores_are_calibrated_probabilities:value adjacent_samples_are_independent:value
specialist_evidence.samples[0] index:count raw_position_milliseconds:finite position_seconds:finite ai_generated:finite valid:missing
  issues[0]:missing
specialist_evidence.persistent_runs[0] sample_indices[1]:count sampled_positions_seconds[1]:finite sample_scores[1]:range first_sample_seconds:finite
  last_sample_seconds:finite extent_meaning:value adjacent_samples_are_independent:value
specialist_evidence.isolated_alerts[0] sample_index:count position_seconds:finite ai_generated:range status:value
specialist_evidence.coverage complete:missing duration_seconds:positive declared_interval_seconds:finite issues[0]:missing
  sampled_positions_seconds[0]:finite insufficient_for_subsecond_exclusion:value basis:value
specialist_evidence.request submission_attempted:missing operations:count http_status:range elapsed_ms:not_negative transport:value upload:value
  poll_count:count stage:value
. id:length base_score:range final_score:range verdict:value confidence:value assessment_status:value review_required:missing
  decision_reasons[0]:length evidence_label:length detector_fingerprint:length analyzed_at:length analyzer_version:length model:length
  video_processing:value cache_hit:missing limitations[0]:missing
source platform:value platform_video_id:length canonical_key:length canonical_url:format input_url:format
adjustments[0] source:missing rule:missing score_before:finite score_after:finite delta:finite reason:missing
video_analysis ai_likelihood:range visual_classification:value visual_assessment:value audio_assessment:value identity_manipulation:value
  content_type:value summary:length evidence_against_ai[0]:missing alternative_explanations[0]:missing limitations[0]:missing
  agentic_processing_observed:missing evidence_sufficiency:value quality_issues[0]:missing
video_analysis.suspicious_moments[0] timestamp:length observation:length severity:value category:value
video_analysis.inspection visual_coverage:value temporal_coverage:value audio_coverage:value issues[0]:missing review_agreement:value strategy:value
  coverage_basis:value duration_seconds:not_negative
video_analysis.inspection.passes[0] kind:value mode:value model:missing fps:positive status:value elapsed_ms:not_negative ai_likelihood:range
  classification:value summary:missing input_tokens:not_negative output_tokens:not_negative consistency_issues[0]:missing
video_analysis.inspection.passes[0].intervals[0] start_seconds:not_negative end_seconds:not_negative fps:positive
video_analysis.inspection.passes[0].raw_analysis ai_likelihood:range visual_classification:value visual_assessment:value audio_assessment:value
  identity_manipulation:value content_type:value summary:length evidence_against_ai[0]:missing alternative_explanations[0]:missing
  limitations[0]:missing agentic_processing_observed:missing evidence_sufficiency:value quality_issues[0]:missing
video_analysis.inspection.passes[0].raw_analysis.suspicious_moments[0] timestamp:length observation:length severity:value category:value
provenance status:value embedded:missing indicates_generative_ai:missing digital_source_types[0]:missing validation_messages[0]:missing note:missing
youtube status:value
youtube.metadata thumbnail_url:format contains_synthetic_media:missing has_explicit_ai_disclosure:missing disclosure_reasons[0]:missing
youtube.comments status:value sample_size:count comments_claiming_ai:count comments_claiming_real:count creator_admission_found:missing
  credible_source_claim_found:missing comment_summary:missing
media_receipt sha256:format duration_seconds:positive width:positive height:positive fps:positive has_audio:missing size_bytes:positive
  mime_type:missing
social_context platform:value media_id:missing disclosure_reasons[0]:missing
"""


def _listed() -> dict[str, str]:
    rules, head = {}, ""
    for line in PATHS.strip().splitlines():
        words = line.split()
        if not line.startswith(" "):
            head = "result." + ("" if words[0] == "." else words[0] + ".")
            words = words[1:]
        rules.update((head + path, rule) for path, rule in (w.rsplit(":", 1) for w in words))
    return rules


RULES = _listed()
NUMBERS = {path: i for i, path in enumerate(RULES)}
BASE = NUMBERS["result.base_score"]

# A value that keeps and one that breaks each named rule, as SQL.
EXAMPLES = {
    "missing": ("'text'", "CAST(NULL AS STRING)"), "length": ("'x'", "''"), "range": ("1.0D", "-1.0D"), "finite": ("-2.5D", "double('NaN')"),
    "positive": ("0.5D", "0.0D"), "not_negative": ("0.0D", "-0.5D"), "count": ("3.0D", "2.5D")}
FORMATS = {k.HTTP_STATUS: ("200", "700"), k.URL: ("'https://example.org/a'", "'ftp://example.org/a'"), k.DIGEST: (f"'{'0a' * 32}'", f"'{'0A' * 32}'")}


def examples(rule: k.Value) -> tuple[Column, Column]:
    if rule in FORMATS:
        good, bad = FORMATS[rule]
    elif rule.values:
        first = rule.values[0]
        return F.lit(first), F.lit(not first) if isinstance(first, bool) else F.lit(first + 1) if isinstance(first, int) else F.lit(f"{first}!")
    elif rule is k.FLAG:
        good, bad = "true", "CAST(NULL AS BOOLEAN)"
    else:
        good, bad = EXAMPLES[rule.rule]
    return F.expr(good), F.expr(bad)


def leaves(contract: k.Contract, path: str = "result") -> list[tuple[str, k.Value]]:
    """Every value of a contract in order, lists by their last item."""
    if isinstance(contract, k.Optional):
        return leaves(contract.of, path)
    if isinstance(contract, k.Value):
        return [(path, contract)]
    if isinstance(contract, k.Items):
        return leaves(contract.item, f"{path}[{max(contract.least - 1, 0)}]")
    return [leaf for name, child in contract.fields.items() for leaf in leaves(child, f"{path}.{name}")]


def document(contract: k.Contract, broken: Column, numbers: dict[str, int], path: str = "result") -> Column:
    """A document that keeps the contract but for the value with the number ``broken``."""
    if isinstance(contract, k.Optional):
        return document(contract.of, broken, numbers, path)
    if isinstance(contract, k.Value):
        good, bad = examples(contract)
        return F.when(broken == numbers[path], bad).otherwise(good)
    if isinstance(contract, k.Items):
        last = max(contract.least - 1, 0)
        item = document(contract.item, broken, numbers, f"{path}[{last}]")
        return F.array(*[document(contract.item, F.lit(-1), numbers, f"{path}[{last}]")] * last, item)
    return F.struct(*[document(child, broken, numbers, f"{path}.{name}").alias(name) for name, child in contract.fields.items()])


@query("validate_document", "WITH v(i, path, rule) AS (VALUES " + ", ".join(
    f"({i},'{path}','{RULES[path]}')" for path, i in NUMBERS.items()) + f""") SELECT clip_id, path, rule FROM {{clips}} JOIN v ON h % {len(NUMBERS) + 1}=i
   UNION ALL SELECT clip_id, 'result.base_score', 'range' FROM {{clips}} WHERE h % {len(NUMBERS) + 1}<>{BASE} AND ai_likelihood NOT BETWEEN 1 AND 99""")
def _(t):
    broken = (F.col("h") % (len(NUMBERS) + 1)).cast("int")
    rows = t.clips.select("clip_id", "ai_likelihood", broken.alias("broken"))
    made = document(k.RESULT, F.col("broken"), NUMBERS).withField(
        "base_score", F.when(F.col("broken") == BASE, -1.0).otherwise(F.col("ai_likelihood")))
    return k.validate_document(rows.select("clip_id", made.alias("document")), "clip_id", "document")
