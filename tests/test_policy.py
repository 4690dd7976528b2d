import pytest
from pyspark.sql import functions as F

from trueframe.functions import policy as fp
from trueframe.operators import policy as p

BASE = dict(clip_id=1, ai_likelihood=5.0, visual_classification="likely_not_ai_generated", visual_assessment="likely_authentic",
            audio_assessment="likely_recorded", identity_manipulation="none_detected", evidence_sufficiency="sufficient",
            review_agreement="agree", visual_coverage="adequate", temporal_coverage="adequate", audio_coverage="adequate",
            invalid_observations=False, duration=20.0, provenance_status="not_found", provenance_generative=False, provenance_valid=False, provenance_trusted=False, disclosed=False,
            creator_admission=False, moments=[])
TYPES = ("clip_id int, ai_likelihood double, visual_classification string, visual_assessment string, audio_assessment string, identity_manipulation string, "
         "evidence_sufficiency string, review_agreement string, visual_coverage string, temporal_coverage string, audio_coverage string, invalid_observations boolean, "
         "duration double, provenance_status string, provenance_generative boolean, provenance_valid boolean, provenance_trusted boolean, disclosed boolean, creator_admission boolean, "
         "moments array<struct<timestamp:string,severity:string,category:string>>")
SEEN = [("00:05", "high", "temporal")]
MADE = dict(ai_likelihood=85.0, visual_classification="likely_ai_generated", visual_assessment="generated", moments=SEEN)
HEARD = [("00:05", "high", "audio")]

CASES = [
    (dict(), p.CLEAR, "complete"),
    (dict(visual_classification="inconclusive", visual_coverage=None, temporal_coverage=None, audio_coverage=None, review_agreement=None, evidence_sufficiency=None), p.OPEN, "limited"),
    *[(dict(ai_likelihood=x), p.OPEN, "conflicting") for x in (0.0, 100.0, float("nan"), float("inf"), 12.5)],
    (dict(MADE, moments=[], ai_likelihood=5.0), p.OPEN, "limited"),
    (dict(visual_classification="mixed_or_ai_edited", visual_assessment="edited"), p.OPEN, "limited"),
    (dict(audio_assessment="synthetic"), p.OPEN, "limited"),
    (dict(identity_manipulation="face_swap"), p.OPEN, "limited"),
    (dict(ai_likelihood=95.0), p.OPEN, "conflicting"),
    (dict(moments=SEEN), p.OPEN, "conflicting"),
    (MADE, p.DETECTED, "complete"),
    (dict(MADE, moments=[("00:02.50", "high", "temporal")]), p.DETECTED, "complete"),
    (dict(MADE, moments=[("00:25", "high", "temporal")]), p.OPEN, "limited"),  # outside the clip
    (dict(MADE, moments=[("00:05", "low", "temporal")]), p.OPEN, "limited"),
    (dict(MADE, evidence_sufficiency="limited"), p.DETECTED, "limited"),
    (dict(MADE, evidence_sufficiency="insufficient"), p.OPEN, "limited"),
    (dict(MADE, review_agreement="disagree"), p.OPEN, "conflicting"),
    (dict(MADE, temporal_coverage="limited"), p.DETECTED, "limited"),
    (dict(audio_assessment="synthetic", moments=HEARD, visual_classification="mixed_or_ai_edited"), p.OPEN, "limited"),  # audio alone never decides
    (dict(identity_manipulation="lip_sync_manipulation", moments=HEARD, visual_classification="inconclusive"), p.OPEN, "limited"),
    (dict(identity_manipulation="lip_sync_manipulation", moments=[("00:05", "medium", "identity")], visual_classification="inconclusive"), p.DETECTED, "complete"),
    (dict(audio_assessment="synthetic", audio_coverage="no_audio"), p.OPEN, "conflicting"),
    (dict(MADE, visual_coverage="unavailable"), p.OPEN, "conflicting"),
    (dict(audio_assessment="inconclusive"), p.OPEN, "limited"),
    (dict(audio_assessment="inconclusive", audio_coverage="no_audio"), p.CLEAR, "complete"),
    (dict(invalid_observations=True), p.OPEN, "limited"),
    (dict(disclosed=True, ai_likelihood=0.0), p.DISCLOSED, "complete"),
    (dict(creator_admission=True), p.DISCLOSED, "complete"),
    (dict(provenance_status="found", provenance_generative=True, provenance_valid=True, provenance_trusted=True, disclosed=True), p.VERIFIED, "complete"),
    (dict(provenance_status="invalid", provenance_generative=True, provenance_valid=True, provenance_trusted=True), p.CLEAR, "complete"),
    # a real camera's trusted credential, one that is not valid, one that is not trusted
    (dict(provenance_status="found", provenance_valid=True, provenance_trusted=True), p.CLEAR, "complete"),
    (dict(provenance_status="found", provenance_generative=True, provenance_trusted=True), p.CLEAR, "complete"),
    (dict(provenance_status="found", provenance_generative=True, provenance_valid=True), p.CLEAR, "complete"),
]


def frame(spark, items):
    names = [c.split()[0] for c in TYPES.split(", ")]
    return spark.createDataFrame([tuple({**BASE, **x, "clip_id": i}[n] for n in names) for i, x in enumerate(items)], TYPES)


def test_waterfall_table(spark):
    got = {r.clip_id: r for r in p.verdict_waterfall(frame(spark, [c[0] for c in CASES])).collect()}
    for i, (change, verdict, status) in enumerate(CASES):
        assert (got[i].verdict, got[i].assessment_status) == (verdict, status), change
        assert got[i].review_required == (status != "complete") and 1 <= got[i].base_score <= 99
        assert got[i].reasons


def test_replay_of_the_same_policy_changes_nothing(spark):
    rows = frame(spark, [c[0] for c in CASES])
    assert all(not r.changed_fields and not r.decision_changed for r in p.score_replay(rows, p.verdict_waterfall(rows)).collect())


@pytest.mark.parametrize("text, want", [("00:05", 5), ("1:02:03.5", 3723.5), ("0:59.999", 59.999), ("120:00", 7200), ("00:60", None), ("1:60:00", None),
                                        ("5", None), ("00:05\n", None), ("a:05", None), ("00:5", None), (None, None)])
def test_moment_seconds(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(fp.moment_seconds(F.col("t")).alias("s")).first().s == want


@pytest.mark.parametrize("base, temporal, verdict, status", [
    (p.CLEAR, (True, "persistent_ai_indicators", 1, 0), p.DETECTED, "complete"),
    (p.CLEAR, (True, "inconclusive", 0, 1), p.OPEN, "limited"),
    (p.CLEAR, (True, "no_clear_indicators", 0, 0), p.CLEAR, "complete"),
    (p.CLEAR, (False, "no_clear_indicators", 0, 0), p.OPEN, "limited"),
    (p.DETECTED, (True, "no_clear_indicators", 0, 0), p.OPEN, "conflicting"),
    (p.DISCLOSED, (True, "no_clear_indicators", 0, 0), p.DISCLOSED, "complete"),
    (p.VERIFIED, (True, "persistent_ai_indicators", 1, 0), p.VERIFIED, "complete"),
    (p.CLEAR, None, p.CLEAR, "complete"),
])
def test_fusion(spark, base, temporal, verdict, status):
    scored = spark.createDataFrame([(1, base, "complete", "Not calibrated", "x", False, ["r"])],
                                   "clip_id int, verdict string, assessment_status string, confidence string, evidence_label string, review_required boolean, reasons array<string>")
    seen = spark.createDataFrame([(1, *temporal)] if temporal else [], "clip_id int, complete boolean, verdict string, persistent int, isolated int")
    row = p.specialist_fusion(scored, seen).first()
    assert (row.verdict, row.assessment_status) == (verdict, status)


PASS = "clip_id int, kind string, ordinal int, status string, profile string, valid boolean, flawed boolean, sufficiency string, audio string"


@pytest.mark.parametrize("rows, agreement, selected", [
    ([("sweep", "n", True, False), ("review", "n", True, False)], "agree", "sweep"),
    ([("sweep", "n", True, False), ("review", "p", True, False)], "disagree", "sweep"),
    ([("sweep", "n", True, False), ("review", "p", True, False), ("adjudication", "p", True, False)], "resolved", "adjudication"),
    ([("sweep", "n", False, True), ("review", "n", False, True), ("adjudication", "n", True, False)], "disagree", "adjudication"),  # a third cannot repair two
    ([("sweep", "n", False, True), ("review", "n", True, False), ("adjudication", "n", True, False)], "resolved", "adjudication"),
    ([("review", "n", True, False)], "not_available", "review"),
    ([("sweep", "u", False, False), ("review", "u", False, False)], "not_available", "sweep"),
])
def test_pass_agreement(spark, rows, agreement, selected):
    df = spark.createDataFrame([(1, k, 0, "complete", f, v, x, "sufficient", "likely_recorded") for k, f, v, x in rows], PASS)
    row = p.pass_agreement(df).first()
    assert (row.agreement, row.selected.kind) == (agreement, selected)


def test_overlap_free_windows(spark):
    from trueframe.operators.shots import overlap_free_topk
    items = [("00:05", "low", "x"), ("00:06", "high", "x"), ("00:09", "medium", "x"), ("00:19", "low", "x"), ("00:30", "high", "x"), ("00:15", "low", "x"), ("00:00", "low", "x")]
    df = frame(spark, [dict(moments=items)])
    got = [(w.start, w.end) for w in overlap_free_topk(df, fp.moment_seconds).first().windows]
    assert got == plain_windows(items, 20)


def plain_windows(items, duration):
    rank, out = {"high": 3, "medium": 2, "low": 1}, []
    for t, sev, _ in sorted(items, key=lambda m: -rank[m[1]]):
        s = int(t[3:])
        if s > duration:
            continue
        a, b = max(0, s - 2), min(duration, s + 2)
        if b <= a or any(x <= b and y >= a for x, y in out):
            continue
        out.append((a, b))
        if len(out) == 3:
            break
    return out
