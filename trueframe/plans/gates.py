"""Cohort, gate and quota queries on receipts built from ``orders``."""

from pyspark.sql import functions as F

from ..operators import gates as g
from .ranking import rounded
from .registry import query

AI, CLEAR = g.AI, g.CLEAR


@query("cohort_counts", f"""SELECT cohort, quality, count(*) AS total, count(*) FILTER (decision='{AI}') AS ai, count(*) FILTER (decision='{CLEAR}') AS clear,
  count(*) FILTER (decision='inconclusive') AS inconclusive, count(*) FILTER (decision='technical_error') AS technical_error,
  count(*) FILTER (decision='not_attempted') AS not_attempted, count(*) FILTER (isolated>0) AS cases_with_isolated, sum(isolated)::BIGINT AS isolated_alerts,
  count(*) FILTER (decision='inconclusive' OR isolated>0) AS review_required,
  round(count(*) FILTER (decision='{AI}')::DOUBLE/count(*),9) AS detected_share, round(count(*) FILTER (decision='{CLEAR}')::DOUBLE/count(*),9) AS clear_share
  FROM {{receipts}} GROUP BY 1,2""".replace("{{", "{").replace("}}", "}"))
def _(t):
    return rounded(g.cohort_shares(g.cohort_counts(t.receipts, ["cohort", "quality"])), "detected_share", "clear_share")


ROLL = f"""SELECT cohort, parent_id, CASE max(r) WHEN 3 THEN 'technical_error' WHEN 2 THEN '{AI}' WHEN 1 THEN 'inconclusive' ELSE '{CLEAR}' END AS decision,
   bool_or(decision='{AI}') AS has_alert, count(*) AS files, sum(isolated)::BIGINT AS isolated_alerts, count(*) FILTER (isolated>0) AS cases_with_isolated
   FROM (SELECT *, CASE WHEN decision IN ('technical_error','not_attempted') THEN 3 WHEN decision='{AI}' THEN 2 WHEN decision='inconclusive' THEN 1 ELSE 0 END AS r
   FROM {{receipts}}) GROUP BY 1,2""".replace("{{", "{").replace("}}", "}")


@query("parent_rollup", ROLL)
def _(t):
    return g.parent_rollup(t.receipts)


RULES = [
    ("publisher_recall", "publisher_assigned_ai", None, "file", AI, 1500, None),
    ("publisher_original", "publisher_assigned_ai", "original", "file", AI, 400, None),
    ("publisher_mild", "publisher_assigned_ai", "mild", "file", AI, 400, None),
    ("publisher_severe", "publisher_assigned_ai", "severe", "file", AI, 100_000, None),
    ("no_negative_alerts", "documented_negative", None, "file", AI, None, 0),
    ("negative_clear_files", "documented_negative", None, "file", CLEAR, 1000, None),
    ("negative_clear_parents", "documented_negative", None, "parent", CLEAR, 20, None),
    ("unseen_cohort", "unknown", None, "file", AI, 1, None),
]


@query("acceptance_gates", "WITH roll AS (" + ROLL + "), gates(gate, cohort, quality, unit, decision, low, high) AS (VALUES "
       + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::BIGINT" for v in r) + ")" for r in RULES) + """),
  o AS (SELECT gate, low, high, CASE WHEN unit='file' THEN (SELECT count(*) FROM {receipts} r WHERE r.cohort=gates.cohort AND r.decision=gates.decision
      AND (gates.quality IS NULL OR r.quality=gates.quality)) ELSE (SELECT count(*) FROM roll r WHERE r.cohort=gates.cohort AND r.decision=gates.decision) END AS observed FROM gates)
  SELECT gate, observed, low::BIGINT AS low, high::BIGINT AS high, (low IS NULL OR observed>=low) AND (high IS NULL OR observed<=high) AS passed FROM o""")
def _(t):
    return g.acceptance_gates(t.receipts, g.gate_table(t.spark, RULES))


@query("head_delta", """WITH c AS (SELECT clip_id, CASE WHEN max(logit)>=0 THEN TRUE WHEN bool_and(logit IS NOT NULL) THEN FALSE END AS a,
    CASE WHEN max(control_logit)>=0 THEN TRUE WHEN bool_and(control_logit IS NOT NULL) THEN FALSE END AS b, clip_id % 3 <> 0 AS pos FROM {window_runs} GROUP BY 1)
  SELECT count(*) AS compared, count(*) FILTER (a<>b) AS changed, count(*) FILTER (pos AND a) - count(*) FILTER (pos AND b) AS net_ai_gain,
   count(*) FILTER (NOT pos AND a AND NOT b) AS new_false_flags FROM c WHERE a IS NOT NULL AND b IS NOT NULL""")
def _(t):
    from ..operators.shots import clip_from_windows
    a = clip_from_windows(t.window_runs, "logit").select("clip_id", F.col("ai").alias("candidate"))
    b = clip_from_windows(t.window_runs, "control_logit").select("clip_id", F.col("ai").alias("control"))
    return g.head_delta(a.join(b, "clip_id").withColumn("label", F.when(F.col("clip_id") % 3 != 0, "ai").otherwise("real")))


MATRIX = ", ".join(f"CASE max(r) FILTER (quality='{q}') WHEN 3 THEN 'technical_error' WHEN 2 THEN 'inconclusive' WHEN 1 THEN '{CLEAR}' WHEN 0 THEN '{AI}' END AS {q}"
                   for q in ("original", "mild", "severe"))


@query("robustness_matrix", f"""SELECT parent_id, {MATRIX} FROM (SELECT *, CASE WHEN decision IN ('technical_error','not_attempted') THEN 3 WHEN decision='inconclusive' THEN 2
   WHEN decision='{CLEAR}' THEN 1 ELSE 0 END AS r FROM {{receipts}}) GROUP BY 1""".replace("{{", "{").replace("}}", "}"))
def _(t):
    return g.robustness_matrix(t.receipts)


@query("stage_gate", """WITH h AS (SELECT clip_id AS id, max(CASE WHEN logit>=0.5 THEN 1 ELSE 0 END) AS hit FROM {window_runs} GROUP BY 1),
  c AS (SELECT r.generator AS stage, r.quality<>'severe' AS pos, r.decision<>'technical_error' AS clean,
     r.decision = CASE WHEN r.quality<>'severe' THEN 'persistent_ai_indicators' ELSE 'no_clear_indicators' END AS ok, h.hit FROM {receipts} r LEFT JOIN h ON r.id=h.id)
  SELECT stage, count(*) AS cases, count(*) FILTER (NOT (clean AND ok AND coalesce((hit=1)=pos, FALSE))) AS failed,
    bool_and(clean AND ok AND coalesce((hit=1)=pos, FALSE)) AS passed FROM c GROUP BY 1""")
def _(t):
    d = F.col("decision")
    cases = t.receipts.select(
        "id", F.col("generator").alias("stage"), F.when(F.col("quality") == "severe", "real").otherwise("ai").alias("label"),
        F.when(d == "technical_error", "failed").alias("error"),
        F.when(d == AI, "ai").when(d == CLEAR, "not_ai").otherwise("abstain").alias("decision"))
    return g.stage_gate(cases, t.window_runs.select(F.col("clip_id").alias("id"), F.col("logit").alias("score")))


@query("quota_check", """WITH f AS (SELECT CASE WHEN cohort IS NULL THEN '{{"quality":"' || quality || '"}}' ELSE '{{"cohort":"' || cohort || '","quality":"' || quality || '"}}' END AS cell,
    count(*) AS n, sum(elapsed)::BIGINT AS total_bytes FROM (SELECT CASE WHEN cohort='documented_negative' THEN NULL ELSE cohort END AS cohort, quality, elapsed FROM {receipts}) GROUP BY 1),
  e(cell, planned) AS (VALUES ('{{"quality":"mild"}}', 2450::BIGINT), ('{{"cohort":"publisher_assigned_ai","quality":"mild"}}', 1), ('{{"cohort":"lost","quality":"mild"}}', 5))
  SELECT coalesce(f.cell, e.cell) AS cell, coalesce(n,0) AS n, coalesce(planned,0) AS planned, coalesce(total_bytes,0) AS total_bytes, n IS NOT DISTINCT FROM planned AS met
  FROM f FULL JOIN e ON f.cell=e.cell""")
def _(t):
    rows = t.receipts.select(F.when(F.col("cohort") != "documented_negative", F.col("cohort")).alias("cohort"), "quality",
                             F.col("elapsed").alias("bytes"))
    plan = t.spark.createDataFrame([(None, "mild", 2450), ("publisher_assigned_ai", "mild", 1), ("lost", "mild", 5)],
                                   "cohort string, quality string, n long")
    return g.quota_check(rows, plan, ["cohort", "quality"])


@query("byte_totals", """SELECT *, compressed+headers+names+extra_max AS first_attempt_max FROM (SELECT count(*) AS members, sum(compressed_bytes)::BIGINT AS compressed,
  sum(uncompressed_bytes)::BIGINT AS uncompressed, sum(strlen(name))::BIGINT AS names, 30*count(*) AS headers, 4096*count(*) AS extra_max FROM {census})""")
def _(t):
    return g.byte_totals(t.census)
