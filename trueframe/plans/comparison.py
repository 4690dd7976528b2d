"""Truth joins, run comparison and execution queries."""

from pyspark.sql import functions as F

from ..functions.rules import decision_of, error_category
from ..operators import bootstrap, comparison, metrics
from ..session import spread
from .metrics import COUNT_SQL
from .ranking import ordinals, rounded
from .registry import query


@query("truth_join", """SELECT p.id, p.decision, p.error, p.confidence, m.group_id, m.label, m.split, m.generator,
   m.platform, m.dataset, m.transformation FROM {before_run} p JOIN {truth} m ON p.id=m.id AND p.sha256=m.sha256""")
def _(t):
    return comparison.truth_join(t.before_run, t.truth).select(
        "id", "decision", "error", "confidence", *comparison.TRUTH)


@query("truth_rejects", """SELECT p.id, CASE WHEN m.id IS NULL THEN 'unknown_id' ELSE 'hash_mismatch' END AS problem
   FROM {before_run} p LEFT JOIN {truth} m ON p.id=m.id WHERE m.id IS NULL OR m.sha256<>p.sha256
  UNION ALL SELECT id, 'duplicate_id' FROM {before_run} GROUP BY id HAVING count(*) > 1""")
def _(t):
    return comparison.truth_mismatches(t.before_run, t.truth)


@query("fill_not_attempted", """SELECT m.id, m.label, m.group_id, p.decision,
    CASE WHEN p.id IS NULL THEN 'not_attempted' ELSE p.error END AS error, p.elapsed_ms
    FROM {truth} m LEFT JOIN {before_run} p ON p.id=m.id""")
def _(t):
    return comparison.fill_not_attempted(t.before_run, t.truth).select(
        "id", "label", "group_id", "decision", "error", "elapsed_ms")


@query("resume_pending", """SELECT id, split FROM {truth} WHERE id NOT IN (SELECT id FROM {before_run} WHERE error IS NULL)""")
def _(t):
    return comparison.resume_pending(t.truth, t.before_run, retry_errors=True).select("id", "split")


PAIRS = """b AS (SELECT m.id, p.sha256, m.group_id, m.label, p.decision, p.error FROM {before_run} p JOIN {truth} m ON p.id=m.id),
 a AS (SELECT m.id, p.sha256, m.group_id, CASE WHEN m.num % 67 = 3 THEN 'ai' ELSE m.label END AS label, p.decision, p.error
   FROM {after_run} p JOIN {truth} m ON p.id=m.id)"""


def _sides(t):
    truth = t.truth.select("id", "num", "group_id", "label")
    before = t.before_run.drop("num").join(truth, "id")
    after = t.after_run.drop("num").join(truth, "id").withColumn(
        "label", F.when(F.col("num") % 67 == 3, "ai").otherwise(F.col("label")))
    return before, after


@query("paired_runs", "WITH " + PAIRS + """ SELECT * FROM (SELECT coalesce(b.id, a.id) AS id,
   CASE WHEN b.id IS NULL THEN 'missing_before' WHEN a.id IS NULL THEN 'missing_after' WHEN a.sha256<>b.sha256 THEN 'hash_mismatch'
    WHEN a.group_id<>b.group_id THEN 'group_mismatch' WHEN a.label<>b.label THEN 'label_mismatch' END AS problem
   FROM b FULL JOIN a ON a.id=b.id) WHERE problem IS NOT NULL""")
def _(t):
    return comparison.pair_violations(*_sides(t))


TWO = """pr AS (SELECT j.id, j.group_id, j.label, j.label IN ('ai','mixed') AS pos,
   CASE WHEN j.error IS NULL AND j.decision IN ('ai','not_ai','abstain') THEN j.decision ELSE 'error' END AS before,
   CASE WHEN r.error IS NULL AND r.decision IN ('ai','not_ai','abstain') THEN r.decision ELSE 'error' END AS after
   FROM {judged} j JOIN {rejudged} r ON j.id=r.id)"""


def _pairs(t):
    return comparison.pairs(t.judged, t.rejudged)


@query("transitions", "WITH " + TWO + """ SELECT CASE WHEN pos THEN 'ai' ELSE 'non_ai' END AS class, before, after, count(*) AS n FROM pr GROUP BY 1,2,3""")
def _(t):
    return comparison.transitions(_pairs(t))


@query("mcnemar", "WITH " + TWO + """, c AS (SELECT count(*) AS pairs, count(*) FILTER (before<>'ai' AND after='ai') AS improved,
    count(*) FILTER (before='ai' AND after<>'ai') AS regressed FROM pr WHERE pos)
 SELECT pairs, improved, regressed, round((improved-regressed)::DOUBLE/pairs,9) AS recall_difference,
  round(least(1, 2*(SELECT sum(exp(lgamma(n+1)-lgamma(k+1)-lgamma(n-k+1)-n*ln(2))) FROM
    (SELECT (improved+regressed)::DOUBLE AS n, unnest(range(least(improved,regressed)+1))::DOUBLE AS k FROM c))),9) AS p_value FROM c""")
def _(t):
    return rounded(comparison.mcnemar(_pairs(t)), "recall_difference", "p_value")


@query("paired_bootstrap", "WITH " + TWO + """, vec AS (SELECT group_id, count(*) AS n,
    sum((after='ai')::INT - (before='ai')::INT) AS d FROM pr WHERE pos GROUP BY 1), """ + ordinals(9183327, 10000) + """,
  rep AS (SELECT r, sum(d*m)::DOUBLE/sum(n*m) AS x FROM drawn JOIN ord USING (o) GROUP BY 1)
  SELECT round(quantile_cont(x, 0.025),9) AS low, round(quantile_cont(x, 0.975),9) AS high, count(*) AS replicates FROM rep""")
def _(t):
    return rounded(bootstrap.paired_bootstrap(_pairs(t), method="addressed"), "low", "high")


@query("paired_bootstrap_split")
def _(t):
    return rounded(bootstrap.paired_bootstrap(_pairs(t)), "low", "high")


@query("quantiles", """SELECT generator, count(elapsed_ms) AS measured, round(quantile_cont(elapsed_ms,0.5),6) AS median,
   round(quantile_cont(elapsed_ms,0.95),6) AS p95, quantile_disc(elapsed_ms,0.95) AS p95_nearest, max(elapsed_ms) AS max
   FROM {judged} GROUP BY 1""")
def _(t):
    return rounded(comparison.quantiles(t.judged, "elapsed_ms", ["generator"]), "median", "p95", digits=6)


@query("execution_by_pass", """SELECT kind, mode, model, count(*) AS observed, count(*) FILTER (status='complete') AS complete,
  count(*) FILTER (status='failed') AS failed, count(*) FILTER (status NOT IN ('complete','failed')) AS unknown,
  count(*) FILTER (status='complete' AND valid_for_corroboration=FALSE) AS complete_invalid,
  coalesce(sum(input_tokens),0)::BIGINT AS input_tokens, coalesce(sum(output_tokens),0)::BIGINT AS output_tokens,
  count(*) FILTER (input_tokens IS NULL) AS missing_input, count(*) FILTER (output_tokens IS NULL) AS missing_output,
  count(elapsed_ms) AS measured, round(quantile_cont(elapsed_ms,0.5),6) AS median_ms, round(quantile_cont(elapsed_ms,0.95),6) AS p95_ms
  FROM {passes} GROUP BY 1,2,3""")
def _(t):
    return rounded(comparison.execution_by_pass(t.passes), "median_ms", "p95_ms", digits=6)


@query("usage_totals", """SELECT coalesce(sum(input_tokens),0)::BIGINT AS input_tokens, coalesce(sum(output_tokens),0)::BIGINT AS output_tokens,
  count(*) FILTER (input_tokens IS NULL OR output_tokens IS NULL) AS missing_usage_passes,
  count(*) FILTER (status <> 'complete') AS failed_passes FROM {passes}""")
def _(t):
    return comparison.usage_totals(t.passes)


@query("scan_trace_flags", "WITH x AS (SELECT clip_id, bool_or(status='failed') AS f, " + """
   bool_or(coalesce(status='complete' AND valid_for_corroboration=FALSE, FALSE)) AS i FROM {passes} GROUP BY 1),
 flags AS (SELECT j.*, x.f, x.i, error IS NULL AND decision IN ('ai','not_ai','abstain') AS done, label IN ('ai','mixed') AS pos
   FROM {judged} j LEFT JOIN x ON j.num=x.clip_id)
 SELECT count(*) FILTER (f IS NULL) AS without_trace, count(*) FILTER (f) AS with_failed_pass,
   count(*) FILTER (i) AS with_invalid_corroboration, """ + ", ".join(
    f"count(*) FILTER (f AND done AND {p} AND decision='{d}') AS {n}" for n, p, d in (
        ("failed_tp", "pos", "ai"), ("failed_fn", "pos", "not_ai"), ("failed_fp", "NOT pos", "ai"),
        ("failed_tn", "NOT pos", "not_ai"))) + " FROM flags")
def _(t):
    scans = comparison.scan_flags(t.judged.withColumn("clip_id", F.col("num")), t.passes)
    flagged = metrics.outcome_flags(scans)
    return flagged.agg(
        F.count_if("no_trace").alias("without_trace"), F.count_if("failed_pass").alias("with_failed_pass"),
        F.count_if("invalid_corroboration").alias("with_invalid_corroboration"),
        *[F.count_if(F.col("failed_pass") & (F.col(f"is_{c}") == 1)).alias(f"failed_{c}") for c in ("tp", "fn", "fp", "tn")])


@query("verdict_to_decision", """SELECT coalesce(d, 'unknown_verdict') AS decision, count(*) AS n FROM (SELECT CASE WHEN n_chars % 10 = 0 THEN 'ai'
   WHEN v IN ('likely ai','ai detected') THEN 'ai' WHEN v IN ('unlikely ai','likely authentic') THEN 'not_ai'
   WHEN v IN ('inconclusive') THEN 'abstain' END AS d FROM (SELECT n_chars, lower(CASE n_chars % 6 WHEN 0 THEN 'Likely AI' WHEN 1 THEN 'AI detected'
   WHEN 2 THEN 'Unlikely AI' WHEN 3 THEN 'Likely authentic' WHEN 4 THEN 'Inconclusive' ELSE 'Perhaps' END) AS v FROM {documents})) GROUP BY 1""")
def _(t):
    n = F.col("n_chars")
    verdict = F.element_at(F.array(*[F.lit(x) for x in (
        "Likely AI", "AI detected", "Unlikely AI", "Likely authentic", "Inconclusive", "Perhaps")]), (n % 6 + 1).cast("int"))
    return t.documents.select(F.coalesce(decision_of(F.when(n % 10 == 0, "ai"), verdict), F.lit("unknown_verdict")).alias(
        "decision")).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query("error_category", r"""SELECT category, count(*) AS n FROM (SELECT CASE
   WHEN regexp_matches(m, 'quota|429|rate.limit') THEN 'ProviderRateLimit'
   WHEN regexp_matches(m, '401|403|permission|api.key|unauthorized|authentication') THEN 'ProviderAuthentication'
   WHEN regexp_matches(m, 'timeout|timed.out|abort') THEN 'OperationalTimeout'
   WHEN regexp_matches(m, 'schema|json|parse|invalid') THEN 'ResponseValidationError'
   WHEN regexp_matches(m, 'upload|processing|file') THEN 'MediaProcessingError' ELSE 'UnclassifiedOperationalError' END AS category
   FROM (SELECT lower(text) AS m FROM {documents})) GROUP BY 1""")
def _(t):
    return spread(t.documents.select("text")).select(error_category(F.col("text")).alias("category")).groupBy("category").agg(
        F.count(F.lit(1)).alias("n"))


@query("ensemble_or", """WITH flags AS (SELECT j.group_id, j.label, j.confidence, j.error, j.label IN ('ai','mixed') AS pos,
   j.error IS NULL AND j.decision IN ('ai','not_ai','abstain') AS done,
   CASE WHEN j.decision='ai' OR r.score > 0 THEN 'ai' ELSE j.decision END AS decision
   FROM {judged} j JOIN {rejudged} r ON j.id=r.id) SELECT """ + COUNT_SQL + " FROM flags")
def _(t):
    other = t.rejudged.select("id", F.col("score").alias("other_score"))
    both = t.judged.join(other, "id").withColumn("decision", F.when(
        (F.col("decision") == "ai") | (F.col("other_score") > 0), "ai").otherwise(F.col("decision")))
    return metrics.confusion(both)


@query("three_way_case_join", """SELECT m.id, m.label, j.decision AS first, r.decision AS second, p.decision AS third
   FROM {truth} m JOIN {judged} j ON m.id=j.id AND m.sha256=j.sha256 JOIN {rejudged} r ON m.id=r.id AND m.sha256=r.sha256
   JOIN {before_run} p ON m.id=p.id AND m.sha256=p.sha256""")
def _(t):
    key = ["id", "sha256"]
    pick = lambda df, name: df.select(*key, F.col("decision").alias(name))
    return (t.truth.select(*key, "label").join(pick(t.judged, "first"), key).join(pick(t.rejudged, "second"), key)
            .join(pick(t.before_run, "third"), key).drop("sha256"))


@query("parent_child_join", """SELECT c.id, count(o.id) AS matches, min(o.id) AS parent_id FROM {truth} c LEFT JOIN {truth} o
   ON o.group_id=c.group_id AND o.transformation='original' WHERE c.transformation<>'original' GROUP BY 1""")
def _(t):
    original = F.col("transformation") == "original"
    return comparison.parent_child(t.truth.filter(~original), t.truth.filter(original)).select(
        "id", "matches", "parent_id")
