"""Time-sample, coverage, ledger and streak queries on ``events`` and ``orders``."""

from decimal import Decimal

from pyspark.sql import functions as F

from ..operators import timeline as tl
from ..operators.ordered import split_hot
from .registry import query

ORDER = ["at_us", "event_id"]
DAY_US = 86_400_000_000


def positioned(df):
    """Decimal position of each sample."""
    return df.withColumn("position", (F.col("nano").cast("decimal(18,0)") * F.lit(Decimal("0.000000001"))).cast("decimal(18,9)"))


def placed(df):
    """Positions, and days as buckets of the largest cases."""
    return split_hot(positioned(df), ["case_id"], F.floor(F.col("at_us") / DAY_US), "day")


def valid(t):
    return tl.sample_validity(placed(t.samples), F.lit(31))


def judged_rows(t):
    """The same without buckets, for what needs no order."""
    return tl.sample_validity(positioned(t.samples), F.lit(31))


VALID = """v AS (SELECT *, nano/1e9::DOUBLE AS position, score IS NOT NULL AND nano >= 0 AND nano < 31000000000 AS valid,
    CASE WHEN score IS NOT NULL AND nano >= 0 AND nano < 31000000000 THEN score >= 0.5 END AS positive,
    row_number() OVER (PARTITION BY case_id ORDER BY at_us, event_id) AS i FROM {samples})"""
RUNS = """p AS (SELECT *, lag(coalesce(positive,FALSE)) OVER w AS pp, nano - lag(nano) OVER w AS gap FROM v
     WINDOW w AS (PARTITION BY case_id ORDER BY i)),
  b AS (SELECT *, sum(CASE WHEN pp AND gap > 0 AND gap <= 600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY case_id ORDER BY i) AS g
     FROM p WHERE TRUE QUALIFY coalesce(positive, FALSE)),
  runs AS (SELECT case_id, arg_min(event_id, i) AS first_event_id, count(*) AS n, min(nano) AS f, max(nano) AS l,
     max(score) AS max_score, CASE WHEN count(*) >= 2 THEN 'persistent' ELSE 'isolated' END AS kind FROM b GROUP BY case_id, g)"""
# the break counter must run over positive rows only, so number them after the filter
RUNS = RUNS.replace("""  b AS (SELECT *, sum(CASE WHEN pp AND gap > 0 AND gap <= 600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY case_id ORDER BY i) AS g
     FROM p WHERE TRUE QUALIFY coalesce(positive, FALSE)),""", """  q AS (SELECT * FROM p WHERE positive),
  b AS (SELECT *, sum(CASE WHEN pp AND gap > 0 AND gap <= 600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY case_id ORDER BY i) AS g FROM q),""")


@query("sample_validity", "WITH " + VALID + """ SELECT event_id, case_id, valid, positive, CASE WHEN nano < 0 OR nano >= 31000000000 THEN
  'position_not_in_media' || CASE WHEN score IS NULL THEN '|score_not_in_unit_interval' ELSE '' END
  WHEN score IS NULL THEN 'score_not_in_unit_interval' ELSE '' END AS issues FROM v""")
def _(t):
    return judged_rows(t).select("event_id", "case_id", "valid", "positive", F.array_join("issues", "|").alias("issues"))


@query("persistent_runs", "WITH " + VALID + ", " + RUNS + """ SELECT case_id, first_event_id, n, f/1e9::DOUBLE AS first_position,
   l/1e9::DOUBLE AS last_position, max_score, kind FROM runs""")
def _(t):
    return tl.persistent_runs(valid(t), ORDER, "day").select(
        "case_id", "first_event_id", "n", F.col("first_position").cast("double").alias("first_position"),
        F.col("last_position").cast("double").alias("last_position"), "max_score", "kind")


COVER = """ends AS (SELECT case_id, count(*) FILTER (NOT valid) AS bad, arg_min(nano, i) AS f, arg_min(valid, i) AS fv,
     arg_max(nano, i) AS l, arg_max(valid, i) AS lv FROM v GROUP BY 1),
  e AS (SELECT c.case_id, ends.* EXCLUDE (case_id), ends.case_id IS NULL AS none FROM {cases} c LEFT JOIN ends ON ends.case_id=c.case_id),
  pr AS (SELECT case_id, event_id, valid AND lag(valid) OVER w AS ok, nano - lag(nano) OVER w AS gap FROM v WINDOW w AS (PARTITION BY case_id ORDER BY i)),
  iss AS (SELECT case_id, 'no_samples' AS issue, NULL::BIGINT AS "at" FROM e WHERE none
    UNION ALL SELECT case_id, 'invalid_samples', NULL FROM e WHERE bad > 0
    UNION ALL SELECT case_id, 'initial_coverage_gap', NULL FROM e WHERE fv AND f > 2000000000
    UNION ALL SELECT case_id, 'terminal_coverage_gap', NULL FROM e WHERE lv AND 31000000000 - l > 3000000000
    UNION ALL SELECT case_id, 'positions_not_increasing', event_id FROM pr WHERE ok AND gap <= 0
    UNION ALL SELECT case_id, 'coverage_gap', event_id FROM pr WHERE ok AND gap > 2500000000)"""
LIMITS = dict(first_max=Decimal("2"), max_gap=Decimal("2.5"), tail_gap=Decimal("3"))


def issues(t, rows=None):
    return tl.coverage_issues(valid(t) if rows is None else rows, t.cases, ORDER, "day", **LIMITS)


@query("coverage_gaps", "WITH " + VALID + ", " + COVER + " SELECT case_id, issue, \"at\" FROM iss")
def _(t):
    return issues(t)


VERDICT = """vd AS (SELECT case_id, cohort, quality, parent_id, segment, ci, np, ni, ci = 0 AS complete,
    CASE WHEN ci > 0 THEN 'inconclusive' WHEN np > 0 THEN 'persistent_ai_indicators' WHEN ni > 0 THEN 'inconclusive'
      ELSE 'no_clear_indicators' END AS verdict FROM (SELECT c.*, coalesce(ci,0) AS ci, coalesce(np,0) AS np, coalesce(ni,0) AS ni FROM {cases} c
      LEFT JOIN (SELECT case_id, count(*) AS ci FROM iss GROUP BY 1) a USING (case_id)
      LEFT JOIN (SELECT case_id, count(*) FILTER (kind='persistent') AS np, count(*) FILTER (kind='isolated') AS ni FROM runs GROUP BY 1) r USING (case_id)))"""
ALL_VERDICT = VALID + ", " + RUNS + ", " + COVER + ", " + VERDICT


def verdicts(t):
    rows = valid(t)
    return tl.temporal_verdict(t.cases, issues(t, rows), tl.persistent_runs(rows, ORDER, "day"))


@query("temporal_verdict", "WITH " + ALL_VERDICT + """ SELECT case_id, ci AS coverage_issues, np AS persistent, ni AS isolated, complete,
   verdict, verdict='inconclusive' OR ni > 0 AS review_required FROM vd""")
def _(t):
    return verdicts(t).select("case_id", "coverage_issues", "persistent", "isolated", "complete", "verdict", "review_required")


@query("verdict_stability", "WITH " + ALL_VERDICT + """, saved AS (SELECT case_id, CASE WHEN case_id % 5 = 0 THEN 'persistent_ai_indicators' ELSE 'inconclusive' END AS verdict
   FROM {cases} WHERE case_id % 50 <> 7) SELECT coalesce(vd.case_id, saved.case_id) AS case_id, vd.verdict, saved.verdict AS saved FROM vd FULL JOIN saved USING (case_id)
   WHERE vd.verdict IS DISTINCT FROM saved.verdict""")
def _(t):
    saved = t.cases.filter("case_id % 50 <> 7").select("case_id", F.when(
        F.col("case_id") % 5 == 0, "persistent_ai_indicators").otherwise("inconclusive").alias("verdict"))
    return tl.verdict_stability(verdicts(t), saved)


@query("max_score_verdict", "WITH " + VALID + """, g AS (SELECT case_id, count(*) FILTER (gap <= 0 OR gap > 2.5::DOUBLE + 1e-9::DOUBLE) AS broken FROM
   (SELECT case_id, position - lag(position) OVER (PARTITION BY case_id ORDER BY i) AS gap FROM v) WHERE gap IS NOT NULL GROUP BY 1),
  f AS (SELECT case_id, max(score) FILTER (valid) AS ms, count(*) FILTER (NOT valid) AS bad, count(*) FILTER (valid AND score>=0.5) AS h,
    count(*) FILTER (valid AND score>=0.5 AND position>=3 AND position<5) AS hi, arg_min(position,i) AS f, arg_max(position,i) AS l FROM v GROUP BY 1),
  x AS (SELECT c.case_id, c.segment, ms, coalesce(h,0) AS h, hi, coalesce(bad=0 AND f.f<=2 AND coalesce(broken,0)=0 AND 31-l <= 3+1e-9::DOUBLE, FALSE) AS covered
    FROM {cases} c LEFT JOIN f ON c.case_id=f.case_id LEFT JOIN g ON c.case_id=g.case_id)
  SELECT case_id, ms AS max_score, ms>=0.5 AS any_positive, covered, CASE WHEN covered THEN CASE WHEN ms>=0.5 THEN 'ai' ELSE 'not_ai' END END AS decision,
    CASE WHEN segment='BUILDING' THEN h>0 AND h=hi END AS localized FROM x""")
def _(t):
    return tl.max_score_verdict(valid(t), t.cases, ORDER, "day", first_max=2.0, max_gap=2.5, tail_gap=3.0,
                                mixed=F.col("segment") == "BUILDING")


@query("sample_flag_counts", "WITH " + VALID + " SELECT case_id, count(*) FILTER (valid AND positive) AS flagged, count(*) AS total FROM v GROUP BY 1")
def _(t):
    return tl.sample_flag_counts(judged_rows(t))


@query("op_reservation", """SELECT id, reserved, CASE WHEN operations IS NULL THEN 'unknown_operations' ELSE '' END
   || CASE WHEN operations > reserved THEN '|operations_exceed_reservation' ELSE '' END
   || CASE WHEN frames > reserved/5 THEN '|excess_frames' ELSE '' END
   || CASE WHEN operations IS DISTINCT FROM 5*frames THEN '|operations_frame_count_mismatch' ELSE '' END AS issues
  FROM (SELECT l_orderkey*10+l_linenumber AS id, (5*(ceil(l_quantity/0.5)+1))::BIGINT AS reserved, (l_quantity*2 + l_linenumber % 4 - 1)::BIGINT AS frames,
     CASE WHEN l_suppkey % 13 = 0 THEN NULL WHEN l_suppkey % 7 = 0 THEN (l_quantity*2)::BIGINT*5+3 ELSE (l_quantity*2 + l_linenumber % 4 - 1)::BIGINT*5 END AS operations FROM {lineitem})
  WHERE operations IS NULL OR operations > reserved OR frames > reserved/5 OR operations IS DISTINCT FROM 5*frames""")
def _(t):
    q, n, s = F.col("l_quantity"), F.col("l_linenumber"), F.col("l_suppkey")
    frames = (q * 2 + n % 4 - 1).cast("long")
    rows = t.lineitem.select(
        (F.col("l_orderkey") * 10 + n).alias("id"), q.alias("duration"), frames.alias("frames"),
        F.when(s % 13 == 0, None).when(s % 7 == 0, (q * 2).cast("long") * 5 + 3).otherwise(frames * 5).alias("operations"))
    checked = tl.op_reservation(rows).filter(F.size("issues") > 0)
    text = F.array_join("issues", "|")
    return checked.select("id", "reserved", F.when(F.col("operations").isNull(), text).otherwise(
        F.concat(F.lit("|"), text)).alias("issues"))


@query("op_ledger", """SELECT run_no, reported, sum(reported) OVER (ORDER BY run_no)::BIGINT AS observed, saved,
   sum(reported) OVER (ORDER BY run_no) <> saved AS ledger_mismatch, sum(reported) OVER (ORDER BY run_no) > 100000 AS over_cap
   FROM (SELECT o_orderkey AS run_no, 5*(o_orderkey % 4) AS reported, 30*(o_orderkey // 4) + 5*((o_orderkey % 4)*(o_orderkey % 4 + 1) // 2)
      + CASE WHEN o_orderkey % 1000 = 999 THEN 1 ELSE 0 END AS saved FROM {orders})""")
def _(t):
    k = F.col("o_orderkey")
    r = k % 4
    saved = 30 * F.floor(k / 4) + 5 * F.floor(r * (r + 1) / 2) + F.when(k % 1000 == 999, 1).otherwise(0)
    return tl.op_ledger(t.orders.select(k.alias("run_no"), (5 * r).alias("reported"), saved.alias("saved")), 100_000)


@query("byte_ledger", """SELECT seq, kind, reserved, CASE WHEN sequence <> rn THEN 'sequence_gap' WHEN kind='reserve' AND reserved > 2000000000 THEN 'over_budget' END AS problem
  FROM (SELECT *, row_number() OVER (ORDER BY seq)-1 AS rn, sum(CASE WHEN kind='reserve' THEN bytes ELSE 0 END) OVER (ORDER BY seq)::BIGINT AS reserved FROM {ledger})""")
def _(t):
    return tl.byte_ledger(t.ledger, 2_000_000_000)


@query("error_streak", """WITH e AS (SELECT case_id, at_us, event_id, CASE WHEN event_type IN ('error','view') THEN event_type END AS error,
    row_number() OVER (PARTITION BY case_id ORDER BY at_us, event_id) AS i FROM {samples}),
  l AS (SELECT *, lag(error) OVER w AS e1, lag(error,2) OVER w AS e2 FROM e WINDOW w AS (PARTITION BY case_id ORDER BY i)),
  s AS (SELECT case_id, min(i) AS i FROM l WHERE error=e1 AND error=e2 GROUP BY 1)
  SELECT e.case_id, e.at_us AS stop_at_us, e.event_id AS stop_event_id, e.error, (SELECT count(*) FROM e x WHERE x.case_id=e.case_id AND x.i>e.i) AS not_started
  FROM s JOIN e ON s.case_id=e.case_id AND s.i=e.i""")
def _(t):
    rows = placed(t.samples).withColumn("error", F.when(F.col("event_type").isin("error", "view"), F.col("event_type")))
    return tl.error_streak(rows, ORDER, "day")


@query("paired_positions", """WITH o AS (SELECT user_id AS parent_id, event_id - event_id % 2 AS position, min(value) AS score FROM {events} WHERE event_type IN ('view','click') GROUP BY 1,2),
   d AS (SELECT user_id AS parent_id, event_id - event_id % 2 AS position, min(value) AS score FROM {events} WHERE event_type IN ('click','purchase') GROUP BY 1,2)
  SELECT coalesce(o.parent_id, d.parent_id) AS parent_id, coalesce(o.position, d.position) AS position, o.score AS original_score, d.score AS degraded_score,
   CASE WHEN o.parent_id IS NULL THEN 'degraded_only' WHEN d.parent_id IS NULL THEN 'original_only' ELSE 'both' END AS side
  FROM o FULL JOIN d ON o.parent_id=d.parent_id AND o.position=d.position""")
def _(t):
    side = lambda *kinds: t.events.filter(F.col("event_type").isin(*kinds)).groupBy(
        F.col("user_id").alias("parent_id"), (F.col("event_id") - F.col("event_id") % 2).alias("position")).agg(
        F.min("value").alias("score"))
    return tl.paired_positions(side("view", "click"), side("click", "purchase"))


@query("screen_admission", """WITH c AS (SELECT CAST(p_partkey - CASE WHEN p_partkey % 333 = 1 THEN 1 ELSE 0 END AS STRING) AS id, md5(p_name || CAST(p_partkey % 1000 AS STRING)) AS sha256,
    p_size * 1.25 AS duration, p_size * 1100000 AS bytes FROM {part})
  SELECT id, problem FROM (SELECT id, 'unsupported_duration' AS problem FROM c WHERE NOT (duration > 0 AND duration < 60)
   UNION ALL SELECT id, 'media_byte_limit' FROM c WHERE bytes NOT BETWEEN 1 AND 50000000
   UNION ALL SELECT id, 'duplicate_id' FROM c GROUP BY 1 HAVING count(*)>1
   UNION ALL SELECT min(id), 'duplicate_bytes' FROM c GROUP BY sha256 HAVING count(*)>1
   UNION ALL SELECT 'total', CASE WHEN sum(5*(ceil(duration/0.5)+1)) <= 3000 THEN 'within_cap' ELSE 'over_cap' END FROM c)""")
def _(t):
    k = F.col("p_partkey")
    cases = t.part.select(
        (k - F.when(k % 333 == 1, 1).otherwise(0)).cast("string").alias("id"),
        F.md5(F.concat("p_name", (k % 1000).cast("string"))).alias("sha256"),
        (F.col("p_size") * 1.25).alias("duration"), (F.col("p_size") * 1_100_000).alias("bytes"))
    problems, total = tl.screen_admission(cases, 3000)
    return problems.unionByName(total.select(F.lit("total").alias("id"), F.when(
        F.col("within_cap"), "within_cap").otherwise("over_cap").alias("problem")))
