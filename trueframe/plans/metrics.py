"""Confusion, calibration and accuracy queries."""

from pyspark.sql import functions as F

from ..functions.rules import score_band, disagreement_band
from ..operators import metrics as m
from .registry import query

FLAGS = """
flags AS (SELECT *, error IS NULL AND decision IN ('ai','not_ai','abstain') AS done,
    label IN ('ai','mixed') AS pos FROM {judged})"""

COUNT_SQL = """count(*) AS attempted, count(*) FILTER (done) AS completed,
    count(*) FILTER (NOT done) AS errors, count(DISTINCT group_id) AS source_groups,
    count(*) FILTER (done AND pos AND decision='ai') AS tp,
    count(*) FILTER (done AND pos AND decision='not_ai') AS fn,
    count(*) FILTER (done AND NOT pos AND decision='ai') AS fp,
    count(*) FILTER (done AND NOT pos AND decision='not_ai') AS tn,
    count(*) FILTER (done AND pos AND decision='abstain') AS abstained_ai,
    count(*) FILTER (done AND NOT pos AND decision='abstain') AS abstained_non_ai,
    count(*) FILTER (done AND decision<>'abstain' AND confidence='High') AS high,
    count(*) FILTER (done AND confidence='High' AND ((pos AND decision='not_ai') OR (NOT pos AND decision='ai'))) AS high_wrong"""


@query("confusion", "WITH " + FLAGS + f" SELECT {COUNT_SQL} FROM flags")
def _(t):
    return m.confusion(t.judged)


RATE_SQL = " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{name}' AS rate, ({top})::BIGINT AS numerator, ({base})::BIGINT AS denominator FROM c)"
    for name, (top, base) in {
        "ai_recall": ("tp", "pos_n"), "false_positive_rate": ("fp", "neg_n"),
        "ai_detection_failure_rate": ("pos_n - tp", "pos_n"), "false_negative_rate": ("fn", "pos_n"),
        "false_negative_contamination": ("fn", "fn+tn"), "ai_precision": ("tp", "tp+fp"),
        "abstention_rate": ("abst", "completed"), "coverage": ("completed-abst", "completed"),
        "committed_accuracy": ("tp+tn", "tp+tn+fp+fn"), "high_confidence_error_rate": ("high_wrong", "high"),
        "completion_rate": ("completed", "attempted")}.items())
WILSON_SQL = """
    SELECT rate, numerator, denominator, round(p, 9) AS estimate,
      CASE WHEN n > 0 THEN round(greatest(0, (p + z*z/(2*n))/(1+z*z/n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n))/(1+z*z/n)), 9) END AS low,
      CASE WHEN n > 0 THEN round(least(1, (p + z*z/(2*n))/(1+z*z/n) + z*sqrt(p*(1-p)/n + z*z/(4*n*n))/(1+z*z/n)), 9) END AS high
    FROM (SELECT *, 1.959963984540054::DOUBLE AS z, nullif(denominator,0)::DOUBLE AS n,
          numerator::DOUBLE/nullif(denominator,0) AS p FROM r)"""


@query("rates_wilson", "WITH " + FLAGS + f""",
 c AS (SELECT {COUNT_SQL}, count(*) FILTER (done AND pos) AS pos_n, count(*) FILTER (done AND NOT pos) AS neg_n,
       count(*) FILTER (done AND decision='abstain') AS abst FROM flags), r AS ({RATE_SQL}) {WILSON_SQL}""")
def _(t):
    out = m.rates(m.confusion(t.judged))
    return out.select("rate", "numerator", "denominator",
                      *[F.round(c, 9).alias(c) for c in ("estimate", "low", "high")])


@query("breakdown", "WITH " + FLAGS + ", u AS (" + " UNION ALL ".join(
    f"SELECT '{s}' AS slice, coalesce({v},'unknown') AS value, {COUNT_SQL} FROM flags GROUP BY 2"
    for s, v in [(s, s) for s in m.SLICES]) + f""" UNION ALL SELECT 'overall', 'all', {COUNT_SQL} FROM flags),
  w AS (SELECT *, tp+fn+abstained_ai AS d FROM u)
  SELECT slice, value, attempted, completed, errors, source_groups, tp, fn, fp, tn, abstained_ai, abstained_non_ai,
    high, high_wrong, round(tp::DOUBLE/nullif(d,0), 9) AS ai_recall,
    CASE WHEN n > 0 THEN round(greatest(0, (p + z*z/(2*n))/(1+z*z/n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n))/(1+z*z/n)), 9) END AS recall_low,
    CASE WHEN n > 0 THEN round(least(1, (p + z*z/(2*n))/(1+z*z/n) + z*sqrt(p*(1-p)/n + z*z/(4*n*n))/(1+z*z/n)), 9) END AS recall_high
  FROM (SELECT *, 1.959963984540054::DOUBLE AS z, nullif(d,0)::DOUBLE AS n, tp::DOUBLE/nullif(d,0) AS p FROM w)""")
def _(t):
    from ..functions.stats import ratio, wilson_bounds
    base = F.col("tp") + F.col("fn") + F.col("abstained_ai")
    low, high = wilson_bounds(F.col("tp"), base)
    return m.breakdown(t.judged).withColumns({
        "ai_recall": F.round(ratio(F.col("tp"), base), 9),
        "recall_low": F.round(low, 9), "recall_high": F.round(high, 9)})


@query("end_to_end", "WITH " + FLAGS + """ SELECT selected, ai_selected, ai_hits, correct,
   round(ai_hits::DOUBLE/nullif(ai_selected,0),9) AS ai_recall, round(correct::DOUBLE/nullif(selected,0),9) AS correct_rate
 FROM (SELECT count(*) AS selected, count(*) FILTER (pos) AS ai_selected,
   count(*) FILTER (pos AND done AND decision='ai') AS ai_hits,
   count(*) FILTER (done AND ((pos AND decision='ai') OR (NOT pos AND decision='not_ai'))) AS correct FROM flags)""")
def _(t):
    return m.end_to_end(t.judged).withColumns({c: F.round(c, 9) for c in ("ai_recall", "correct_rate")})


THRESH = """count(*) FILTER (score>=0.5 AND pos) AS tp, count(*) FILTER (score>=0.5 AND NOT pos) AS fp,
  count(*) FILTER (score<0.5 AND pos) AS fn, count(*) FILTER (score<0.5 AND NOT pos) AS tn"""
THRESH_RATES = """round((tp+tn)::DOUBLE/(tp+tn+fp+fn),9) AS accuracy, round(prec,9) AS precision, round(rec,9) AS recall,
  round(2*prec*rec/(prec+rec+1e-8::DOUBLE),9) AS f1, round(fp/(fp+tn+1e-8::DOUBLE),9) AS fpr"""
GUARD = "tp/(tp+fp+1e-8::DOUBLE) AS prec, tp/(tp+fn+1e-8::DOUBLE) AS rec"
ROUNDED = ("accuracy", "precision", "recall", "f1", "fpr")


@query("threshold_metrics", "WITH " + FLAGS + f""", c AS (SELECT {THRESH} FROM flags)
 SELECT tp, fp, fn, tn, {THRESH_RATES} FROM (SELECT *, {GUARD} FROM c)""")
def _(t):
    return m.threshold_metrics(t.judged).withColumns({c: F.round(c, 9) for c in ROUNDED})


@query("metrics_by_source", "WITH " + FLAGS + f""",
 c AS (SELECT 'generator' AS dimension, generator AS value, {THRESH} FROM flags GROUP BY 2
       UNION ALL SELECT 'platform', platform, {THRESH} FROM flags GROUP BY 2)
 SELECT dimension, value, tp, fp, fn, tn, {THRESH_RATES} FROM (SELECT *, {GUARD} FROM c)""")
def _(t):
    return m.metrics_by_source(t.judged, ["generator", "platform"]).withColumns(
        {c: F.round(c, 9) for c in ROUNDED})


ECE_BINS = """bins AS (SELECT platform, floor(score*10) AS b, sum(pos::INT) AS k, sum(score) AS p FROM flags
   WHERE score>=0 AND score<1 GROUP BY 1,2), tot AS (SELECT platform, count(*) AS rows FROM flags GROUP BY 1)"""


@query("ece", "WITH " + FLAGS + ", " + ECE_BINS + """ SELECT platform, rows, round(sum(abs(k-p))/rows, 9) AS ece
  FROM tot JOIN bins USING (platform) GROUP BY platform, rows""")
def _(t):
    return m.ece(t.judged, keys=["platform"]).withColumn("ece", F.round("ece", 9))


def _grid(name: str, low: str, high: str) -> str:
    return f"""
 {name}_b AS (SELECT i, t, floor(round(10/(1+exp(-logit/t)),9)) AS b, sum(n) AS n, sum(k) AS k, sum(n/(1+exp(-logit/t))) AS p
   FROM x, (SELECT i, ({low}) + i*((({high})-({low}))/98) AS t FROM range(99) r(i)) g GROUP BY 1,2,3),
 {name}_e AS (SELECT i, t, sum(CASE WHEN b<10 THEN abs(k-p) ELSE 0 END)/sum(n) AS e FROM {name}_b GROUP BY 1,2),
 {name} AS (SELECT arg_min(t, struct_pack(e:=e, t:=t)) AS t, min(e) AS e FROM {name}_e)"""


@query("temperature_fit", "WITH " + FLAGS + """,
 x AS (SELECT ln(s/(1-s)) AS logit, n, k FROM (SELECT greatest(1e-6::DOUBLE, least(1-1e-6::DOUBLE, score)) AS s,
        count(*) AS n, sum(pos::INT) AS k FROM flags GROUP BY 1)),""" + _grid("one", "0.1::DOUBLE", "5.0::DOUBLE") + "," + _grid(
    "two", "(SELECT greatest(0.1::DOUBLE, t-4.9::DOUBLE/98) FROM one)", "(SELECT least(5.0::DOUBLE, t+4.9::DOUBLE/98) FROM one)") + ",\n width AS (SELECT (least(5.0::DOUBLE, t+4.9::DOUBLE/98) - greatest(0.1::DOUBLE, t-4.9::DOUBLE/98))/98 AS w FROM one)," + _grid(
    "three", "(SELECT greatest(0.1::DOUBLE, t-w) FROM two, width)", "(SELECT least(5.0::DOUBLE, t+w) FROM two, width)") + """
 SELECT round(t, 6) AS temperature, round(e, 6) AS ece FROM three""")
def _(t):
    fit = m.temperature_fit(t.judged)
    return fit.select(F.round("temperature", 6).alias("temperature"), F.round("ece", 6).alias("ece"))


@query("uncertainty_sweep", "WITH " + FLAGS + f""",
 g AS (SELECT i AS k, (i*2+10)/100 AS threshold FROM range(30) r(i)),
 c AS (SELECT k, threshold, {THRESH} FROM flags, g WHERE disagreement < threshold GROUP BY 1,2),
 s AS (SELECT *, {GUARD}, fp/(fp+tn+1e-8::DOUBLE) AS fpr0 FROM c WHERE tp+fp+fn+tn >= 50),
 o AS (SELECT *, 2*prec*rec/(prec+rec+1e-8::DOUBLE) AS f0 FROM s), p AS (SELECT *, (1-fpr0)*0.6::DOUBLE + f0*0.4::DOUBLE AS ob FROM o)
 SELECT threshold, tp, fp, fn, tn, round(fpr0,9) AS fpr, round(f0,9) AS f1, round(ob,9) AS objective,
   k = (SELECT arg_max(k, struct_pack(o:=ob, k:=-k)) FROM p) AS best FROM p""")
def _(t):
    return m.uncertainty_sweep(t.judged).withColumns({c: F.round(c, 9) for c in ("fpr", "f1", "objective")})


PCT = "round(coalesce(({0})*100.0::DOUBLE/nullif({1},0),0),2)"


@query("flat_accuracy", "WITH " + FLAGS + f""", s AS (SELECT label='real' AS real_, coalesce(done AND decision =
    CASE WHEN pos THEN 'ai' ELSE 'not_ai' END, FALSE) AS ok FROM flags WHERE label IN ('real','ai')),
 c AS (SELECT count(*) AS total, count(*) FILTER (ok) AS correct, count(*) FILTER (real_) AS real_total,
   count(*) FILTER (real_ AND ok) AS real_correct, count(*) FILTER (NOT real_) AS fake_total,
   count(*) FILTER (NOT real_ AND ok) AS fake_correct FROM s),
 d AS (SELECT *, {PCT.format('correct','total')} AS overall_accuracy, {PCT.format('real_correct','real_total')} AS real_accuracy,
   {PCT.format('fake_correct','fake_total')} AS fake_accuracy FROM c)
 SELECT *, round((real_accuracy+fake_accuracy)/2,2) AS acc_g FROM d""")
def _(t):
    from ..functions.rules import completed, is_positive, truthy
    right = truthy(completed(F.col("error"), F.col("decision")) & (
        F.col("decision") == F.when(is_positive(F.col("label")), "ai").otherwise("not_ai")))
    return m.flat_accuracy(t.judged.filter(F.col("label").isin("real", "ai")).select("label", right.alias("correct")))


TRACKS = """t AS (SELECT CASE split WHEN 'development' THEN 'id' WHEN 'calibration' THEN 'ood' ELSE 'wild' END AS track,
   CASE WHEN label='real' THEN 'real' ELSE generator END AS subcat, coalesce(done AND decision =
    CASE WHEN pos THEN 'ai' ELSE 'not_ai' END, FALSE) AS ok FROM flags)"""


@query("track_accuracy", "WITH " + FLAGS + ", " + TRACKS + f""",
 u AS (SELECT 'subcat' AS level, track, subcat, count(*) AS total, count(*) FILTER (ok) AS correct, NULL::DOUBLE AS fake_accuracy FROM t GROUP BY 2,3
  UNION ALL SELECT 'track', track, NULL, count(*), count(*) FILTER (ok),
    {PCT.format("count(*) FILTER (ok AND subcat<>'real')", "count(*) FILTER (subcat<>'real')")} FROM t GROUP BY 2
  UNION ALL SELECT 'overall', NULL, NULL, count(*), count(*) FILTER (ok), NULL FROM t),
 r AS (SELECT {PCT.format("count(*) FILTER (ok)", "count(*)")} AS id_real FROM t WHERE track='id' AND subcat='real')
 SELECT level, track, subcat, total, correct, {PCT.format('correct','total')} AS accuracy, fake_accuracy,
   CASE WHEN level='track' AND track IN ('ood','wild') THEN round((fake_accuracy+id_real)/2,2) END AS acc_g FROM u, r""")
def _(t):
    from ..functions.rules import completed, is_positive, truthy
    right = truthy(completed(F.col("error"), F.col("decision")) & (
        F.col("decision") == F.when(is_positive(F.col("label")), "ai").otherwise("not_ai")))
    rows = t.judged.select(
        F.when(F.col("split") == "development", "id").when(F.col("split") == "calibration", "ood").otherwise("wild").alias("track"),
        F.when(F.col("label") == "real", "real").otherwise(F.col("generator")).alias("subcat"), right.alias("correct"))
    return m.track_accuracy(rows)


@query("score_bands", """SELECT decision, confidence, count(*) AS n, min(s)::INT AS lowest, max(s)::INT AS highest FROM (
  SELECT s, CASE WHEN s>=50 THEN 'ai' ELSE 'not_ai' END AS decision,
   CASE WHEN s>=85 OR s<=15 THEN 'High' WHEN s>=65 OR s<=35 THEN 'Medium' ELSE 'Low' END AS confidence
  FROM (SELECT greatest(1, least(99, floor((n_chars % 1051)/10.0 + 0.5))) AS s FROM {documents})) GROUP BY 1,2""")
def _(t):
    score, decision, confidence = score_band((F.col("n_chars") % 1051) / 10.0)
    return (t.documents.select(score.alias("s")).select("s", *[c.alias(n) for c, n in zip(
        score_band(F.col("s").cast("double"))[1:], ("decision", "confidence"))])
        .groupBy("decision", "confidence").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("lowest"),
                                               F.max("s").alias("highest")))


@query("score_bands_disagreement", """SELECT verdict, confidence, count(*) AS n FROM (SELECT
   CASE WHEN score>0.5 THEN 'ai_generated' ELSE 'real' END AS verdict,
   CASE WHEN disagreement>0.4 THEN 'low' WHEN score>0.85 THEN 'high' WHEN score>0.65 THEN 'medium'
        WHEN score>0.35 THEN 'low' ELSE 'high' END AS confidence FROM {judged}) GROUP BY 1,2""")
def _(t):
    verdict, confidence = disagreement_band(F.col("score"), F.col("disagreement"))
    return t.judged.select(verdict.alias("verdict"), confidence.alias("confidence")).groupBy(
        "verdict", "confidence").agg(F.count(F.lit(1)).alias("n"))
