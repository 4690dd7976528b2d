"""AUROC, thresholds and bootstrap queries."""

from pyspark.sql import functions as F

from ..operators import bootstrap, ranking
from .metrics import FLAGS
from .registry import query


def rounded(df, *names, digits=9):
    return df.withColumns({n: F.round(n, digits) for n in names})


AREA = """area AS (SELECT {keys} sum(pos*(2*below+neg))::DOUBLE/nullif(2.0*sum(pos)*sum(neg),0) AS auroc,
   sum(pos)::BIGINT AS positives, sum(neg)::BIGINT AS negatives
   FROM (SELECT *, coalesce(sum(neg) OVER ({part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS below FROM cnt) {group})"""


def area(keys: str = "") -> str:
    return (AREA.replace("{keys}", keys + "," if keys else "").replace("{part}", f"PARTITION BY {keys}" if keys else "")
            .replace("{group}", f"GROUP BY {keys}" if keys else ""))


CNT = "cnt AS (SELECT score, count(*) FILTER (pos) AS pos, count(*) FILTER (NOT pos) AS neg FROM flags GROUP BY 1)"


@query("auroc", "WITH " + FLAGS + ", " + CNT + ", " + area() + " SELECT positives, negatives, round(auroc,9) AS auroc FROM area")
def _(t):
    return rounded(ranking.auroc(t.judged), "auroc")


@query("ap_and_class_acc", "WITH " + FLAGS + ", " + CNT + ", " + area() + """,
 ap AS (SELECT sum(pos*tp::DOUBLE/(tp+fp))/sum(pos) AS ap FROM (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp,
    sum(neg) OVER (ORDER BY score DESC) AS fp FROM cnt)),
 acc AS (SELECT count(*) FILTER (NOT pos AND score<=0.5)::DOUBLE/nullif(count(*) FILTER (NOT pos),0) AS real_acc,
   count(*) FILTER (pos AND score>0.5)::DOUBLE/nullif(count(*) FILTER (pos),0) AS fake_acc,
   count(*) FILTER (pos = (score>0.5))::DOUBLE/count(*) AS acc FROM flags)
 SELECT round(ap,9) AS ap, round(auroc,9) AS auroc, round(real_acc,9) AS real_acc, round(fake_acc,9) AS fake_acc, round(acc,9) AS acc FROM ap, area, acc""")
def _(t):
    one = ranking.average_precision(t.judged).crossJoin(ranking.auroc(t.judged).select("auroc")).crossJoin(
        ranking.class_accuracy(t.judged))
    return rounded(one, *one.columns)


@query("threshold_at_fpr", "WITH " + FLAGS + """, dev AS (SELECT * FROM flags WHERE split='development'),
 negs AS (SELECT score, row_number() OVER (ORDER BY score DESC) - 1 AS i, count(*) OVER () AS n FROM dev WHERE NOT pos),
 th AS (SELECT target, score AS threshold, n FROM negs, (VALUES (0.0::DOUBLE),(0.05::DOUBLE),(0.1::DOUBLE)) v(target) WHERE i = floor(target*n))
 SELECT target, threshold, any_value(n)::BIGINT AS negatives, count(*) FILTER (pos) AS positives,
   count(*) FILTER (NOT pos AND score>threshold) AS false_positives, count(*) FILTER (pos AND score>threshold) AS true_positives,
   round(count(*) FILTER (pos AND score>threshold)::DOUBLE/nullif(count(*) FILTER (pos),0),9) AS recall
 FROM dev, th GROUP BY 1,2""")
def _(t):
    return rounded(ranking.threshold_at_fpr(t.judged, [0.0, 0.05, 0.1]), "recall")


@query("per_generator_auc_ap", "WITH " + FLAGS + """, gens AS (SELECT DISTINCT generator FROM flags WHERE pos),
 long AS (SELECT generator, -score AS score, 1 AS p, 0 AS n FROM flags WHERE pos UNION ALL
   SELECT g.generator, -f.score, 0, 1 FROM flags f, gens g WHERE f.label='real'),
 cnt AS (SELECT generator, score, sum(p) AS pos, sum(n) AS neg FROM long GROUP BY 1,2), """ + area("generator") + """,
 ap AS (SELECT generator, sum(pos*tp::DOUBLE/(tp+fp))/sum(pos) AS ap FROM (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp
    FROM cnt WINDOW w AS (PARTITION BY generator ORDER BY score DESC)) GROUP BY 1)
 SELECT generator, positives, negatives, round(auroc,9) AS auroc, round(ap,9) AS ap FROM area JOIN ap USING (generator)""")
def _(t):
    return rounded(ranking.per_generator(t.judged), "auroc", "ap")


@query("source_auc_fpr", "WITH " + FLAGS + """,
 long AS (SELECT generator, pos, 'score' AS branch, score FROM flags UNION ALL SELECT generator, pos, 'disagreement', disagreement FROM flags),
 cnt AS (SELECT generator, branch, score, count(*) FILTER (pos) AS pos, count(*) FILTER (NOT pos) AS neg FROM long GROUP BY 1,2,3), """
       + area("generator, branch") + """
 SELECT generator, branch, n, round(auroc,9) AS auroc, CASE WHEN positives=0 THEN round(alarms::DOUBLE/n,9) END AS fpr
 FROM area JOIN (SELECT generator, branch, count(*) AS n, count(*) FILTER (score>=0.5) AS alarms FROM long GROUP BY 1,2) USING (generator, branch)""")
def _(t):
    return rounded(ranking.source_auc_fpr(t.judged, ["score", "disagreement"]), "auroc", "fpr")


@query("calibration_rank", """SELECT id, score, round((SELECT count(*) FROM {rejudged} r WHERE r.score <= j.score)::DOUBLE
   / (SELECT count(*) FROM {rejudged}), 9) AS percentile FROM {judged} j""")
def _(t):
    return rounded(ranking.calibration_rank(t.judged.select("id", "score"), t.rejudged), "percentile")


ORDINALS = """ord AS (SELECT *, row_number() OVER (ORDER BY md5(group_id), group_id) - 1 AS o, count(*) OVER () AS g FROM vec),
 drawn AS (SELECT r, ('0x' || substr(md5('{seed}:' || r || ':' || s.o), 1, 15))::BIGINT % s.g AS o, count(*) AS m
   FROM ord s, range({reps}) x(r) GROUP BY 1,2)"""


def ordinals(seed: int, reps: int) -> str:
    return ORDINALS.replace("{seed}", str(seed)).replace("{reps}", str(reps))


RATE_PAIRS = {
    "ai_recall": ("tp", "p"), "false_positive_rate": ("fp", "n"), "ai_detection_failure_rate": ("p-tp", "p"),
    "false_negative_rate": ("fn", "p"), "false_negative_contamination": ("fn", "fn+tn"), "ai_precision": ("tp", "tp+fp"),
    "abstention_rate": ("ab", "c"), "coverage": ("c-ab", "c"), "committed_accuracy": ("tp+tn", "tp+tn+fp+fn"),
    "high_confidence_error_rate": ("hw", "h"), "completion_rate": ("c", "a")}


@query("cluster_bootstrap", "WITH " + FLAGS + """,
 vec AS (SELECT group_id, count(*) AS a, count(*) FILTER (done) AS c, count(*) FILTER (done AND pos) AS p,
  count(*) FILTER (done AND NOT pos) AS n, count(*) FILTER (done AND pos AND decision='ai') AS tp,
  count(*) FILTER (done AND pos AND decision='not_ai') AS fn, count(*) FILTER (done AND NOT pos AND decision='ai') AS fp,
  count(*) FILTER (done AND NOT pos AND decision='not_ai') AS tn, count(*) FILTER (done AND decision='abstain') AS ab,
  count(*) FILTER (done AND decision<>'abstain' AND confidence='High') AS h,
  count(*) FILTER (done AND confidence='High' AND ((pos AND decision='not_ai') OR (NOT pos AND decision='ai'))) AS hw
  FROM flags GROUP BY 1), """ + ordinals(5149304, 1000) + """,
 rep AS (SELECT r, """ + ", ".join(f"sum({c}*m)::DOUBLE AS {c}" for c in "a c p n tp fn fp tn ab h hw".split()) + """ FROM drawn JOIN ord USING (o) GROUP BY 1),
 est AS (""" + " UNION ALL ".join(
    f"SELECT '{k}' AS rate, r, ({a})/nullif({b},0) AS e FROM rep" for k, (a, b) in RATE_PAIRS.items()) + """),
 s AS (SELECT rate, list(e ORDER BY e) AS v FROM est WHERE e IS NOT NULL GROUP BY 1)
 SELECT rate, len(v)::BIGINT AS valid_replicates, round(v[floor(len(v)*0.025)::INT+1],9) AS low,
   round(v[least(len(v)-1, floor(len(v)*0.975))::INT+1],9) AS high FROM s""")
def _(t):
    return rounded(bootstrap.cluster_bootstrap(t.judged, method="addressed"), "low", "high")


@query("auroc_bootstrap", "WITH " + FLAGS + """, vec AS (SELECT group_id FROM flags GROUP BY 1), """ + ordinals(1937303, 1000) + """,
 cells AS (SELECT o, score, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM flags JOIN ord USING (group_id) GROUP BY 1,2),
 cnt AS (SELECT r, score, sum(p*m) AS pos, sum(n*m) AS neg FROM drawn JOIN cells USING (o) GROUP BY 1,2), """ + area("r") + """,
 s AS (SELECT list(auroc ORDER BY auroc) AS v FROM area WHERE auroc IS NOT NULL)
 SELECT len(v)::BIGINT AS valid_replicates, round(v[floor(len(v)*0.025)::INT+1],9) AS low,
   round(v[least(len(v)-1, floor(len(v)*0.975))::INT+1],9) AS high FROM s""")
def _(t):
    return rounded(bootstrap.auroc_bootstrap(t.judged, method="addressed"), "low", "high")


@query("bootstrap_totals", "SELECT r AS replicate, (SELECT count(DISTINCT group_id) FROM {judged})::DOUBLE AS draws FROM range(1000) x(r)")
def _(t):
    vectors = bootstrap.group_vectors(t.judged, {"draws": F.first(F.lit(1))})
    return bootstrap.replicate_sums(vectors, ["draws"], 1000, 5149304)


@query("cluster_bootstrap_split")
def _(t):
    return rounded(bootstrap.cluster_bootstrap(t.judged), "low", "high")


@query("auroc_bootstrap_split")
def _(t):
    return rounded(bootstrap.auroc_bootstrap(t.judged), "low", "high")
