"""Embedding-sequence queries."""

import numpy as np
from pyspark.sql import functions as F

from ..operators import vectors as v
from ..session import settled
from .ranking import rounded
from .registry import query

DIM = 64
E = "e AS (SELECT clip_id, frame_no, embedding::DOUBLE[] AS x, lead(embedding::DOUBLE[]) OVER w AS y, lead(embedding::DOUBLE[], 2) OVER w AS z FROM {vectors} WINDOW w AS (PARTITION BY clip_id ORDER BY frame_no))"


def dist(a, b):
    return f"sqrt(list_sum(list_transform(list_zip({a},{b}), lambda q: (q[2]-q[1])*(q[2]-q[1]))))"


@query("frame_deltas", "WITH " + E + f""" SELECT clip_id, frame_no, round({dist('x','y')},9) AS length, round(y[1]-x[1],9) AS head,
   round(list_sum(list_transform(list_zip(x,y), lambda q: abs(q[2]-q[1]))),9) AS absolute FROM e WHERE y IS NOT NULL
   UNION ALL SELECT clip_id, frame_no, NULL, NULL, 0 FROM e WHERE y IS NULL""")
def _(t):
    a, b = v.as_doubles(F.col("embedding")), v.as_doubles(F.col("next_1"))
    delta = v.minus(b, a)  # null at the last frame of a clip
    total = F.coalesce(F.aggregate(delta, F.lit(0.0), lambda acc, x: acc + F.abs(x)), F.lit(0.0))
    return rounded(v.ahead(t.vectors).select("clip_id", "frame_no", v.norm(delta).alias("length"), delta[0].alias("head"),
                                             total.alias("absolute")), "length", "head", "absolute")


@query("velocity_jerk", "WITH " + E + f""" SELECT clip_id, frame_no, round({dist('x','y')},9) AS speed,
   round(sqrt(list_sum(list_transform(list_zip(x,y,z), lambda q: (q[3]-2*q[2]+q[1])*(q[3]-2*q[2]+q[1])))),9) AS jerk FROM e WHERE y IS NOT NULL""".replace(
    "AS jerk", "* CASE WHEN z IS NULL THEN NULL ELSE 1 END AS jerk"))
def _(t):
    return rounded(v.velocity_jerk(t.vectors).select("clip_id", "frame_no", "speed", "jerk"), "speed", "jerk")


@query("l2_normalize", "WITH " + E + """, n AS (SELECT *, sqrt(list_sum(list_transform(x, lambda q: q*q))) AS r FROM e)
  SELECT clip_id, frame_no, round(x[1]/CASE WHEN r=0 THEN 1 ELSE r END,9) AS head, round(list_sum(x)/CASE WHEN r=0 THEN 1 ELSE r END,9) AS total FROM n""")
def _(t):
    out = v.l2_normalize(t.vectors)
    return rounded(out.select("clip_id", "frame_no", F.col("unit")[0].alias("head"), F.aggregate(
        "unit", F.lit(0.0), lambda a, x: a + x).alias("total")), "head", "total")


@query("second_order_std", "WITH " + E + f""" SELECT clip_id, round(-stddev_samp({dist('y','z')} - {dist('x','y')}),9) AS score, count(*) AS changes
   FROM e WHERE z IS NOT NULL GROUP BY 1""")
def _(t):
    return rounded(v.second_order_std(t.vectors), "score")


@query("one_frame_per_clip", """SELECT clip_id, arg_min(frame_no, sha256('fit-v1:'||clip_id||':'||frame_no)) AS frame_no,
   round(arg_min(embedding[1]::DOUBLE, sha256('fit-v1:'||clip_id||':'||frame_no)),9) AS head FROM {vectors} GROUP BY 1""")
def _(t):
    return rounded(v.one_frame_per_clip(t.vectors).select("clip_id", "frame_no", F.col("embedding")[0].cast("double").alias("head")), "head")


@query("vector_agreement", """WITH p AS (SELECT clip_id, frame_no, embedding::DOUBLE[] AS a, list_transform(embedding::DOUBLE[], lambda q: q + 0.0025::DOUBLE*(frame_no % 3)) AS b FROM {vectors}),
  q AS (SELECT clip_id, frame_no, list_max(list_transform(list_zip(a,b), lambda q: abs(q[1]-q[2]))) AS m, sqrt(list_sum(list_transform(list_zip(a,b), lambda q: (q[1]-q[2])*(q[1]-q[2]))))
     / greatest(sqrt(list_sum(list_transform(a, lambda q: q*q))),1e-12) AS r FROM p)
  SELECT clip_id, frame_no, round(m,9) AS max_abs, round(r,9) AS rel_l2, m<=0.003 AND r<=0.001 AS passed FROM q""")
def _(t):
    a = t.vectors.select("clip_id", "frame_no", v.as_doubles(F.col("embedding")).alias("first"))
    b = t.vectors.select("clip_id", "frame_no", F.transform(
        v.as_doubles(F.col("embedding")), lambda x: x + 0.0025 * (F.col("frame_no") % 3)).alias("second"))
    return rounded(v.vector_agreement(a.join(b, ["clip_id", "frame_no"])).select(
        "clip_id", "frame_no", "max_abs", "rel_l2", "passed"), "max_abs", "rel_l2")


def formula(shift: float, period: int) -> v.Whitening:
    """A whitening given by formula, so that plain SQL can follow it: x_i -> (x_i - shift) (1 + i % period / 8)."""
    gains = 1 + np.arange(DIM) % period / 8
    return v.Whitening(np.full(DIM, shift), np.diag(gains), 1 / gains ** 2)


SPATIAL, TEMPORAL = (0.01, 7), (0.0, 5)


def loglik_sql(vector: str, shift: float, period: int) -> str:
    return (f"(-0.5::DOUBLE*({DIM}*ln(2*pi()) + list_sum(list_transform({vector}::DOUBLE[], "
            f"lambda x, i: ((x-{shift}::DOUBLE)*(1+((i-1)%{period})/8.0::DOUBLE))**2))))")


SCORES = f"""ll AS (SELECT clip_id, max({loglik_sql('embedding', *SPATIAL)}) AS spatial FROM {{vectors}} GROUP BY 1),
  st AS (SELECT clip_id, list_transform(list_zip(embedding::DOUBLE[], (lead(embedding) OVER (PARTITION BY clip_id ORDER BY frame_no))::DOUBLE[]), lambda q: q[2]-q[1]) AS d FROM {{vectors}}),
  un AS (SELECT clip_id, d, sqrt(list_sum(list_transform(d, lambda x: x*x))) AS n FROM st WHERE d[1] IS NOT NULL),
  mv AS (SELECT clip_id, min(CASE WHEN n=0 THEN 'Infinity'::DOUBLE ELSE {loglik_sql('list_transform(d, lambda x: x/n)', *TEMPORAL)} END) AS temporal FROM un GROUP BY 1),
  sc AS (SELECT ll.clip_id, spatial, temporal FROM ll LEFT JOIN mv ON ll.clip_id=mv.clip_id)"""


def scores(t):
    return settled(v.spatial_temporal_agg(t.vectors, formula(*SPATIAL), formula(*TEMPORAL)), "clip-scores")


@query("whitening_fit", """WITH x AS (SELECT unnest(embedding::DOUBLE[]) AS q, generate_subscripts(embedding, 1) AS i, clip_id, frame_no FROM {vectors}),
   c AS (SELECT a.i AS i, var_samp(a.q) AS s FROM x a GROUP BY 1)
   SELECT 64::BIGINT AS kept, round(sum(s),6) AS total_variance FROM c""")
def _(t):
    # eigenvectors have free signs; their count and the eigenvalue sum (the trace) do not
    fit = v.whitening_fit(t.vectors, DIM)
    return t.spark.createDataFrame([(len(fit.eigenvalues), float(fit.eigenvalues.sum()))], "kept long, total_variance double").select(
        "kept", F.round("total_variance", 6).alias("total_variance"))


@query("whitened_loglik", f"SELECT clip_id, frame_no, round({loglik_sql('embedding', *SPATIAL)}, 6) AS loglik FROM {{vectors}}")
def _(t):
    return v.whitened_loglik(t.vectors, formula(*SPATIAL)).select("clip_id", "frame_no", F.round("loglik", 6).alias("loglik"))


@query("spatial_temporal_agg", "WITH " + SCORES + """ SELECT clip_id, round(spatial,6) AS spatial, round(temporal,6) AS temporal,
   CASE WHEN temporal IS NULL THEN 'too_few_frames' END AS problem FROM sc""")
def _(t):
    return rounded(v.spatial_temporal_agg(t.vectors, formula(*SPATIAL), formula(*TEMPORAL)), "spatial", "temporal", digits=6)


RANK = "round((SELECT count(*) FROM ok r WHERE r.clip_id % 2 = 0 AND r.{0} <= j.{0})::DOUBLE / (SELECT count(*) FROM ok WHERE clip_id % 2 = 0), 9)"


@query("percentile_score", "WITH " + SCORES + ", ok AS (SELECT clip_id, round(spatial,6) AS spatial, round(temporal,6) AS temporal FROM sc WHERE temporal IS NOT NULL), pr AS (SELECT clip_id, "
       + RANK.format("spatial") + " AS spatial, " + RANK.format("temporal") + " AS temporal FROM ok j) SELECT *, round(0.5::DOUBLE*(spatial+temporal), 9) AS score FROM pr")
def _(t):
    found = rounded(scores(t), "spatial", "temporal", digits=6)
    return rounded(v.percentile_score(found, found.filter("clip_id % 2 = 0")), "spatial", "temporal", "score")


def demo_head(width: int = DIM, hidden: int = 16) -> dict:
    """A fixed head whose weights follow a formula."""
    wave = lambda *shape: np.sin(np.arange(int(np.prod(shape))) * 0.7).reshape(shape)
    return {"scale": np.ones(width), "shift": np.zeros(width), "w1": wave(width, hidden) / 8, "b1": np.zeros(hidden),
            "w2": wave(hidden) / 4, "b2": np.array(0.05)}


@query("batch_logits")
def _(t):
    return rounded(v.batch_logits(t.vectors, demo_head()), "logit")


@query("feature_splice", """WITH pr AS (SELECT clip_id AS host_id, (clip_id*7+3) % (SELECT count(DISTINCT clip_id) FROM {vectors}) AS donor_id, clip_id % 7 AS start
     FROM (SELECT DISTINCT clip_id FROM {vectors}))
  SELECT host_id, h.frame_no, h.frame_no BETWEEN start AND start+1 AS spliced,
   round(CASE WHEN h.frame_no BETWEEN start AND start+1 THEN d.embedding[1] ELSE h.embedding[1] END::DOUBLE,9) AS head
  FROM pr JOIN {vectors} h ON h.clip_id=host_id LEFT JOIN {vectors} d ON d.clip_id=donor_id AND d.frame_no=h.frame_no""")
def _(t):
    ids = t.vectors.select("clip_id").distinct()
    total = ids.agg(F.count(F.lit(1)).alias("n"))
    pairs = ids.crossJoin(F.broadcast(total)).select(
        F.col("clip_id").alias("host_id"), ((F.col("clip_id") * 7 + 3) % F.col("n")).alias("donor_id"),
        (F.col("clip_id") % 7).alias("start"))
    return rounded(v.feature_splice(t.vectors, t.vectors, pairs).select(
        "host_id", "frame_no", "spliced", F.col("embedding")[0].cast("double").alias("head")), "head")
