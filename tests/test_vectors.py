import numpy as np
import pytest
from pyspark.sql import functions as F

from trueframe.operators import vectors as v
from trueframe.plans.vectors import demo_head

D = 6


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12, 9, D)) @ rng.normal(size=(D, D))
    x[3, 4] = x[3, 3]  # a still step
    return x


@pytest.fixture(scope="module")
def frames(spark, data):
    rows = [(i, t, data[i, t].tolist()) for i in range(len(data)) for t in range(data.shape[1])]
    return spark.createDataFrame(rows, "clip_id int, frame_no int, embedding array<double>").repartition(5)


@pytest.mark.parametrize("block", [1024, 4])
def test_differences_cross_blocks(frames, data, block, monkeypatch):
    monkeypatch.setattr(v, "BLOCK", block)
    got = {(r.clip_id, r.frame_no): (r.velocity, r.jerk) for r in v.velocity_jerk(frames).collect()}
    vel = np.diff(data, axis=1)
    acc = np.diff(vel, axis=1)
    assert len(got) == vel.shape[0] * vel.shape[1]
    for (i, t), (velocity, jerk) in got.items():
        assert np.allclose(velocity, vel[i, t])
        assert jerk is None if t == acc.shape[1] else jerk == pytest.approx(np.linalg.norm(acc[i, t]))


def test_second_order_std(frames, data):
    got = {r.clip_id: r.score for r in v.second_order_std(frames).collect()}
    dist = np.linalg.norm(np.diff(data, axis=1), axis=-1)
    want = -np.diff(dist, axis=1).std(axis=1, ddof=1)
    assert np.allclose([got[i] for i in range(len(data))], want)


def plain_fit(x):
    mean = x.mean(0)
    values, basis = np.linalg.eigh(np.cov((x - mean).T))
    keep = values > 0
    return mean, basis[:, keep] / np.sqrt(values[keep] + 1e-5)


def plain_ll(x, fit):
    w = (x - fit[0]) @ fit[1]
    return -0.5 * (w.shape[-1] * np.log(2 * np.pi) + (w ** 2).sum(-1))


def test_whitening_and_likelihood(frames, data):
    fit = v.whitening_fit(frames, D)
    want = plain_ll(data, plain_fit(data.reshape(-1, D)))
    got = {(r.clip_id, r.frame_no): r.loglik for r in v.whitened_loglik(frames, fit).collect()}
    assert np.allclose([got[i, t] for i in range(12) for t in range(9)], want.ravel())


def test_scores_of_clips(frames, data):
    spatial, temporal = v.whitening_fit(frames, D), v.whitening_fit(v.unit_deltas(frames), D, "unit")
    steps = np.diff(data, axis=1)
    size = np.linalg.norm(steps, axis=-1, keepdims=True)
    unit = steps / np.where(size == 0, 1, size)
    ll = plain_ll(unit, plain_fit(unit.reshape(-1, D)))
    ll[size[..., 0] == 0] = np.inf
    a = plain_ll(data, plain_fit(data.reshape(-1, D))).max(1)
    b = ll.min(1)
    scores = v.spatial_temporal_agg(frames, spatial, temporal)
    got = {r.clip_id: (r.spatial, r.temporal) for r in scores.collect()}
    assert np.allclose([got[i] for i in range(12)], np.stack([a, b], 1))
    pct = {r.clip_id: r.score for r in v.percentile_score(scores, scores.filter("clip_id < 8")).collect()}
    rank = lambda x: np.searchsorted(np.sort(x[:8]), x, side="right") / 8
    assert np.allclose([pct[i] for i in range(12)], 0.5 * (rank(a) + rank(b)))


def test_fixed_head(spark, frames, data):
    from math import erf
    head = demo_head(D, 4)
    x = data
    n = (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5)
    h = n @ head["w1"]
    g = h * 0.5 * (1 + np.vectorize(erf)(h / 2 ** .5))
    want = (g @ head["w2"] + head["b2"]).max(1)
    got = {r.clip_id: r.logit for r in v.batch_logits(frames, head).collect()}
    assert np.allclose([got[i] for i in range(12)], want)
    bad = frames.withColumn("embedding", F.when((F.col("clip_id") == 2) & (F.col("frame_no") == 0), F.array(*[F.lit(float("nan"))] * D)).otherwise(F.col("embedding")))
    assert {r.clip_id for r in v.batch_logits(bad, head).filter("logit is null").collect()} == {2}


def test_frame_mean_needs_every_frame(spark):
    df = spark.createDataFrame([(1, 1.0)] * 8 + [(2, 1.0)] * 7 + [(3, 0.0)] * 8 + [(4, 1.0)] * 8 + [(4, float("nan"))], "clip_id int, logit double")
    got = {r.clip_id: (r.score, r.decision) for r in v.frame_mean_score(df).collect()}
    assert got == {1: (1.0, "ai"), 2: (None, "error"), 3: (0.0, "not_ai"), 4: (1.0, "ai")}


def test_unit_vectors_and_agreement(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "embedding array<double>")
    assert [r.unit for r in v.l2_normalize(df).collect()] == [[.6, .8], [0, 0]]
    pairs = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0005]), ([1.0, 2.0], [1.0, 2.004])], "first array<double>, second array<double>")
    assert [r.passed for r in v.vector_agreement(pairs).collect()] == [True, False]
