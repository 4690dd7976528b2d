import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trueframe.operators import bootstrap as b
from trueframe.operators import comparison as c
from trueframe.operators import metrics as m
from trueframe.operators import ranking as r

SCHEMA = "id string, group_id string, label string, decision string, confidence string, error string, score double, split string"


def rows(spark, items):
    return spark.createDataFrame([(str(i), x.get("group", str(i)), x["label"], x.get("decision"), x.get("confidence"), x.get("error"),
                                   x.get("score"), x.get("split", "development")) for i, x in enumerate(items)], SCHEMA)


def rates(spark, items):
    return {x.rate: x for x in m.rates(m.confusion(rows(spark, items))).collect()}


def test_abstaining_everywhere_is_no_success(spark):
    got = rates(spark, [{"label": "ai", "decision": "abstain"}, {"label": "real", "decision": "abstain"}])
    assert got["ai_recall"].estimate == 0 and got["coverage"].estimate == 0
    assert got["ai_precision"].estimate is None and got["ai_precision"].low is None
    assert got["false_positive_rate"].estimate == 0


def test_errors_leave_class_rates_and_stay_in_completion(spark):
    got = rates(spark, [{"label": "ai", "decision": "not_ai", "confidence": "High"}, {"label": "real", "decision": "not_ai", "confidence": "High"},
                        {"label": "mixed", "decision": "ai", "confidence": "Low"}, {"label": "real", "error": "timeout"}])
    assert got["false_negative_contamination"].estimate == 0.5
    assert got["completion_rate"].estimate == 0.75
    assert got["high_confidence_error_rate"].estimate == 0.5
    assert got["ai_recall"].estimate == 0.5


def sample(n=60, seed=3):
    rng = random.Random(seed)
    return [{"label": rng.choice(["ai", "real", "mixed", "cgi"]), "decision": rng.choice(["ai", "not_ai", "abstain"]),
             "group": f"g{rng.randrange(20)}", "score": rng.randrange(12) / 12, "confidence": rng.choice(["High", "Low"])} for _ in range(n)]


def test_bootstrap_is_reproducible_on_any_partitioning(spark):
    df = rows(spark, sample())
    one = sorted(map(tuple, b.cluster_bootstrap(df, 50).collect()))
    assert one == sorted(map(tuple, b.cluster_bootstrap(df.repartition(7, "id"), 50).collect()))


def lcg(seed):
    state = seed
    while True:
        state = (1664525 * state + 1013904223) % 2**32
        yield state / 2**32


def test_closed_form_sequence_equals_stepping():
    gen = lcg(5149304)
    steps = np.array([next(gen) for _ in range(500)])
    assert (b.lcg_states(np.arange(1, 501), 5149304) / 2**32 == steps).all()
    far = 10**9
    assert b.lcg_states(np.array([far + 1]), 7)[0] == (1664525 * int(b.lcg_states(np.array([far]), 7)[0]) + 1013904223) % 2**32


def test_published_draw_order_against_plain_loop(spark):
    items = sample()
    df = rows(spark, items).withColumn("n", F.col("id").cast("long"))
    got = {x.rate: x for x in b.cluster_bootstrap(df, 200, method="lcg", first_seen=F.col("n")).collect()}
    groups = {}
    for x in items:
        groups.setdefault(x["group"], []).append(x)
    units, gen, values = list(groups.values()), lcg(5149304), []
    for _ in range(200):
        drawn = [x for _ in range(len(units)) for x in units[int(next(gen) * len(units))]]
        pos = [x for x in drawn if x["label"] in ("ai", "mixed")]
        if pos:
            values.append(sum(x["decision"] == "ai" for x in pos) / len(pos))
    values.sort()
    assert got["ai_recall"].low == pytest.approx(values[int(len(values) * .025)])
    assert got["ai_recall"].high == pytest.approx(values[min(len(values) - 1, int(len(values) * .975))])


def test_one_group_gives_null_intervals(spark):
    df = rows(spark, [{**x, "group": "only"} for x in sample()])
    got = b.cluster_bootstrap(df, 50).collect()
    assert {x.rate for x in got} == set(b.RATES) and all(x.low is None and x.high is None and x.valid_replicates == 0 for x in got)
    assert b.auroc_bootstrap(df, 50).first().low is None


def test_method_is_the_callers_alone(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("another method was chosen")
    monkeypatch.setattr(b, "_multinomial", refuse)
    many = [{**x, "group": f"g{i}"} for i, x in enumerate(sample(400, 5))]
    assert b.cluster_bootstrap(rows(spark, many), 50).count() == len(b.RATES)


def test_multinomial_draws_agree_in_distribution(spark):
    df = rows(spark, sample(400, 5))
    a = {x.rate: x for x in b.cluster_bootstrap(df, 600).collect()}
    z = {x.rate: x for x in b.cluster_bootstrap(df, 600, method="multinomial").collect()}
    for rate in ("ai_recall", "coverage", "ai_precision"):
        assert z[rate].low == pytest.approx(a[rate].low, abs=0.03) and z[rate].high == pytest.approx(a[rate].high, abs=0.03)


def brute_auc(items):
    pos = [x["score"] for x in items if x["label"] in ("ai", "mixed")]
    neg = [x["score"] for x in items if x["label"] not in ("ai", "mixed")]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_auroc_with_ties(spark, seed):
    items = sample(80, seed)
    for x in items:
        x["score"] = x["score"] * 40 - 20  # logits, many ties
    assert r.auroc(rows(spark, items)).first().auroc == pytest.approx(brute_auc(items))


def test_auroc_needs_both_classes(spark):
    assert r.auroc(rows(spark, [{"label": "ai", "score": 0.3}])).first().auroc is None


def test_threshold_is_fourth_largest_of_sixty_four(spark):
    items = [{"label": "real", "score": i / 100} for i in range(64)] + [{"label": "ai", "score": 0.99}]
    row = r.threshold_at_fpr(rows(spark, items), [0.05]).first()
    assert (row.threshold, row.false_positives, row.true_positives) == (0.6, 3, 1)


def test_pairs_and_missing_attempts(spark):
    manifest = spark.createDataFrame([("a", "h1"), ("b", "h2")], "id string, sha256 string")
    run = spark.createDataFrame([("a", "h1", "ai", "High", None, 1.0)], "id string, sha256 string, decision string, confidence string, error string, elapsed_ms double")
    filled = {x.id: x for x in c.fill_not_attempted(run, manifest).collect()}
    assert filled["b"].error == "not_attempted" and filled["a"].error is None
    other = run.withColumn("sha256", F.lit("zz"))
    assert c.truth_mismatches(other, manifest).first().problem == "hash_mismatch"


def test_ece_leaves_one_out_of_every_bin(spark):
    df = rows(spark, [{"label": "ai", "score": 1.0}, {"label": "real", "score": 0.25}])
    assert m.ece(df).first().ece == pytest.approx(0.125)
