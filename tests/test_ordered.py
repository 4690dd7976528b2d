import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trueframe.operators import ordered as o


@pytest.fixture(scope="module")
def data():
    rng = random.Random(11)
    out = []
    for i in range(600):
        key = 0 if rng.random() < 0.5 else rng.randrange(1, 6)  # one key holds half of the rows
        out.append((key, rng.randrange(400), i, rng.randrange(2), rng.randrange(10)))
    return out


@pytest.fixture(scope="module")
def frame(spark, data):
    df = spark.createDataFrame(data, "k int, at int, id int, flag int, v int")
    return df.withColumn("cell", F.floor(F.col("at") / 25)).repartition(5)


def plain(data):
    return pd.DataFrame(data, columns=["k", "at", "id", "flag", "v"]).sort_values(["k", "at", "id"])


def test_rank_and_total(frame, data):
    got = {r.id: (r.rank, r.n) for r in o.row_rank(frame, ["k"], "cell", [F.col("at"), F.col("id")], total="n").collect()}
    df = plain(data)
    df["rank"] = df.groupby("k").cumcount() + 1
    df["n"] = df.groupby("k")["k"].transform("size")
    assert got == {int(i): (int(a), int(b)) for i, a, b in zip(df.id, df["rank"], df.n)}


def test_descending_rank(frame, data):
    down = frame.withColumn("cell", -F.col("cell"))
    got = {r.id: r.rank for r in o.row_rank(down, ["k"], "cell", [F.col("at").desc(), F.col("id").desc()]).collect()}
    df = plain(data)[::-1].copy()
    df["rank"] = df.groupby("k").cumcount() + 1
    assert got == dict(zip(df.id.tolist(), df["rank"].tolist()))


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_sum(frame, data, inclusive):
    got = {r.id: r.s for r in o.running_sums(frame, ["k"], "cell", [F.col("at"), F.col("id")], {"s": F.col("v")}, inclusive=inclusive).collect()}
    df = plain(data)
    s = df.groupby("k")["v"].cumsum()
    assert got == dict(zip(df.id.tolist(), (s if inclusive else s - df.v).tolist()))


def test_adjacent_pairs_cross_cells(frame, data):
    got = {(r.prev.id, r.cur.id) for r in o.adjacent_pairs(frame, ["k"], "cell", ["at", "id"]).collect()}
    want = set()
    for _, part in plain(data).groupby("k"):
        ids = part.id.tolist()
        want |= set(zip(ids, ids[1:]))
    assert got == want


@pytest.mark.parametrize("wide", [False, True])
def test_islands(frame, data, wide):
    link = (lambda a, b: b["at"] - a["at"] <= 3) if not wide else (lambda a, b: F.lit(True))
    df = frame if not wide else frame.withColumn("flag", F.when(F.col("k") == 0, 1).otherwise(F.col("flag")))
    got = sorted((r.k, r.n, r.first.id, r.last.id, r.top, tuple(x.id for x in r.firsts)) for r in o.islands(
        df, ["k"], "cell", ["at", "id"], F.col("flag") == 1, link, totals={"top": (F.col("v"), "max")}, keep_first=3).collect())
    want = []
    for k, part in plain(data).groupby("k"):
        run = []

        def close():
            if run:
                want.append((k, len(run), run[0][1], run[-1][1], max(x[2] for x in run), tuple(x[1] for x in run[:3])))
            run.clear()

        for at, i, flag, v in zip(part["at"], part.id, part.flag, part.v):
            flag = 1 if wide and k == 0 else flag
            if flag != 1:
                close()
                continue
            if run and not wide and at - run[-1][0] > 3:
                close()
            run.append((at, i, v))
        close()
    assert got == sorted(want)


def test_as_of(frame, data):
    got = {r.id: r.hit for r in o.as_of(frame, ["k"], "cell", ["at", "id"], F.when(F.col("flag") == 1, F.col("v")), "hit").collect()}
    want = {}
    for _, part in plain(data).groupby("k"):
        last = None
        for i, flag, v in zip(part.id, part.flag, part.v):
            last = v if flag == 1 else last
            want[i] = last
    assert got == want


def test_only_large_keys_are_split(spark, frame):
    split = o.split_hot(frame.drop("cell"), ["k"], F.floor(F.col("at") / 25), "cell", rows_per_task=200)
    got = {r.k: r.n for r in split.groupBy("k").agg(F.count_distinct("cell").alias("n")).collect()}
    assert got[0] > 5 and all(n == 1 for k, n in got.items() if k)
    assert o.split_hot(frame.drop("cell"), ["k"], F.col("at"), "cell").select("cell").distinct().count() == 1


def test_null_key_stops_the_job(spark):
    df = spark.createDataFrame([(None, 1, 0), (1, 2, 0)], "k int, at int, cell int")
    with pytest.raises(Exception, match="null ordering key"):
        o.row_rank(df, ["k"], "cell", [F.col("at")]).collect()


def test_score_bands_keep_order_and_spread_piled_scores(spark):
    rng = np.random.default_rng(4)
    piled = np.concatenate([1 - 0.001 * rng.random(9000), rng.random(500), 1e-5 * rng.random(480), [0.0, -0.0, 0.5, 1.0, 1e-320, 2.5, -0.3, -7.0, 1 - 2**-53, 30.0]])
    df = spark.createDataFrame([(float(x),) for x in piled], "score double").select("score", o.score_bucket(F.col("score")).alias("band"))
    got = sorted((r.score, r.band) for r in df.collect())
    bands = [band for _, band in got]
    assert bands == sorted(bands) and None not in bands
    assert max(np.unique(bands, return_counts=True)[1]) < 0.01 * len(piled)


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_quantiles_equal_sorting(spark, keys):
    from trueframe.operators.comparison import quantiles
    rng = np.random.default_rng(5)
    rows = [(None if i % 5 == 0 else f"g{i % 3}", None if i % 7 == 0 else float(rng.integers(0, 30))) for i in range(200)] + [("none", None)]
    got = {r["g"] if keys else 0: r for r in quantiles(spark.createDataFrame(rows, "g string, v double"), "v", keys).collect()}
    for key in got:
        v = sorted(x for g, x in rows if x is not None and (not keys or g == key))
        r = got[key]
        assert r.measured == len(v)
        if v:
            assert (r.median, r.p95, r.max) == (pytest.approx(np.quantile(v, .5)), pytest.approx(np.quantile(v, .95)), v[-1])
            assert r.p95_nearest == v[int(np.ceil(.95 * len(v))) - 1]
    assert len(got) == (len({g for g, _ in rows}) if keys else 1)
