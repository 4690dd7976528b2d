"""Scans over as many levels of blocks as an order needs."""

import random

import pytest
from pyspark.sql import functions as F

from trueframe.operators import ordered as o
from trueframe.operators import shots as s
from trueframe.operators import timeline as tl


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("fan", [4, 7, 5000])
def test_prefix_sums_by_key(spark, fan):
    rng = random.Random(fan)
    data = [(rng.choice([0, 0, 0, 1, 2]), at, rng.choice([None, *range(-5, 9)])) for at in sorted(rng.sample(range(-300, 2000), 700))]
    df = spark.createDataFrame(data, "k int, at int, v int").repartition(6)
    got = {(r.k, r.at): (r.total, r.n) for r in o.prefix_sums(df, ["k"], F.col("at"), [F.col("at")], {"total": F.col("v"), "n": F.lit(1)}, fan).collect()}
    seen = {}
    for k, at, v in data:
        total, n = seen.get(k, (0, 0))
        seen[k] = total + (v or 0), n + 1
        assert got[k, at] == seen[k]
    assert len(got) == len(data)


def test_prefix_sums_of_nothing_and_of_one(spark):
    df = spark.createDataFrame([(5, 3)], "at int, v int")
    run = lambda d: [r.t for r in o.prefix_sums(d, [], F.col("at"), [F.col("at")], {"t": F.col("v")}, 4).collect()]
    assert run(df) == [3] and run(df.limit(0)) == []


def test_ledgers_use_no_window_over_everything(spark):
    events = spark.range(3000).select(F.col("id").alias("seq"), F.lit("reserve").alias("kind"), F.col("id").alias("sequence"), (F.col("id") % 5 + 1).alias("bytes"))
    out = tl.byte_ledger(events, 5000, block=16)
    assert "SinglePartition" not in plan(out)
    total = 0
    for r in sorted(out.collect(), key=lambda r: r.seq):
        total += r.seq % 5 + 1
        assert (r.reserved, r.problem) == (total, "over_budget" if total > 5000 else None)
    runs = spark.range(900).select((F.col("id") * 1000).alias("run_no"), F.lit(2).alias("reported"), (2 * (F.col("id") + 1)).alias("saved"))
    out = tl.op_ledger(runs, 1000, block=8)
    assert "SinglePartition" not in plan(out)
    assert all(r.observed == r.saved and not r.ledger_mismatch and r.over_cap == (r.saved > 1000) for r in out.collect())


@pytest.mark.parametrize("block", [4, 64, 1 << 20])
def test_entries_of_several_archives(spark, block):
    rng = random.Random(block)
    data = [(a, f"n{i}", at) for a in ("x", "y", "z") for i, at in enumerate(rng.choices(range(5000), k=120 if a != "z" else 1))]
    ends = {"x": 9000, "y": 9500, "z": 9900}
    df = spark.createDataFrame(data, "archive string, name string, local_header_offset long").repartition(5)
    central = F.when(F.col("archive") == "x", 9000).when(F.col("archive") == "y", 9500).otherwise(9900).cast("long")
    out = s.entry_boundary(df, central, block=block, keys=["archive"])
    assert block > 64 or "SinglePartition" not in plan(out)
    got = sorted(map(tuple, out.collect()))
    want = []
    for a in ends:
        own = sorted((at, n) for x, n, at in data if x == a)
        for (at, n), (behind, _) in zip(own, [*own[1:], (ends[a], None)]):
            want.append((a, n, at, behind, behind == at))
    assert got == sorted(want)
