import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from trueframe.operators import timeline as tl

ORDER = ["index"]


def samples(spark, items, case=1):
    data = [(case, i, None if p is None else Decimal(str(p)), None if s is None else float(s)) for i, (p, s) in enumerate(items)]
    df = spark.createDataFrame(data, "case_id int, index long, position decimal(18,9), score double")
    return tl.sample_validity(df, F.lit(60)).withColumn("cell", F.floor(F.col("index") / 2))


def runs(spark, items):
    got = tl.persistent_runs(samples(spark, items), ORDER, "cell").collect()
    return sorted((r.first_index, r.n, r.kind) for r in got)


@pytest.mark.parametrize("items, want", [
    ([(0, .5), (.5, .5)], [(0, 2, "persistent")]),  # exactly the threshold
    ([(0, .49), (.5, .9)], [(1, 1, "isolated")]),
    ([(0.1, .9), (0.7, .9)], [(0, 2, "persistent")]),  # a gap of exactly .6 in decimals
    ([(0.1, .9), (0.700000001, .9)], [(0, 1, "isolated"), (1, 1, "isolated")]),
    ([(1, .9), (1, .9)], [(0, 1, "isolated"), (1, 1, "isolated")]),  # no step
    ([(1, .9), (.6, .9)], [(0, 1, "isolated"), (1, 1, "isolated")]),  # reversed, never sorted
    ([(0, .9), (.3, None), (.5, .9)], [(0, 1, "isolated"), (2, 1, "isolated")]),  # invalid middle breaks
    ([(0, .9), (.3, .1), (.5, .9)], [(0, 1, "isolated"), (2, 1, "isolated")]),
    ([(0, .9), (.5, .9), (1, .9), (1.5, .9), (2, .9)], [(0, 5, "persistent")]),  # spans cells
    ([], []),
])
def test_run_rules(spark, items, want):
    assert runs(spark, items) == want


def test_invalid_samples_are_not_negative(spark):
    got = samples(spark, [(0, 1.5), (70, .9), (1, .2), (-1, .9)]).orderBy("index").collect()
    assert [r.valid for r in got] == [False, False, True, False]
    assert [r.positive for r in got] == [None, None, False, None]
    assert got[1].issues == ["position_not_in_media"]


def issues(spark, items, duration=2.0):
    cases = spark.createDataFrame([(1, duration)], "case_id int, duration double")
    return sorted(r.issue for r in tl.coverage_issues(samples(spark, items), cases, ORDER, "cell").collect())


def test_coverage_rules(spark):
    grid = [(i / 2, .1) for i in range(4)]
    assert issues(spark, grid) == []
    assert issues(spark, []) == ["no_samples"]
    assert issues(spark, [(.2, .1)] + grid[1:]) == ["initial_coverage_gap"]
    assert issues(spark, grid[:2]) == ["terminal_coverage_gap"]
    assert issues(spark, [grid[0], grid[2], grid[3]]) == ["coverage_gap"]
    assert issues(spark, [grid[0], grid[1], grid[1], grid[2], grid[3]]) == ["positions_not_increasing"]


def verdict(spark, items):
    s = samples(spark, items)
    cases = spark.createDataFrame([(1, 2.0)], "case_id int, duration double")
    return tl.temporal_verdict(cases, tl.coverage_issues(s, cases, ORDER, "cell"), tl.persistent_runs(s, ORDER, "cell")).first()


def test_verdicts(spark):
    grid = lambda *s: [(i / 2, x) for i, x in enumerate(s)]
    assert verdict(spark, grid(.1, .1, .1, .1)).verdict == "no_clear_indicators"
    assert verdict(spark, grid(.9, .9, .1, .1)).verdict == "persistent_ai_indicators"
    alone = verdict(spark, grid(.9, .1, .1, .1))
    assert (alone.verdict, alone.review_required) == ("inconclusive", True)
    both = verdict(spark, grid(.9, .9, .1, .9))
    assert (both.verdict, both.review_required) == ("persistent_ai_indicators", True)
    assert verdict(spark, grid(.9, .9, .1)).verdict == "inconclusive"  # incomplete decides nothing


def test_error_streak_stops_once(spark):
    errors = ["a", "a", None, "a", "a", "a", "a", "b"]
    df = spark.createDataFrame([(1, i, e) for i, e in enumerate(errors)] + [(2, 0, "a"), (2, 1, "b"), (2, 2, "a")],
                               "case_id int, index long, error string").withColumn("cell", F.floor(F.col("index") / 2))
    got = tl.error_streak(df, ORDER, "cell").collect()
    assert [(r.case_id, r.stop_index, r.error, r.not_started) for r in got] == [(1, 5, "a", 2)]


def test_error_streak_counts_tied_rows_by_place(spark):
    rows = [(1, 0, None)] + [(1, 1, "a")] * 5 + [(1, 2, "a"), (1, 3, None), (2, 0, "b"), (2, 0, "b"), (2, 1, "b"), (2, 1, "b")]
    df = spark.createDataFrame(rows, "case_id int, index long, error string").withColumn("cell", F.floor(F.col("index") / 2))
    got = {r.case_id: (r.stop_index, r.error, r.not_started) for r in tl.error_streak(df, ORDER, "cell").collect()}
    assert got == {1: (1, "a", 4), 2: (1, "b", 1)}


def test_ledger_marks_gap_and_budget(spark):
    df = spark.createDataFrame([(0, "reserve", 0, 40), (1, "received", 1, 40), (2, "reserve", 3, 70)], "seq long, kind string, sequence long, bytes long")
    assert [r.problem for r in tl.byte_ledger(df, 1000, block=2).orderBy("seq").collect()] == [None, None, "sequence_gap"]
    assert [r.problem for r in tl.byte_ledger(df.withColumn("sequence", F.col("seq")), 100, block=2).orderBy("seq").collect()] == [None, None, "over_budget"]


def test_random_runs_against_plain_loop(spark):
    rng = random.Random(4)
    items, at = [], 0.0
    for _ in range(200):
        at = round(at + rng.choice([.2, .5, .6, .7, 0]), 3)
        items.append((min(at, 59.9), rng.choice([.9, .8, .1, None])))
    want, run = [], []
    for i, (p, s) in enumerate(items):
        ok = s is not None and s >= .5
        if run and not (ok and 0 < Decimal(str(p)) - Decimal(str(items[run[-1]][0])) <= Decimal("0.6")):
            want.append((run[0], len(run), "persistent" if len(run) > 1 else "isolated"))
            run = []
        if ok:
            run.append(i)
    if run:
        want.append((run[0], len(run), "persistent" if len(run) > 1 else "isolated"))
    assert runs(spark, items) == sorted(want)
