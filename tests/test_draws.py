"""Packed draws against a loop over every draw."""

import hashlib

import numpy as np
import pytest

from trueframe.operators import bootstrap as b

from test_metrics import brute_auc, lcg, rows, sample


def address(seed, replicate, slot, groups):
    return int(hashlib.md5(f"{seed}:{replicate}:{slot}".encode()).hexdigest()[:15], 16) % groups


def test_addresses_equal_the_hash():
    for low in (0, 95, 10**9 - 3, 10**15 - 4):
        slots = np.arange(low, low + 120)
        for replicate in (0, 9, 10, 12345):
            assert b.addressed(1937303, replicate, slots, 77777).tolist() == [address(1937303, replicate, int(s), 77777) for s in slots]


@pytest.mark.parametrize("method", ["addressed", "lcg"])
def test_many_ranges_blocks_and_a_hot_group(spark, monkeypatch, method):
    for name, value in {"RANGE": 16, "BLOCK": 7, "SLOTS": 12, "SLAB": 3, "ROWS": 20}.items():
        monkeypatch.setattr(b, name, value)
    items = [{**x, "group": "hot" if i % 4 == 0 else f"g{i % 50}"} for i, x in enumerate(sample(240, 9))]
    df = rows(spark, items)
    ordinal = {r.group_id: r.ordinal for r in b.group_vectors(df, {"n": b.F.count(b.F.lit(1))}).collect()}
    n, steps = len(ordinal), lcg(11)
    times = np.zeros((40, n), int)
    for k in range(40):
        for slot in range(n):
            times[k, address(11, k, slot, n) if method == "addressed" else int(next(steps) * n)] += 1
    values = sorted(brute_auc([x for x in items for _ in range(times[k, ordinal[x["group"]]])]) for k in range(40))
    got = b.auroc_bootstrap(df, 40, 11, method=method).first()
    assert (got.valid_replicates, got.low, got.high) == (40, pytest.approx(values[1]), pytest.approx(values[39]))
    vectors = b.group_vectors(df, {"n": b.F.count(b.F.lit(1))})
    size = {r.ordinal: r.n for r in vectors.collect()}
    sums = {r.replicate: r.n for r in b.replicate_sums(vectors, ["n"], 40, 11, method).collect()}
    assert sums == {k: sum(int(times[k, o]) * m for o, m in size.items()) for k in range(40)}


def test_no_draw_is_a_row(spark):
    """2,000 groups by 300 replicates: 600,000 draws in one packed row."""
    packed = b.draws(spark, 2000, 300, 5, "addressed").collect()
    assert len(packed) == 1 and len(packed[0]["seats"]) == 2 * 600_000


def under_broadcasts(df):
    """The lines of the plan that stand under a broadcast."""
    found, above = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if above is not None and depth <= above:
            above = None
        if above is not None:
            found.append(line)
        elif "BroadcastExchange" in line:
            above = depth
    return found


def test_packed_draws_of_auroc_are_not_broadcast(spark):
    df = rows(spark, sample(60, 9))
    cells = df.groupBy("group_id", "score").agg(b.F.lit(1).alias("pos"), b.F.lit(0).alias("neg")).join(
        b.group_vectors(df, {"n": b.F.count(b.F.lit(1))}), "group_id")
    met = under_broadcasts(b.drawn_histograms(cells, 10, 40, 11, "addressed"))
    assert met and not any("MapInPandas" in line for line in met)


def test_packed_draws_of_clusters_are_not_broadcast(spark):
    for replicates in (40, 1200):
        vectors = b.group_vectors(rows(spark, sample(60, 9)), {"n": b.F.count(b.F.lit(1))})
        met = under_broadcasts(b.replicate_sums(vectors, ["n"], replicates, 11, "addressed"))
        assert met and not any("MapInPandas" in line for line in met)
