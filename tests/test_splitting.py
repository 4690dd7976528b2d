"""Bootstrap by splitting counts down a tree of cells."""

import random

import numpy as np
import pytest

from test_metrics import brute_auc, rows, sample
from trueframe.operators import bootstrap as b
from trueframe.operators import splitting


def drawn(tree):
    out = np.zeros((tree.replicates, tree.groups), np.int64)
    for cell in range(tree.cells):
        for first, times in tree.multiplicities(cell):
            out[first:first + len(times), cell * tree.cell:cell * tree.cell + times.shape[1]] = times
    return out


def test_multiplicities_are_draws_with_replacement():
    groups, replicates = 203, 3000
    times = drawn(splitting.CountTree(groups, replicates, 7, cell=10))
    assert (times.sum(1) == groups).all()
    # a group's multiplicity is binomial(n, 1/n): mean 1, variance 1 - 1/n; two groups lean against each other by -1/n
    assert np.abs(times.mean(0) - 1).max() < 5 / np.sqrt(replicates)
    assert times.var(0).mean() == pytest.approx(1 - 1 / groups, abs=0.01)
    joint = np.cov(times.T)
    off = joint[~np.eye(groups, dtype=bool)]
    assert off.mean() == pytest.approx(-1 / groups, abs=2e-4)
    # across the root's split as well as inside a cell
    for a, z in ((times[:, :100].sum(1), times[:, 100:].sum(1)), (times[:, 0:5].sum(1), times[:, 5:10].sum(1))):
        n = a.mean() + z.mean()
        assert a.var() == pytest.approx(groups * (a.mean() / groups) * (1 - a.mean() / groups), rel=0.12) and n > 0
    # first moments of the whole distribution of one multiplicity
    share = np.bincount(times.ravel(), minlength=5)[:5] / times.size
    assert share == pytest.approx([0.3669, 0.3688, 0.1844, 0.0612, 0.0152], abs=0.003)


def test_any_order_of_cells_gives_the_same_counts():
    one = splitting.CountTree(1000, 40, 3, cell=7)
    other = splitting.CountTree(1000, 40, 3, cell=7)
    want = {c: one.counts(c) for c in range(one.cells)}
    order = list(range(other.cells))
    random.Random(1).shuffle(order)
    assert all((other.counts(c) == want[c]).all() for c in order)
    assert (drawn(splitting.CountTree(1000, 40, 4, cell=7)) != drawn(one)).any()


@pytest.mark.parametrize("cell", [4096, 3])
def test_same_rows_on_any_partitioning(spark, monkeypatch, cell):
    monkeypatch.setattr(splitting, "CELL", cell)
    df = rows(spark, [{**x, "group": f"g{i % 90}"} for i, x in enumerate(sample(300))])
    for run in (b.cluster_bootstrap, b.auroc_bootstrap):
        one = sorted(map(tuple, run(df, 130).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        try:
            assert one == sorted(map(tuple, run(df.repartition(5, "id"), 130).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_agrees_with_addressed_draws(spark, monkeypatch):
    monkeypatch.setattr(splitting, "CELL", 16)
    df = rows(spark, [{**x, "group": f"g{i // 3}"} for i, x in enumerate(sample(450, 5))])
    a = {x.rate: x for x in b.cluster_bootstrap(df, 1500, method="addressed").collect()}
    z = {x.rate: x for x in b.cluster_bootstrap(df, 1500).collect()}
    for rate in a:
        if a[rate].low is not None and rate != "high_confidence_error_rate":
            assert z[rate].valid_replicates == a[rate].valid_replicates
            assert z[rate].low == pytest.approx(a[rate].low, abs=0.015) and z[rate].high == pytest.approx(a[rate].high, abs=0.015)
    one, two = b.auroc_bootstrap(df, 1500, method="addressed").first(), b.auroc_bootstrap(df, 1500).first()
    assert two.low == pytest.approx(one.low, abs=0.01) and two.high == pytest.approx(one.high, abs=0.01)


def test_replicates_equal_their_own_multiplicities(spark, monkeypatch):
    """Sums and AUROC of each replicate, from the tree's multiplicities in plain Python."""
    monkeypatch.setattr(splitting, "CELL", 8)
    items = [{**x, "group": f"g{i % 50}"} for i, x in enumerate(sample(200, 9))]
    df = rows(spark, items)
    vectors = b.group_vectors(df, {"n": b.F.count(b.F.lit(1))})
    ordinal = {r.group_id: r.ordinal for r in vectors.collect()}
    times = drawn(splitting.CountTree(50, 70, 11, cell=8))
    sums = {r.replicate: r.n for r in splitting.split_sums(vectors, ["n"], 70, 11).collect()}
    size = {r.group_id: r.n for r in vectors.collect()}
    assert sums == {k: sum(times[k, ordinal[g]] * n for g, n in size.items()) for k in range(70)}
    got = b.auroc_bootstrap(df, 70, 11).first()
    values = sorted(brute_auc([x for x in items for _ in range(times[k, ordinal[x["group"]]])]) for k in range(70))
    assert (got.low, got.high) == (pytest.approx(values[1]), pytest.approx(values[68]))


def test_wide_bands_count_as_ties(spark):
    df = rows(spark, [{**x, "group": f"g{i}", "score": (i * 37 % 500) / 500} for i, x in enumerate(sample(500, 2))])
    exact, banded = b.auroc_bootstrap(df, 200).first(), b.auroc_bootstrap(df, 200, bands=50).first()
    assert banded.low == pytest.approx(exact.low, abs=1 / 100) and banded.high == pytest.approx(exact.high, abs=1 / 100)


def test_no_draw_is_joined(spark):
    df = rows(spark, sample())
    vectors = b.group_vectors(df, {"n": b.F.count(b.F.lit(1))})
    plan = splitting.split_sums(vectors, ["n"], 100, 1)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Generate" not in plan and plan.count("Exchange") <= 4
