"""Filtered exclusion and digest trees against plain sets."""

from collections import Counter

import pytest

from trueframe.operators import corpus as c
from trueframe.operators import joins as j

SCHEMA = "id long, basename string, crc string, size long, sha256 string"


def sets(spark):
    rows = [(i, f"n{i % 700}" if i % 13 else None, f"{i % 90:08x}" if i % 17 else None, i % 11, f"s{i}" if i % 19 else None) for i in range(1000)]
    known = [(0, f"n{i}" if i % 2 else None, f"{i % 90:08x}", i % 7 if i % 3 else None, f"s{i * 9}") for i in range(60)]
    return rows, known, spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(known, SCHEMA)


def known_by(row, known):
    whole = lambda values: None not in values
    return any(whole([r for r in key(row)]) and key(row) in {key(k) for k in known if whole(key(k))}
               for key in (lambda r: (r[1],), lambda r: (r[2], r[3]), lambda r: (r[4],)))


@pytest.mark.parametrize("bits", [None, 1 << 15, 1 << 20, 1 << 27, 64])
def test_exclusion_is_exact_at_any_filter_size(spark, bits):
    rows, known, candidates, register = sets(spark)
    got = sorted(r.id for r in j.exclude_known(candidates, register, bits=bits).collect())
    assert got == [r[0] for r in rows if not known_by(r, known)]


def test_filter_marks_every_known_row_and_few_others(spark):
    rows, known, candidates, register = sets(spark)
    marked = {r.id for r in j.mark_suspects(candidates, register).filter("suspect").collect()}
    true = {r[0] for r in rows if known_by(r, known)}
    assert true <= marked and len(marked - true) <= 2


def test_filter_size_is_bounded(spark):
    many = spark.range(200_000).selectExpr("cast(id AS string) AS basename")
    sieve = j.membership_filter(many, ("basename",), bits=1 << 18).selectExpr("bucket", "octet_length(bitmap) AS size").collect()
    assert len(sieve) == (1 << 18) // 32768 and {r["size"] for r in sieve} == {4096}


def test_filter_grows_with_the_known_rows_up_to_its_bound():
    sizes = [j.filter_bits(n) for n in (0, 100, 10 ** 5, 10 ** 12)]
    assert sizes == [1 << 15, 1 << 15, 1 << 21, j.FILTER_BITS] and all(b >= 16 * n for b, n in zip(sizes[:3], (0, 100, 10 ** 5)))


def test_candidates_are_not_shuffled_by_the_filter(spark):
    _, _, candidates, register = sets(spark)
    plan = j.mark_suspects(candidates, register)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 3


def test_empty_sides(spark):
    rows, _, candidates, register = sets(spark)
    assert j.exclude_known(candidates, register.limit(0)).count() == len(rows)
    assert j.exclude_known(candidates.limit(0), register).count() == 0


@pytest.mark.parametrize("depth", [0, 1, 2])
def test_tree_descent_finds_the_differing_rows(spark, depth):
    first = c.row_fingerprint(spark.range(3000).selectExpr("id % 2500 AS id"), ["id"]).select("fingerprint")
    second = c.row_fingerprint(spark.range(3000).selectExpr("id % 2500 + IF(id % 977 = 5, 100000, 0) AS id"), ["id"]).select("fingerprint")
    trees = [c.fingerprint_tree(x, depth) for x in (first, second)]
    got = {r.fingerprint: (r.in_first, r.in_second) for r in c.fingerprint_differences(first, second, *trees, depth).collect()}
    a, b = (Counter(r.fingerprint for r in x.collect()) for x in (first, second))
    assert got == {k: (a[k], b[k]) for k in a.keys() | b.keys() if a[k] != b[k]} and got


def test_equal_sets_have_equal_roots(spark):
    rows = c.row_fingerprint(spark.range(2000), ["id"]).select("fingerprint")
    trees = [c.fingerprint_tree(x, 1) for x in (rows, rows.repartition(7))]
    roots = [t.filter("level = 0").first() for t in trees]
    assert roots[0] == roots[1] and roots[0]["rows"] == 2000
    assert c.fingerprint_differences(rows, rows, *trees, 1).count() == 0
    empty = rows.limit(0)
    assert c.fingerprint_differences(empty, empty, *[c.fingerprint_tree(empty, 0)] * 2, 0).count() == 0


def test_depth_grows_with_the_rows():
    assert [c.tree_depth(n) for n in (0, 4096, 4097, 10 ** 6, 10 ** 12)] == [0, 0, 1, 1, 4]


def test_set_digest_is_one_row_beyond_its_least_levels(spark):
    df = c.row_fingerprint(spark.range(300), ["id"])
    assert c.set_fingerprint(df, "id", fan=4, levels=2).count() == 1
