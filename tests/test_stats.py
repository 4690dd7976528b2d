import math

import pytest
from pyspark.sql import functions as F

from trueframe.functions.stats import mcnemar_exact, ratio, wilson_bounds


def interval(spark, k, n):
    low, high = wilson_bounds(F.lit(k), F.lit(n))
    return spark.range(1).select(low.alias("l"), high.alias("h"), ratio(F.lit(k), F.lit(n)).alias("p")).first()


@pytest.mark.parametrize("k, n, low, high", [
    (26, 39, 51.0, 79.4), (23, 39, 43.4, 72.9), (0, 36, 0.0, 9.6), (2, 36, 1.5, 18.1), (74, 75, 92.8, 99.8),
    (26, 26, 87.1, 100.0), (23, 25, 75.0, 97.8), (62, 75, 72.6, 89.6), (57, 75, 65.2, 84.2)])
def test_published_intervals(spark, k, n, low, high):
    row = interval(spark, k, n)
    assert (round(100 * row.l, 1), round(100 * row.h, 1)) == (low, high)


def test_empty_base_is_null(spark):
    assert tuple(interval(spark, 0, 0)) == (None, None, None)


def test_upper_bound_of_zero_in_ten(spark):
    assert interval(spark, 0, 10).h > 0.25


def p_value(spark, a, b):
    return spark.range(1).select(mcnemar_exact(F.lit(a).cast("long"), F.lit(b).cast("long")).alias("p")).first().p


@pytest.mark.parametrize("a, b, p", [(3, 6, 0.5078125), (6, 0, 0.03125), (0, 0, 1.0), (5, 5, 1.0)])
def test_exact_p(spark, a, b, p):
    assert p_value(spark, a, b) == pytest.approx(p, rel=1e-12)


@pytest.mark.parametrize("a, b", [(12, 40), (300, 420), (5000, 5200), (100_000, 101_000)])
def test_exact_p_does_not_underflow(spark, a, b):
    n = a + b
    log_terms = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2) for k in range(min(a, b) + 1)]
    top = max(log_terms)
    want = min(1.0, 2 * math.exp(top) * math.fsum(math.exp(x - top) for x in log_terms))
    assert p_value(spark, a, b) == pytest.approx(want, rel=1e-6)


@pytest.mark.parametrize("a, b", [(0, 300), (1, 299), (127, 128), (128, 128), (2000, 2100), (4999, 5001), (3000, 7000), (20, 4000)])
def test_exact_p_equals_the_sum(spark, a, b):
    n = a + b
    want = min(1.0, float(2 * sum(math.comb(n, k) for k in range(min(a, b) + 1)) / 2 ** n)) if n < 1000 else min(
        1.0, 2 * sum(math.comb(n, k) for k in range(min(a, b) + 1)) * 10 ** 40 // 2 ** n / 10 ** 40)
    assert p_value(spark, a, b) == pytest.approx(want, rel=1e-9, abs=1e-39)


@pytest.mark.parametrize("sigmas, p", [(1.0, 0.31731050786), (3.0, 0.00269979606), (5.0, 5.733031437e-7)])
def test_exact_p_of_very_many_pairs(spark, sigmas, p):
    # at 10^12 pairs the binomial is the normal distribution, but for its half-step
    n = 10 ** 12
    few = n // 2 - round(sigmas * math.sqrt(n) / 2)
    assert p_value(spark, few, n - few) == pytest.approx(p, rel=1e-4)
