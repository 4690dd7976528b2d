"""Interval and test formulas as Column expressions."""

from __future__ import annotations

import math

from numpy.polynomial.legendre import leggauss
from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054
HALF_LN_2PI, LN_2 = 0.5 * math.log(2 * math.pi), math.log(2)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null, not zero, when there is nothing to divide by."""
    return F.when(denominator > 0, numerator / denominator)


def wilson_bounds(numerator: Column, denominator: Column, z: float = Z95) -> tuple[Column, Column]:
    """Score interval of a binomial share; null bounds when the base is empty."""
    n = F.when(denominator > 0, denominator.cast("double"))
    share = numerator / n
    scale = 1 + z * z / n
    middle = (share + z * z / (2 * n)) / scale
    reach = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n)) / scale
    # greatest/least skip nulls, so the empty base is kept null by hand
    return (F.when(denominator > 0, F.greatest(F.lit(0.0), middle - reach)),
            F.when(denominator > 0, F.least(F.lit(1.0), middle + reach)))


def log_factorial(n: Column) -> Column:
    """ln n! by an exact sum for small n and Stirling's series beyond 255."""
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(255)).cast("int"))),
                        F.lit(0.0), lambda acc, k: acc + F.ln(k.cast("double")))
    x = n.cast("double") + 1
    series = ((x - 0.5) * F.ln(x) - x + 0.9189385332046727 + 1 / (12 * x)
              - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x))
    return F.when(n <= 255, small).otherwise(series)


def stirling_error(n: Column) -> Column:
    """ln n! less Stirling's formula, n >= 1: from the exact sum up to 15, the series beyond."""
    x = n.cast("double")
    exact = log_factorial(n) - (x + 0.5) * F.ln(x) + x - HALF_LN_2PI
    return F.when(n <= 15, exact).otherwise((1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / (x * x)) / (x * x)) / (x * x)) / x)


def half_binomial(k: Column, n: Column) -> Column:
    """P(X = k) of n fair trials, k <= n / 2.

    Above 255 trials no logarithms of factorials are subtracted from each
    other: what is left is the deviance of k from n / 2, whose power series is
    used near the middle, so the relative error stays small at any n.
    """
    total, few = n.cast("double"), k.cast("double")
    small = log_factorial(n) - log_factorial(k) - log_factorial(n - k) - total * LN_2
    off = (total - 2 * few) / total
    square = off * off
    series = F.lit(0.0)
    for j in range(12, 0, -1):
        series = square * (1 / (j * (2 * j - 1)) + series)
    deviance = total / 2 * F.when(off < 0.1, series).otherwise(
        (1 - off) * F.log1p(-off) + (1 + off) * F.log1p(off))
    large = (stirling_error(n) - stirling_error(k) - stirling_error(n - k) - deviance
             + 0.5 * F.ln(total / few / (total - few)) - HALF_LN_2PI)
    return F.exp(F.when(n <= 255, small).when(k == 0, -total * LN_2).otherwise(large))


def half_tail_ratio(k: Column, n: Column) -> Column:
    """P(X <= k) / P(X = k) of n >= 1 fair trials, k <= n / 2.

    The tail is an incomplete beta integral, which becomes
    (n - k) * integral over v in 0..1 of (1 - v)^(n - 2k - 1) (1 - v^2)^k. A
    fixed Gauss-Legendre rule takes it up to where it has fallen below e^-45:
    64 nodes whatever n is (and exact for n <= 128, where it is a polynomial).
    """
    few, skew = k.cast("double"), (n - 2 * k - 1).cast("double")
    reach = F.least(F.lit(1.0), F.when(skew > 0, 45 / skew), F.when(few > 0, F.sqrt(45 / few)))
    nodes, weights = leggauss(64)
    rule = F.array(*[F.struct(F.lit((1 + float(x)) / 2).alias("at"), F.lit(float(w) / 2).alias("weight"))
                     for x, w in zip(nodes, weights)])

    def term(total: Column, node: Column) -> Column:
        v = reach * node["at"]
        return total + node["weight"] * F.exp(skew * F.log1p(-v) + few * F.log1p(-v * v))

    return (n - k).cast("double") * reach * F.aggregate(rule, F.lit(0.0), term)


def mcnemar_exact(improved: Column, regressed: Column) -> Column:
    """Two-sided exact p of the discordant pairs; 1 when there are none.

    Constant work at any count: one point probability and one quadrature.
    """
    total, few = improved + regressed, F.least(improved, regressed)
    return F.when(total == 0, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), 2 * half_binomial(few, total) * half_tail_ratio(few, total)))
