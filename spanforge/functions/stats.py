"""Distributions as column expressions: tails of F and t, and quantiles of t; means that do not depend on the order of addition."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Stirling's series, B(2k) / (2k (2k - 1)).
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
_SHIFT = 8
MILLION = 1_000_000


def millionths(x: Column) -> Column:
    """x as a whole number of millionths: sums of these are exact, whatever the order of rows."""
    return F.round(x * MILLION).cast("long")


def mean_of_millionths(total: Column, n: Column) -> Column:
    """total / n rounded to a millionth, halves away from 0; null if n is 0."""
    whole = F.call_function("div", 2 * F.abs(total) + n, F.nullif(2 * n, F.lit(0)))
    return F.when(total < 0, -whole).otherwise(whole) / MILLION


def mean_reaches(total: Column, n: Column, least: float) -> Column:
    """Whether total millionths over n are least or more, compared as whole numbers."""
    return total >= round(least * MILLION) * n


def ln_gamma(x: Column) -> Column:
    """Logarithm of the gamma function above 0: Stirling's series at x + 8, less the logarithms of the steps there."""
    z = x + _SHIFT
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi)
    for k, c in enumerate(STIRLING):
        series = series + F.lit(c) / F.pow(z, F.lit(2.0 * k + 1))
    product = x
    for k in range(1, _SHIFT):
        product = product * (x + k)
    return series - F.log(product)


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """Continued fraction of the incomplete beta integral, folded from its far end; the terms needed grow with the root of a and b."""
    terms = F.least(F.ceil(F.sqrt(F.greatest(a, b)) * 4) + 60, F.lit(50_000)).cast("int")

    def step(acc: Column, k: Column) -> Column:
        m = F.floor(k / 2)
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return 1 + F.when(k % 2 == 0, even).otherwise(odd) / acc

    return F.aggregate(F.sequence(terms, F.lit(1)), F.lit(1.0), step)


def beta_share(x: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b), for a, b above 0; x below 0 counts as 0, above 1 as 1."""
    front = F.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + a * F.log(x) + b * F.log1p(-x))
    low = front / a / _fraction(x, a, b)
    high = 1 - front / b / _fraction(1 - x, b, a)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), low).otherwise(high)


def f_tail(f: Column, df1: Column, df2: Column) -> Column:
    """Probability of a value of F above f; null for nulls and without degrees of freedom."""
    a, b = df2.cast("double") / 2, df1.cast("double") / 2
    return F.when(f.isNotNull() & (df1 > 0) & (df2 > 0), beta_share(df2 / (df2 + df1 * F.greatest(f, F.lit(0.0))), a, b))


def t_tails(t: Column, df: Column) -> Column:
    """Probability of a value of t farther from 0 than t, on both sides."""
    return F.when(t.isNotNull() & (df > 0), beta_share(df / (df + t * t), df.cast("double") / 2, F.lit(0.5)))


def t_quantile(share: float, df: Column, rounds: int = 60) -> Column:
    """The value that t exceeds on either side with probability 1 - share, by bisection."""

    def halve(acc: Column, _: Column) -> Column:
        middle = (acc["low"] + acc["high"]) / 2
        wide = t_tails(middle, df) > 1 - share
        return F.struct(F.when(wide, middle).otherwise(acc["low"]).alias("low"), F.when(wide, acc["high"]).otherwise(middle).alias("high"))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(1e4).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve, lambda acc: (acc["low"] + acc["high"]) / 2)
