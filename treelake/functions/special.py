"""Special functions as Column expressions, for significance of correlations."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stirling's series is taken this far beyond its argument, where four of its terms are exact to 1e-15.
SHIFT = 16


def log_gamma(x: Column) -> Column:
    """ln of the gamma function of a positive number."""
    z = x + SHIFT
    series = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7))
    return series - F.aggregate(F.sequence(F.lit(0), F.lit(SHIFT - 1)), F.lit(0.0), lambda s, i: s + F.ln(x + i))


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, from its front on: the n-th step adds a pair of terms to the
    numerators and denominators of its convergents, kept in range by their own size."""
    steps = F.sequence(F.lit(1), (F.lit(60) + F.ceil(3 * F.sqrt(F.greatest(a, b)))).cast("int"))
    pair = lambda p, q, r, s: F.struct(p.alias("p"), q.alias("q"), r.alias("r"), s.alias("s"))
    one = F.lit(1.0)
    start = pair(one, one, one, 1 - (a + b) * x / (a + 1))  # two convergents, p / q and r / s

    def more(c, n):
        even = n * (b - n) * x / ((a + 2 * n - 1) * (a + 2 * n))
        odd = -(a + n) * (a + b + n) * x / ((a + 2 * n) * (a + 2 * n + 1))
        p, q = c["r"] + even * c["p"], c["s"] + even * c["q"]
        r, s = p + odd * c["r"], q + odd * c["s"]
        size = F.greatest(F.abs(r), F.abs(s), F.lit(1e-300))
        return pair(p / size, q / size, r / size, s / size)

    return F.aggregate(steps, start, more, lambda c: c["r"] / c["s"])


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b) for 0 <= x <= 1."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    low, high = front * _fraction(a, b, x) / a, 1 - front * _fraction(b, a, 1 - x) / b
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), low).otherwise(high)


def correlation_p(r: Column, n: Column) -> Column:
    """The two-sided p of a correlation r of n pairs, under Student's t with n - 2 degrees of freedom; null below 3 pairs or without r."""
    return F.when((n > 2) & r.isNotNull(), incomplete_beta((n - 2).cast("double") / 2, F.lit(0.5), F.greatest(1 - r * r, F.lit(0.0))))
