"""Tail probabilities as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps by which the argument of the log-gamma function is raised before Stirling's series.
_RAISE = 10


def log_gamma(a: Column) -> Column:
    """Logarithm of the gamma function of a positive number, to about 13 digits."""
    z = a + F.lit(float(_RAISE))
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    stirling = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series
    raised = F.lit(0.0)
    for i in range(_RAISE):
        raised = raised + F.log(a + F.lit(float(i)))
    return stirling - raised


def upper_gamma(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function Q(a, x) for a > 0 and x >= 0.

    Below a + 1 by the power series of its complement, above by the continued fraction. Both settle in some
    multiples of the root of a, which is how many terms are taken.
    """
    terms = F.sequence(F.lit(1), (100 + 20 * F.sqrt(a)).cast("int"))
    scale = F.exp(a * F.log(x) - x - log_gamma(a))
    start = F.struct((1 / a).alias("term"), (1 / a).alias("total"))

    def more(s: Column, n: Column) -> Column:
        term = s["term"] * x / (a + n)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    lower = scale * F.aggregate(terms, start, more)["total"]
    b = x + 1 - a
    tiny = F.lit(1e-300)

    def not_zero(value: Column) -> Column:
        return F.when(F.abs(value) < tiny, tiny).otherwise(value)

    first = F.struct((1 / tiny).alias("c"), (1 / not_zero(b)).alias("d"), (1 / not_zero(b)).alias("h"))

    def deeper(s: Column, n: Column) -> Column:
        part = -n * (n - a)
        below = b + 2 * n
        d = 1 / not_zero(part * s["d"] + below)
        c = not_zero(below + part / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    upper = scale * F.aggregate(terms, first, deeper)["h"]
    found = F.when(x <= 0, 1.0).when(x < a + 1, 1 - lower).otherwise(upper)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), found))


def chi_square_tail(statistic: Column, degrees: Column) -> Column:
    """Chance that a chi-square variable exceeds the statistic; 1 when there is no degree of freedom."""
    half = F.greatest(degrees.cast("double"), F.lit(1.0)) / 2
    return F.when(degrees <= 0, 1.0).otherwise(upper_gamma(half, statistic / 2))
