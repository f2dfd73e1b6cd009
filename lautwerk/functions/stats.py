"""Statistics as column expressions: intervals, likelihoods of categorical splits, log gamma."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-sided normal quantiles of the error levels that intervals are offered for.
NORMAL = {0.10: 1.6448536269514722, 0.05: 1.959963984540054, 0.01: 2.5758293035489004}

# Lanczos coefficients for g = 7, n = 9.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def wilson(count: Column, total: Column, alpha: float = 0.05) -> tuple[Column, Column]:
    """Lower and upper bound of a rate; [0, 1] without observations.  Fractional counts are allowed."""
    if alpha not in NORMAL:
        raise ValueError(f"alpha must be one of {sorted(NORMAL)}")
    z = NORMAL[alpha]
    n = total.cast("double")
    p = count.cast("double") / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    return F.when(total > 0, low).otherwise(0.0), F.when(total > 0, high).otherwise(1.0)


def xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.ln(x)).otherwise(0.0)


def nll(masses: list[Column]) -> Column:
    """Negative log-likelihood of a group under its own rates."""
    total = sum(masses[1:], masses[0])
    return xlogx(total.cast("double")) - sum((xlogx(m.cast("double")) for m in masses[1:]), xlogx(masses[0].cast("double")))


def lgamma(x: Column) -> Column:
    """Log gamma of a positive number (Spark has none); null for others."""
    y = F.when(x > 0, x.cast("double") - 1)
    series = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (y + k)
    t = y + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (y + 0.5) * F.ln(t) - t + F.ln(series)


def dirichlet_nll(masses: list[Column]) -> Column:
    """Negative log marginal likelihood under a symmetric Dirichlet whose concentration per outcome is mass / outcomes."""
    total = sum(masses[1:], masses[0]).cast("double")
    alpha = total / len(masses)
    gain = lgamma(masses[0] + alpha)
    for m in masses[1:]:
        gain = gain + lgamma(m + alpha)
    return F.when(total > 0, lgamma(total + total) - lgamma(total) + len(masses) * lgamma(alpha) - gain).otherwise(0.0)


#: Up to this n the two-outcome sum is added up; beyond it its asymptotic series is exact to ten digits.
SUMMED = 1000


def nml_normalizer(n: Column, outcomes: int | Column) -> Column:
    """Logarithm of the multinomial's normalised-maximum-likelihood sum, by the recurrence over outcomes.

    The sum for two outcomes is one more than Ramanujan's Q(n), whose series stands in for n terms where n is large.
    """
    x = n.cast("double")

    def term(h: Column) -> Column:
        h = h.cast("double")
        choose = lgamma(x + 1) - lgamma(h + 1) - lgamma(x - h + 1)
        return F.exp(choose + xlogx(h) + xlogx(x - h) - xlogx(x))

    few = F.least(n, F.lit(SUMMED)).cast("int")
    added = F.aggregate(F.sequence(F.lit(0), few), F.lit(0.0), lambda a, h: a + term(h))
    root = F.sqrt(math.pi / 2 * x)
    series = root + 2 / 3 + root / (12 * x) - 4 / (135 * x) + root / (288 * x * x) + 8 / (2835 * x * x)
    two = F.when(n > SUMMED, series).otherwise(added)
    k = F.lit(outcomes) if isinstance(outcomes, int) else outcomes
    pair = F.struct(F.lit(1.0).alias("below"), two.alias("here"))
    steps = F.when(k > 2, F.sequence(F.lit(1), k.cast("int") - 2)).otherwise(F.array().cast("array<int>"))
    last = F.aggregate(steps, pair, lambda p, j: F.struct(p["here"].alias("below"), (p["here"] + x / j * p["below"]).alias("here")), lambda p: p["here"])
    return F.when((n > 0) & (k > 1), F.ln(last)).otherwise(0.0)


def min_commit(n: Column, scale: float = 0.5) -> Column:
    """Smallest count a rule needs in a bucket of n."""
    return F.greatest(F.lit(2), F.ceil(scale * F.log2(n + F.lit(1.0)))).cast("long")
