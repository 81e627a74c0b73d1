"""Count distributions and weights, entirely in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def over_probability(mu: Column, line: float, dispersion: float = 0.0) -> Column:
    """P(count > line) at a half-integer line.

    Poisson when ``dispersion`` is zero, else negative binomial with variance
    ``mu + dispersion * mu**2``. The lower tail is a nested product of the
    ratios of neighbouring probabilities: plain arithmetic inside codegen.
    """
    k = int(line // 1)
    mu = mu.cast("double")
    if dispersion > 0:
        size = 1.0 / dispersion
        fail = mu / (F.lit(size) + mu)
        first = F.pow(1 - fail, F.lit(size))
        ratios = [F.lit((i - 1 + size) / i) * fail for i in range(1, k + 1)]
    else:
        first = F.exp(-mu)
        ratios = [mu / i for i in range(1, k + 1)]
    if k < 0:
        return F.when(mu.isNotNull(), F.lit(1.0))
    tail = F.lit(1.0)
    for ratio in reversed(ratios):
        tail = 1 + ratio * tail
    return 1 - first * tail


def recency_weight(age: Column, half_life: float | None) -> Column:
    """``0.5 ** (age / half_life)``; no half-life means weight one."""
    if half_life is None or half_life <= 0:
        return F.lit(1.0)
    return F.pow(F.lit(0.5), age / F.lit(float(half_life)))
