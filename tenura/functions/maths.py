"""Small numeric Column helpers that keep null as null and never divide by zero."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WILSON_Z = 1.959963984540054


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator where the denominator is positive, else null."""
    den = denominator.cast("double")
    return F.when(den > 0, numerator.cast("double") / den)


def clip(c: Column, low: float | None = None, high: Column | float | None = None) -> Column:
    """Bounds that leave null alone; a null upper bound does not constrain."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low).cast("double"))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(c.isNotNull(), out)


def is_true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def adjusted_skew(g1: Column, n: Column) -> Column:
    n = n.cast("double")
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(g2: Column, n: Column) -> Column:
    n = n.cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where both are present; null when either is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def wilson(k: Column, n: Column, z: float = WILSON_Z) -> tuple[Column, Column]:
    """Wilson interval of k successes in n trials; (0, 0) for n = 0."""
    k, n = k.cast("double"), n.cast("double")
    p = F.try_divide(k, n)
    z2 = z * z
    denominator = 1.0 + z2 / n
    centre = (p + z2 / (2.0 * n)) / denominator
    margin = z * F.sqrt(p * (1.0 - p) / n + z2 / (4.0 * n * n)) / denominator
    low = F.when(n > 0, F.greatest(F.lit(0.0), centre - margin)).otherwise(0.0)
    high = F.when(n > 0, F.least(F.lit(1.0), centre + margin)).otherwise(0.0)
    return low, high


def signed_log(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def uniform(key: Column, seed: int) -> Column:
    """Uniform draw in [0, 1) that depends on the row key only, never on the partitioning."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)).cast("double") / float(1 << 52)


def gaussian(key: Column, seed: int) -> Column:
    """Standard normal draw from two keyed uniforms (Box-Muller)."""
    u = F.greatest(uniform(key, seed), F.lit(1e-12))
    v = uniform(key, seed + 7919)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * math.pi * v)
