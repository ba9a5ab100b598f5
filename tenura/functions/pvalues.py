"""Survival functions for the few rows left after a distributed statistic."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * scale)
    tiny = 1e-300
    b = x + 1.0 - a
    c = 1.0 / tiny
    d = 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return scale * h


def chi2_sf(statistic: float, dof: float) -> float:
    return _gamma_upper(dof / 2.0, statistic / 2.0) if dof > 0 else 1.0


def kolmogorov_sf(lam: float) -> float:
    if lam < 0.2:
        return 1.0
    total = sum((-1) ** (k - 1) * math.exp(-2.0 * (k * lam) ** 2) for k in range(1, 101))
    return min(1.0, max(0.0, 2.0 * total))


def ks_sf(d: float, n1: float, n2: float) -> float:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value."""
    return kolmogorov_sf(d * math.sqrt(n1 * n2 / (n1 + n2)))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c = 1.0
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def _beta_regularised(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b)
        - math.lgamma(a)
        - math.lgamma(b)
        + a * math.log(x)
        + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def student_two_sided(t: float, dof: float) -> float:
    if dof <= 0:
        return float("nan")
    return _beta_regularised(dof / 2.0, 0.5, dof / (dof + t * t))


def correlation_p(r: float, n: float) -> float:
    """Two-sided p-value of a Pearson or Spearman coefficient over n pairs."""
    if n < 3:
        return float("nan")
    if abs(r) >= 1.0:
        return 0.0
    return student_two_sided(r * math.sqrt((n - 2) / (1.0 - r * r)), n - 2)


def wilcoxon_greater(differences: list[float]) -> float:
    """Paired Wilcoxon signed-rank p-value, alternative 'greater'; zeros are dropped.

    Exact for up to 25 untied differences, normal approximation otherwise.
    """
    d = [x for x in differences if x != 0]
    n = len(d)
    if n == 0:
        return 1.0
    order = sorted(range(n), key=lambda i: abs(d[i]))
    ranks = [0.0] * n
    tied = False
    ties = 0.0
    i = 0
    while i < n:
        j = i
        while j + 1 < n and abs(d[order[j + 1]]) == abs(d[order[i]]):
            j += 1
        for k in range(i, j + 1):
            ranks[order[k]] = (i + j) / 2.0 + 1.0
        t = j - i + 1
        tied |= t > 1
        ties += t**3 - t
        i = j + 1
    w = sum(r for r, x in zip(ranks, d, strict=True) if x > 0)
    if n <= 25 and not tied and n == len(differences):
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        return sum(ways[round(w) :]) / 2.0**n
    mean = n * (n + 1) / 4.0
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0)
    return 0.5 * math.erfc((w - mean) / spread / math.sqrt(2.0)) if spread > 0 else 1.0


def _vectorised(function, *columns: Column) -> Column:
    @F.pandas_udf("double")
    def apply(frame: pd.DataFrame) -> pd.Series:
        out = [
            None if any(pd.isna(v) for v in row) else function(*map(float, row))
            for row in frame.itertuples(index=False)
        ]
        return pd.Series(out, dtype="float64")

    named = [c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)]
    return apply(F.struct(*named))


def normal_p(z: Column) -> Column:
    return _vectorised(normal_two_sided, z)


def chi2_p(statistic: Column, dof: Column) -> Column:
    return _vectorised(chi2_sf, statistic, dof)


def ks_p(d: Column, n1: Column, n2: Column) -> Column:
    return _vectorised(ks_sf, d, n1, n2)


def pearson_p(r: Column, n: Column) -> Column:
    return _vectorised(correlation_p, r, n)
