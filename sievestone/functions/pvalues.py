"""Tail probabilities, as Column expressions where closed forms allow, else Arrow functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-15 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= (step := d * c)
        if abs(step - 1) < 1e-15:
            break
    return min(1.0, scale * h)


def chi2_sf(x: float, dof: float) -> float:
    return gamma_q(dof / 2, x / 2)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def ks_sf(d: float, n: float, m: float) -> float:
    """Asymptotic two-sample Kolmogorov-Smirnov probability."""
    t = d * math.sqrt(n * m / (n + m))
    if t < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))))


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        top = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + top * d or 1e-300)
        c = 1 + top / c or 1e-300
        f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * (f - 1)


def student_two_sided(t: float, dof: float) -> float:
    return beta_inc(dof / 2, 0.5, dof / (dof + t * t)) if dof > 0 else 1.0


def fisher_greater(a: int, b: int, c: int, d: int) -> float:
    """P(at least a) in a two by two table with its margins, by the hypergeometric distribution."""
    row, column, n = a + b, a + c, a + b + c + d
    log = lambda k: math.lgamma(row + 1) - math.lgamma(k + 1) - math.lgamma(row - k + 1) + math.lgamma(n - row + 1) - math.lgamma(column - k + 1) - math.lgamma(n - row - column + k + 1)
    total = math.lgamma(n + 1) - math.lgamma(column + 1) - math.lgamma(n - column + 1)
    return min(1.0, sum(math.exp(log(k) - total) for k in range(a, min(row, column) + 1)))


def _arrow(f):
    """The function as an Arrow function of columns, made when it is called, since types need a session."""

    def call(*columns):
        return F.pandas_udf(f, "double")(*[F.col(c) if isinstance(c, str) else c for c in columns])

    return call


def _chi2(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(a, b) if a == a else None for a, b in zip(x, dof, strict=True)])


def _ks(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([ks_sf(a, b, c) for a, b, c in zip(d, n, m, strict=True)])


def _normal(z: pd.Series) -> pd.Series:
    return z.map(normal_two_sided)


def _correlation(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([0.0 if abs(a) >= 1 else student_two_sided(a * math.sqrt((b - 2) / (1 - a * a)), b - 2) if b > 2 and a == a else 1.0 for a, b in zip(r, n, strict=True)])


def _fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_greater(*map(int, x)) for x in zip(a, b, c, d, strict=True)])


chi2_p, ks_p, normal_p, correlation_p, fisher_p = map(_arrow, (_chi2, _ks, _normal, _correlation, _fisher))
