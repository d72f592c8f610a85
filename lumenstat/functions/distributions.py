"""Distribution functions and quantiles for statistics of a few coefficients: plain numbers on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated forwards with ratios of convergents."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_cdf(x: float, a: float) -> float:
    """Regularised lower incomplete gamma function: a series below a + 1, Lentz's fraction above."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > 1e-17 * total:
            k += 1
            term *= x / k
            total += term
        return front * total
    b, c = x + 1 - a, 1e300
    d = out = 1 / b
    for i in range(1, 1000):
        b += 2
        top = -i * (i - a)
        d, c = 1 / (top * d + b), b + top / c
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 - front * out


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * beta_cdf(df / (df + t * t), df / 2, 0.5)
    return 1 - tail if t > 0 else tail


def f_cdf(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d1 * f / (d1 * f + d2), d1 / 2, d2 / 2) if f > 0 else 0.0


def chi2_cdf(x: float, df: float) -> float:
    return gamma_cdf(x / 2, df / 2)


def quantile(cdf: Callable[[float], float], p: float, low: float = -1e4, high: float = 1e4) -> float:
    """Where a distribution function reaches ``p``, by halving."""
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def t_quantile(p: float, df: float) -> float:
    return quantile(lambda t: t_cdf(t, df), p)
