"""Column functions shared by operators: kernels, bases, losses, keyed folds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def soft_threshold(x: Column, t: Column | float) -> Column:
    return F.signum(x) * F.greatest(F.abs(x) - t, F.lit(0.0))


def hinge(x: Column, knot: float, right: bool = True) -> Column:
    return F.greatest(x - knot if right else F.lit(knot) - x, F.lit(0.0))


def truncated_power(x: Column, knot: float, degree: int = 3) -> Column:
    return F.pow(hinge(x, knot), F.lit(degree))


def epanechnikov(u: Column) -> Column:
    return F.when(F.abs(u) < 1, 0.75 * (1 - u * u)).otherwise(0.0)


def tricube(u: Column) -> Column:
    a = F.abs(u)
    return F.when(a < 1, F.pow(1 - a * a * a, F.lit(3))).otherwise(0.0)


def gaussian(u: Column) -> Column:
    return F.exp(-0.5 * u * u)


def huber(r: Column, delta: float) -> Column:
    a = F.abs(r)
    return F.when(a <= delta, 0.5 * r * r).otherwise(delta * (a - 0.5 * delta))


def pinball(r: Column, tau: float) -> Column:
    return F.when(r >= 0, tau * r).otherwise((tau - 1) * r)


def fold(key: Column, k: int) -> Column:
    """A fold number from integer arithmetic on a key, the same on any engine."""
    return F.pmod(F.pmod(key, F.lit(k)) * 7919 + 104729, F.lit(k)).cast("int")  # the remainder first: no key is too large


def bspline1(x: Column, knots: list[float]) -> list[Column]:
    """Linear B-spline basis on the knots, as hat functions."""
    out = []
    for i, k in enumerate(knots):
        left = (x - knots[i - 1]) / (k - knots[i - 1]) if i else None
        right = (knots[i + 1] - x) / (knots[i + 1] - k) if i + 1 < len(knots) else None
        col = F.lit(0.0)
        if right is not None:
            col = F.when((x >= k) & (x <= knots[i + 1]), right).otherwise(col)
        if left is not None:
            col = F.when((x >= knots[i - 1]) & (x < k) if right is not None else (x >= knots[i - 1]) & (x <= k), left).otherwise(col)
        out.append(col)
    return out
