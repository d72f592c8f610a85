"""Tests and intervals of linear and logistic fits. The rows are read for sums only; intervals of rows are columns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstat.functions.distributions import chi2_cdf, f_cdf, normal_cdf, t_cdf, t_quantile
from lumenstat.operators.linear import LeastSquares


def coefficient_tests(fit: LeastSquares, level: float = 0.95) -> list[tuple[str, float, float, float, float, float, float]]:
    """term, estimate, std_error, t, p (two-sided), low, high."""
    q = t_quantile(0.5 + level / 2, fit.df_resid)
    rows = zip(["(intercept)", *fit.x], fit.beta, fit.se, strict=True)
    return [(n, float(b), float(s), float(b / s), 2 * t_cdf(-abs(b / s), fit.df_resid), float(b - q * s), float(b + q * s)) for n, b, s in rows]


def overall_test(fit: LeastSquares) -> tuple[float, float]:
    """F statistic that all slopes are 0, and its p-value."""
    k = len(fit.x)
    f = (fit.tss - fit.rss) / k / fit.sigma2
    return f, 1 - f_cdf(f, k, fit.df_resid)


def with_intervals(df: DataFrame, fit: LeastSquares, level: float = 0.95) -> DataFrame:
    """Adds fit, mean_low, mean_high (of the mean at the row's x) and pred_low, pred_high (of a new row)."""
    q, s2 = t_quantile(0.5 + level / 2, fit.df_resid), fit.sigma2
    at, h = fit.predict(), fit.leverage()
    mean, new = q * F.sqrt(s2 * h), q * F.sqrt(s2 * (1 + h))
    return df.withColumns({"fit": at, "mean_low": at - mean, "mean_high": at + mean, "pred_low": at - new, "pred_high": at + new})


class Logistic:
    """Logistic regression of a 0/1 column by Newton steps, one weighted aggregation each, to a tolerance.

    Rows with nulls are left out. ``penalty`` is added to the diagonal but for the intercept. A class alone, or
    classes that the columns separate, have no finite fit without a penalty: steps end at ``steps``.
    """

    def __init__(self, df: DataFrame, x: list[str], y: str, steps: int = 50, tol: float = 1e-10, penalty: float = 0.0) -> None:
        self.x, self.y = x, y
        data = df.dropna(subset=[*x, y])
        k = len(x) + 1
        cols = [F.lit(1.0), *[F.col(c).cast("double") for c in x]]
        ridge = penalty * np.eye(k)
        ridge[0, 0] = 0
        self.beta, self.deviance = np.zeros(k), math.nan
        for _ in range(steps):
            p = self.probability()
            w, target = p * (1 - p), F.col(y).cast("double")
            sums = [F.sum(w * cols[i] * cols[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum((target - p) * c).alias(f"g{i}") for i, c in enumerate(cols)]
            loss = -2 * (target * F.log(p) + (1 - target) * F.log(1 - p))
            row = data.agg(*sums, F.count("*").alias("n"), F.sum(target).alias("ones"), F.sum(F.when(p > 0, F.when(p < 1, loss))).alias("dev")).first()
            self.n, self.ones, self.deviance = row["n"], row["ones"] or 0.0, row["dev"]
            if not self.n:
                break
            h = np.zeros((k, k))
            for i in range(k):
                for j in range(i, k):
                    h[i, j] = h[j, i] = row[f"h{i}_{j}"]
            self.covariance = np.linalg.pinv(h + ridge)
            move = self.covariance @ (np.array([row[f"g{i}"] for i in range(k)]) - ridge @ self.beta)
            self.beta = self.beta + np.clip(move, -5, 5)
            if np.abs(move).max() < tol:
                break

    def probability(self) -> Column:
        z = sum((F.lit(float(b)) * F.col(c).cast("double") for b, c in zip(self.beta[1:], self.x, strict=True)), F.lit(float(self.beta[0])))
        return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(700.0)), F.lit(-700.0))))

    def wald(self, z: float = 1.959963984540054) -> list[tuple[str, float, float, float, float, float, float, float]]:
        """term, estimate, std_error, z, p, odds_ratio, low, high (of the odds ratio)."""
        se = np.sqrt(np.diag(self.covariance))
        rows = zip(["(intercept)", *self.x], self.beta, se, strict=True)
        return [(n, float(b), float(s), float(b / s), 2 * normal_cdf(-abs(b / s)), math.exp(b), math.exp(b - z * s), math.exp(b + z * s)) for n, b, s in rows]

    def null_deviance(self) -> float:
        p = self.ones / self.n
        return 0.0 if p in (0, 1) else -2 * (self.ones * math.log(p) + (self.n - self.ones) * math.log(1 - p))

    def likelihood_ratio(self) -> tuple[float, float, float]:
        """Statistic against the intercept alone, its p-value, and McFadden's pseudo R squared."""
        null = self.null_deviance()
        lr = null - self.deviance
        return lr, 1 - chi2_cdf(lr, len(self.x)), 1 - self.deviance / null
