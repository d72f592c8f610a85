"""Principal components and regression on them, from one pass of summed products."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstat.operators.linear import gram, matrix


def covariance(df: DataFrame, x: list[str]) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, means and covariance (n - 1); rows with a null are left out."""
    m = matrix(gram(df.dropna(subset=x), x).first(), len(x) + 1)
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    return n, mean, (m[1:, 1:] - n * np.outer(mean, mean)) / (n - 1)


class Components:
    """Axes by falling variance; of each the entry of largest size is positive, the first at ties. ``scale`` divides by deviations (of 1e-12 or less: 1)."""

    def __init__(self, df: DataFrame, x: list[str], scale: bool = True) -> None:
        self.x = x
        self.n, self.mean, cov = covariance(df, x)
        sd = np.sqrt(np.diag(cov))
        self.sd = np.where(sd > 1e-12, sd, 1.0) if scale else np.ones(len(x))
        self.variance, axes = np.linalg.eigh(cov / np.outer(self.sd, self.sd))
        self.variance, axes = self.variance[::-1], axes[:, ::-1]
        self.axes = axes * np.sign(axes[np.abs(axes).round(12).argmax(0), range(len(x))])
        self.share = self.variance / self.variance.sum()

    def score(self, k: int) -> Column:
        z = [(F.col(c) - float(m)) / float(s) for c, m, s in zip(self.x, self.mean, self.sd, strict=True)]
        return sum((float(a) * c for a, c in zip(self.axes[:, k], z, strict=True)), F.lit(0.0))


def component_regression(df: DataFrame, x: list[str], y: str, count: int) -> tuple[float, np.ndarray]:
    """Intercept and slopes in the units of x of least squares on the first ``count`` components of the scaled x."""
    data = df.dropna(subset=[*x, y])
    c = Components(data, x)
    _, mean, cov = covariance(data, [*x, y])
    axes = c.axes[:, :count]
    slopes = axes @ ((axes.T @ (cov[:-1, -1] / c.sd)) / c.variance[:count]) / c.sd
    return float(mean[-1] - slopes @ mean[:-1]), slopes
