"""Linear models from one pass of summed products; only the small dense algebra is on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gram(df: DataFrame, x: list[str], y: str | None = None, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Sums of products of 1, x and y as columns s_i_j (i <= j), one row for each group: a single partial aggregation."""
    names = ["1", *x, *([y] if y else [])]
    w = F.col(weight) if weight else F.lit(1.0)
    col = {n: F.lit(1.0) if n == "1" else F.col(n).cast("double") for n in names}
    sums = [F.sum(w * col[names[i]] * col[names[j]]).alias(f"s_{i}_{j}") for i in range(len(names)) for j in range(i, len(names))]
    return (df.groupBy(*by) if by else df.groupBy()).agg(*sums)


def matrix(row, n: int) -> np.ndarray:
    m = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            m[i, j] = m[j, i] = row[f"s_{i}_{j}"]
    return m


class LeastSquares:
    """Ordinary or ridge least squares with an intercept that is not penalised."""

    def __init__(self, df: DataFrame, x: list[str], y: str, penalty: float = 0.0, weight: str | None = None) -> None:
        self.x, self.y = x, y
        k = len(x) + 1
        m = matrix(gram(df.dropna(subset=[*x, y]), x, y, weight=weight).first(), k + 1)
        self.n, self.xtx, self.xty, self.yty = m[0, 0], m[:k, :k], m[:k, k], m[k, k]
        ridge = penalty * np.eye(k)
        ridge[0, 0] = 0
        self.inverse = np.linalg.inv(self.xtx + ridge)
        self.beta = self.inverse @ self.xty
        self.rss = float(self.yty - 2 * self.beta @ self.xty + self.beta @ self.xtx @ self.beta)
        self.tss = float(self.yty - self.xty[0] ** 2 / self.n)
        self.df_resid = self.n - k
        self.sigma2 = self.rss / self.df_resid
        self.se = np.sqrt(self.sigma2 * np.diag(self.inverse))

    def predict(self) -> Column:
        return sum((F.lit(float(b)) * F.col(c) for b, c in zip(self.beta[1:], self.x, strict=True)), F.lit(float(self.beta[0])))

    def leverage(self) -> Column:
        """h_i as a column: the quadratic form of the row in the inverse."""
        cols = [F.lit(1.0), *[F.col(c).cast("double") for c in self.x]]
        return sum((F.lit(float(self.inverse[i, j])) * cols[i] * cols[j] for i in range(len(cols)) for j in range(len(cols))), F.lit(0.0))

    def table(self, spark) -> DataFrame:
        rows = [(n, float(b), float(s), float(b / s)) for n, b, s in zip(["(intercept)", *self.x], self.beta, self.se, strict=True)]
        return spark.createDataFrame(rows, "term string, estimate double, std_error double, t_value double")


def coordinate_descent(xtx: np.ndarray, xty: np.ndarray, n: float, lam: float, alpha: float = 1.0, start: np.ndarray | None = None, tol: float = 1e-10) -> np.ndarray:
    """Elastic net on centred products: minimises rss / 2n + lam (alpha |b|_1 + (1 - alpha) |b|^2 / 2)."""
    b = np.zeros(len(xty)) if start is None else start.copy()
    for _ in range(10_000):
        moved = 0.0
        for j in range(len(b)):
            r = (xty[j] - xtx[j] @ b + xtx[j, j] * b[j]) / n
            new = np.sign(r) * max(abs(r) - lam * alpha, 0) / (xtx[j, j] / n + lam * (1 - alpha))
            moved, b[j] = max(moved, abs(new - b[j])), new
        if moved < tol:
            break
    return b


def least_angle(xtx: np.ndarray, xty: np.ndarray, tol: float = 1e-12) -> list[np.ndarray]:
    """Coefficients after each step of least-angle regression on standardised, centred products; ties take the first."""
    p = len(xty)
    beta, active, path = np.zeros(p), [], [np.zeros(p)]
    while len(active) < p:
        c = xty - xtx @ beta
        top = np.abs(c).max()
        if top < tol:
            break
        rest = [j for j in range(p) if j not in active]
        active.append(max(rest, key=lambda j: (round(abs(c[j]), 12), -j)))
        s = np.sign(c[active])
        g = xtx[np.ix_(active, active)] * np.outer(s, s)
        w = np.linalg.solve(g, np.ones(len(active)))
        a = 1 / np.sqrt(w.sum())
        u = np.zeros(p)
        u[active] = a * w * s
        along = xtx @ u
        steps = [x for j in range(p) if j not in active for x in ((top - c[j]) / (a - along[j]), (top + c[j]) / (a + along[j])) if x > tol]
        beta = beta + (min(steps) if steps else top / a) * u
        path.append(beta.copy())
    return path
