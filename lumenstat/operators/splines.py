"""B-splines of any degree as columns, tensor products, and penalised fits from one aggregation of products."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstat.operators.inference import Logistic
from lumenstat.operators.linear import gram, matrix
from lumenstat.operators.validate import effective_df, gcv


def bspline(x: Column, interior: list[float], low: float, high: float, degree: int = 3) -> list[Column]:
    """Basis on [low, high] with repeated boundary knots, by the two-term recursion; the last piece holds its right end; 0 outside."""
    t = [float(low)] * (degree + 1) + [float(k) for k in interior] + [float(high)] * (degree + 1)
    last = max(i for i in range(len(t) - 1) if t[i] < t[i + 1])
    basis: list[Column | None] = []
    for i in range(len(t) - 1):
        inside = (x >= t[i]) & ((x <= t[i + 1]) if i == last else (x < t[i + 1]))
        basis.append(F.when(inside, 1.0).otherwise(0.0) if t[i] < t[i + 1] else None)
    for d in range(1, degree + 1):
        new: list[Column | None] = []
        for i in range(len(t) - 1 - d):
            left = (x - t[i]) / (t[i + d] - t[i]) * basis[i] if basis[i] is not None and t[i + d] > t[i] else None
            right = (t[i + d + 1] - x) / (t[i + d + 1] - t[i + 1]) * basis[i + 1] if basis[i + 1] is not None and t[i + d + 1] > t[i + 1] else None
            new.append(left + right if left is not None and right is not None else left if left is not None else right)
        basis = new
    return [b if b is not None else F.lit(0.0) for b in basis]


def tensor_product(a: list[Column], b: list[Column]) -> list[Column]:
    return [p * q for p in a for q in b]


def difference_penalty(p: int, order: int = 2) -> np.ndarray:
    d = np.diff(np.eye(p), n=order, axis=0)
    return d.T @ d


def tensor_penalty(p: int, q: int, order: int = 2) -> np.ndarray:
    """Differences along both directions of a p by q table of coefficients."""
    return np.kron(difference_penalty(p, order), np.eye(q)) + np.kron(np.eye(p), difference_penalty(q, order))


class PenalizedFit:
    """Least squares on basis columns (no intercept of its own) plus lam b'Pb; ``df`` rows with nulls are left out."""

    def __init__(self, df: DataFrame, basis: list[Column], y: str, lam: float = 1e-8, penalty: np.ndarray | None = None) -> None:
        self.basis, k = basis, len(basis)
        names = [f"_b{i}" for i in range(k)]
        data = df.select(F.col(y).cast("double").alias("_y"), *[b.alias(n) for b, n in zip(basis, names, strict=True)]).dropna()
        m = matrix(gram(data, names, "_y").first(), k + 2)
        self.n, self.xtx, xty = m[0, 0], m[1:-1, 1:-1], m[1:-1, -1]
        self.penalty = np.eye(k) if penalty is None else penalty
        self.lam = lam
        self.inverse = np.linalg.inv(self.xtx + lam * self.penalty + 1e-9 * np.eye(k))
        self.beta = self.inverse @ xty
        self.rss = float(m[-1, -1] - 2 * self.beta @ xty + self.beta @ self.xtx @ self.beta)
        self.df = effective_df(self.xtx + 1e-9 * np.eye(k), self.penalty, lam)
        self.gcv = gcv(self.rss, self.n, self.df)

    def predict(self) -> Column:
        return sum((float(b) * c for b, c in zip(self.beta[1:], self.basis[1:], strict=True)), float(self.beta[0]) * self.basis[0])

    def leverage(self) -> Column:
        """The row's own weight in its fit: the diagonal of the smoother."""
        k = len(self.basis)
        return sum((float(self.inverse[i, j]) * self.basis[i] * self.basis[j] for i in range(k) for j in range(k)), F.lit(0.0))

    def loocv(self, df: DataFrame, y: str) -> float:
        """Mean squared error with each row left out, by the leverage shortcut."""
        return df.agg(F.avg(F.pow((F.col(y) - self.predict()) / (1 - self.leverage()), F.lit(2)))).first()[0]


def logistic_spline(df: DataFrame, basis: list[Column], y: str, penalty: float = 1e-6) -> tuple[Logistic, DataFrame]:
    """Logistic regression on basis columns but the first, which the intercept stands for; also ``df`` with those columns (b1, b2, ...)."""
    wide = df.select("*", *[b.alias(f"b{i}") for i, b in enumerate(basis) if i])
    return Logistic(wide, [f"b{i}" for i in range(1, len(basis))], y, penalty=penalty), wide


def backfitted(df: DataFrame, groups: list[list[Column]], y: str, lam: float, sweeps: int = 200, tol: float = 1e-10) -> tuple[float, list[np.ndarray]]:
    """Additive model by backfitting: each group of basis columns in turn is fitted to what the others leave, until nothing moves.

    One pass over the rows gives all products; the turns run on those. Each smooth has mean 0. Returns the mean and the coefficients.
    """
    sizes = [len(g) for g in groups]
    flat = [c for g in groups for c in g]
    names = [f"_b{i}" for i in range(len(flat))]
    data = df.select(F.col(y).cast("double").alias("_y"), *[b.alias(n) for b, n in zip(flat, names, strict=True)]).dropna()
    m = matrix(gram(data, names, "_y").first(), len(flat) + 2)
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    c = m[1:, 1:] - n * np.outer(mean, mean)  # centred: smooths of mean 0
    cut = np.concatenate([[0], np.cumsum(sizes)])
    beta = np.zeros(len(flat))
    solve = [np.linalg.inv(c[a:b, a:b] + lam * difference_penalty(b - a) + 1e-8 * np.eye(b - a)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    for _ in range(sweeps):
        moved = 0.0
        for s, a, b in zip(solve, cut[:-1], cut[1:], strict=True):
            rest = c[a:b, -1] - c[a:b, :-1] @ beta + c[a:b, a:b] @ beta[a:b]
            new = s @ rest
            moved, beta[a:b] = max(moved, float(np.abs(new - beta[a:b]).max())), new
        if moved < tol:
            break
    return float(mean[-1] - beta @ mean[:-1]), [beta[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def additive_predict(mean: float, groups: list[list[Column]], beta: list[np.ndarray]) -> Column:
    return sum((float(b) * c for g, bs in zip(groups, beta, strict=True) for b, c in zip(bs, g, strict=True)), F.lit(mean))
