"""Scatter of classes, Fisher directions, screening by correlation before components, and descent on summed products."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstat.operators.linear import gram, matrix


def class_scatter(df: DataFrame, x: list[str], label: str) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels in order, their means and sizes, and the scatter within and between classes: one aggregation."""
    data, k = df.dropna(subset=[*x, label]), len(x)
    per = {r[label]: matrix(r, k + 1) for r in gram(data, x, by=[label]).collect()}
    names = sorted(per)
    n = np.array([per[c][0, 0] for c in names])
    means = np.array([per[c][0, 1:] / per[c][0, 0] for c in names])
    within = sum(per[c][1:, 1:] - per[c][0, 0] * np.outer(m, m) for c, m in zip(names, means, strict=True))
    off = means - (n @ means) / n.sum()
    return names, means, n, within, (off * n[:, None]).T @ off


def fisher_directions(within: np.ndarray, between: np.ndarray, penalty: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and directions (columns) that most separate classes; each direction has within-scatter 1 and its greatest entry positive."""
    low = np.linalg.cholesky(within + penalty * np.eye(len(within)))
    half = np.linalg.inv(low)
    values, vectors = np.linalg.eigh(half @ between @ half.T)
    a = half.T @ vectors[:, ::-1]
    return values[::-1], a * np.sign(a[np.abs(a).argmax(0), np.arange(a.shape[1])])


def discriminant_coordinates(df: DataFrame, x: list[str], directions: np.ndarray, count: int = 2) -> DataFrame:
    """Adds f1, f2, ...: the row along each direction."""
    return df.withColumns({f"f{k + 1}": sum((float(v) * F.col(c) for v, c in zip(directions[:, k], x, strict=True)), F.lit(0.0)) for k in range(min(count, directions.shape[1]))})


def nearest_mean(cols: list[Column], names: list, means: np.ndarray) -> Column:
    """The class whose mean is nearest in the columns given, the first at ties."""
    d = [sum(((c - float(v)) * (c - float(v)) for c, v in zip(cols, m, strict=True)), F.lit(0.0)) for m in means]
    least, out = F.least(*d) if len(d) > 1 else d[0], F.lit(names[-1])
    for k in reversed(range(len(d) - 1)):
        out = F.when(d[k] <= least, F.lit(names[k])).otherwise(out)
    return out


def class_accuracy(df: DataFrame, y: str, predicted: str) -> DataFrame:
    """y, n, accuracy of each class."""
    return df.dropna(subset=[y]).groupBy(y).agg(F.count("*").alias("n"), F.avg(F.when(F.col(predicted) == F.col(y), 1.0).otherwise(0.0)).alias("accuracy"))


def screened(df: DataFrame, x: list[str], y: str) -> DataFrame:
    """term, score: absolute correlation with y, the greatest first; one aggregation."""
    row = df.agg(*[F.abs(F.corr(c, y)).alias(c) for c in x])
    return row.unpivot([], x, "term", "score").orderBy(F.desc("score"), "term")


class SupervisedComponents:
    """Components of the columns whose score passes ``least`` (or the ``top`` best), and regression on the first ``count`` of them."""

    def __init__(self, df: DataFrame, x: list[str], y: str, count: int = 1, least: float = 0.0, top: int | None = None) -> None:
        rows = screened(df, x, y).collect()
        self.x = sorted(r["term"] for r in (rows[:top] if top else [r for r in rows if (r["score"] or 0) >= least]))
        k = len(self.x)
        m = matrix(gram(df.dropna(subset=[*self.x, y]), self.x, y).first(), k + 2)
        n, self.mean = m[0, 0], m[0, 1:] / m[0, 0]
        c = m[1:, 1:] - n * np.outer(self.mean, self.mean)
        self.sd = np.sqrt(np.maximum(np.diag(c)[:k] / (n - 1), 1e-24))
        z = c[:k, :k] / np.outer(self.sd, self.sd)
        values, vectors = np.linalg.eigh(z)
        self.rotation = vectors[:, ::-1][:, :count]
        self.variances = values[::-1][:count] / (n - 1)
        self.gamma = (self.rotation.T @ (c[:k, k] / self.sd)) / np.maximum(values[::-1][:count], 1e-12)

    def predict(self) -> Column:
        b = (self.rotation @ self.gamma) / self.sd
        return sum((float(v) * F.col(c) for v, c in zip(b, self.x, strict=True)), F.lit(float(self.mean[-1] - b @ self.mean[:-1])))


def least_squares_descent(m: np.ndarray, rate: float | None = None, steps: int = 100) -> tuple[np.ndarray, list[float]]:
    """Steepest descent on rss / 2n from the products of 1, x and y (as ``matrix`` gives them); without a rate, each step is the exact one.
    Returns the coefficients and the objective before each step and at the end."""
    a, b, n = m[:-1, :-1] / m[0, 0], m[:-1, -1] / m[0, 0], m[0, 0]
    beta, path = np.zeros(len(b)), []
    for _ in range(steps):
        path.append(float(0.5 * (m[-1, -1] / n - 2 * beta @ b + beta @ a @ beta)))
        g = a @ beta - b
        bend = g @ a @ g
        beta = beta - ((g @ g / bend if bend > 0 else 0.0) if rate is None else rate) * g
    path.append(float(0.5 * (m[-1, -1] / n - 2 * beta @ b + beta @ a @ beta)))
    return beta, path


def condition(m: np.ndarray) -> tuple[float, float]:
    """Condition number of the mean products, and the greatest rate at which descent with a fixed rate is stable."""
    values = np.linalg.eigvalsh(m[:-1, :-1] / m[0, 0])
    return float(values[-1] / max(values[0], 1e-300)), float(2 / values[-1])


def numerical_gradient(f, at: np.ndarray, h: float = 1e-6) -> np.ndarray:
    """Central differences of any function of a vector."""
    at, out = np.asarray(at, float), np.zeros(len(at))
    for i in range(len(at)):
        e = np.zeros(len(at))
        e[i] = h
        out[i] = (f(at + e) - f(at - e)) / (2 * h)
    return out
