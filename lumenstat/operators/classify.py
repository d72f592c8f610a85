"""Discriminant analysis, shrunken centroids and logistic regression from grouped sums; models are small and become literals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstat.operators.linear import gram, matrix


class Moments:
    """Size, means and centred products of every class, from one grouped aggregation. Rows with a null are left out."""

    def __init__(self, df: DataFrame, label: str, x: list[str]) -> None:
        self.x, k = x, len(x) + 1
        rows = sorted(gram(df.dropna(subset=[label, *x]), x, by=[label]).collect(), key=lambda r: r[label])
        sums = [matrix(r, k) for r in rows]
        self.labels = [r[label] for r in rows]
        self.n = np.array([m[0, 0] for m in sums])
        self.means = np.array([m[0, 1:] / m[0, 0] for m in sums])
        self.within = [m[1:, 1:] - m[0, 0] * np.outer(c, c) for m, c in zip(sums, self.means, strict=True)]
        self.pooled = sum(self.within) / (self.n.sum() - len(rows))
        self.prior = self.n / self.n.sum()


def _quadratic(x: list[str], at: np.ndarray, inverse: np.ndarray) -> Column:
    z = [F.col(c).cast("double") - float(a) for c, a in zip(x, at, strict=True)]
    return sum((float(inverse[i, j]) * z[i] * z[j] for i in range(len(x)) for j in range(len(x)) if inverse[i, j]), F.lit(0.0))


def discriminants(m: Moments, kind: str = "linear") -> list[Column]:
    """A score for each class: Gaussian log density up to what all share, plus log prior. Kinds: linear, diagonal (pooled covariance), quadratic (own)."""
    out = []
    for k in range(len(m.labels)):
        cov = m.within[k] / (m.n[k] - 1) if kind == "quadratic" else m.pooled
        cov = np.diag(np.diag(cov)) if kind == "diagonal" else cov
        shift = float(np.log(m.prior[k])) - (0.5 * float(np.linalg.slogdet(cov)[1]) if kind == "quadratic" else 0.0)
        out.append(F.lit(shift) - 0.5 * _quadratic(m.x, m.means[k], np.linalg.inv(cov)))
    return out


def first_best(labels: list, scores: list[Column]) -> Column:
    """The label of the highest score, the first at ties."""
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    col = F.lit(labels[-1])
    for label, s in reversed(list(zip(labels[:-1], scores[:-1], strict=True))):
        col = F.when(s >= top, F.lit(label)).otherwise(col)
    return col


def softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores)
    total = sum((F.exp(s - top) for s in scores), F.lit(0.0))
    return [F.exp(s - top) / total for s in scores]


def shrunken(df: DataFrame, label: str, vec: str, threshold: float) -> DataFrame:
    """label, i, mean, d, shrunk: standardised differences from the overall mean and centroids rebuilt from soft-thresholded ones.

    The offset of the deviations is their median. Only class x component rows are joined.
    """
    long = df.select(label, F.posexplode(vec).alias("i", "x"))
    cell = long.groupBy(label, "i").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("x")).alias("ss"))
    per = cell.groupBy("i").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("all"), F.sum("n").alias("total"), F.sqrt(F.sum("ss") / (F.sum("n") - F.count("*"))).alias("s"))
    offset = per.agg(F.percentile("s", 0.5).alias("s0"))
    scale = F.sqrt(1 / F.col("n") - 1 / F.col("total")) * (F.col("s") + F.col("s0"))
    out = cell.join(per, "i").crossJoin(F.broadcast(offset)).withColumn("d", (F.col("mean") - F.col("all")) / scale)
    less = F.signum("d") * F.greatest(F.abs("d") - threshold, F.lit(0.0))
    return out.select(label, "i", "n", "total", "mean", "d", (F.col("all") + scale * less).alias("shrunk"), (F.col("s") + F.col("s0")).alias("spread"))


def logistic(df: DataFrame, x: list[str], y: str, steps: int = 25, tol: float = 1e-10) -> np.ndarray:
    """Newton steps from zero: one aggregation each; stops when no coefficient moves by ``tol``. Returns the intercept and slopes."""
    names, beta = ["1", *x], np.zeros(len(x) + 1)
    col = [F.lit(1.0), *[F.col(c).cast("double") for c in x]]
    data = df.dropna(subset=[*x, y])
    for _ in range(steps):
        p = 1 / (1 + F.exp(-sum((float(b) * c for b, c in zip(beta, col, strict=True)), F.lit(0.0))))
        row = data.select(*x, y, p.alias("p_")).select("*", (F.col("p_") * (1 - F.col("p_"))).alias("w_"), (F.col(y) - F.col("p_")).alias("r_"))
        k = len(names)
        sums = [F.sum(F.col("w_") * col[i] * col[j]).alias(f"s_{i}_{j}") for i in range(k) for j in range(i, k)]
        got = row.agg(*sums, *[F.sum(F.col("r_") * col[i]).alias(f"g_{i}") for i in range(k)]).first()
        step = np.linalg.solve(matrix(got, k), np.array([got[f"g_{i}"] for i in range(k)]))
        beta = beta + step
        if np.abs(step).max() < tol:
            break
    return beta
