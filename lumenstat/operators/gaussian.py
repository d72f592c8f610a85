"""Gaussian mixtures of several variables: densities as columns, one aggregation a step of expectation-maximisation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_density(cols: list[Column], mean: np.ndarray, cov: np.ndarray) -> Column:
    """Log of the normal density: the squares of the rows of the inverse Cholesky factor on the centred columns."""
    inverse = np.linalg.inv(np.linalg.cholesky(cov))
    z = [c - float(m) for c, m in zip(cols, mean, strict=True)]
    parts = [F.pow(sum((float(inverse[i, j]) * z[j] for j in range(i + 1)), F.lit(0.0)), F.lit(2)) for i in range(len(z))]
    return -0.5 * sum(parts, F.lit(0.0)) + (float(np.log(np.diag(inverse)).sum()) - 0.5 * len(z) * math.log(2 * math.pi))


class Mixture:
    """weights (K), means (K, p), covariances (K, p, p) over the columns ``x``; rows with nulls take no part in fits."""

    def __init__(self, x: list[str], weights: np.ndarray, means: np.ndarray, covariances: np.ndarray) -> None:
        self.x, self.weights, self.means, self.covariances = x, np.asarray(weights, float), np.asarray(means, float), np.asarray(covariances, float)

    def _logs(self) -> list[Column]:
        cols = [F.col(c).cast("double") for c in self.x]
        return [log_density(cols, m, c) + math.log(max(w, 1e-300)) for w, m, c in zip(self.weights, self.means, self.covariances, strict=True)]

    def log_likelihood(self) -> Column:
        """Of each row, by the largest term, so that nothing underflows."""
        logs = self._logs()
        top = F.greatest(*logs) if len(logs) > 1 else logs[0]
        return top + F.log(sum((F.exp(v - top) for v in logs), F.lit(0.0)))

    def responsibilities(self) -> list[Column]:
        total = self.log_likelihood()
        return [F.exp(v - total) for v in self._logs()]

    def step(self, df: DataFrame, least: float = 1e-6) -> float:
        """One step on ``df``; returns the log likelihood before it. ``least`` is added to each variance."""
        data, p = df.dropna(subset=self.x), len(self.x)
        share = self.responsibilities()
        sums = [F.sum(self.log_likelihood()).alias("ll"), F.count("*").alias("n")]
        for k, r in enumerate(share):
            z = [F.col(c).cast("double") - float(m) for c, m in zip(self.x, self.means[k], strict=True)]  # centred at the present mean
            sums += [F.sum(r).alias(f"w{k}"), *[F.sum(r * z[i]).alias(f"a{k}_{i}") for i in range(p)], *[F.sum(r * z[i] * z[j]).alias(f"s{k}_{i}_{j}") for i in range(p) for j in range(i, p)]]
        row = data.agg(*sums).first()
        for k in range(len(share)):
            w = row[f"w{k}"]
            if not w or w < 1e-9:  # nothing is near it: it stays
                continue
            a = np.array([row[f"a{k}_{i}"] for i in range(p)]) / w
            s = np.array([[row[f"s{k}_{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) / w
            self.means[k] = self.means[k] + a
            self.covariances[k] = s - np.outer(a, a) + least * np.eye(p)
            self.weights[k] = w / row["n"]
        return row["ll"]

    def fit(self, df: DataFrame, steps: int = 100, tol: float = 1e-6) -> float:
        """Steps until the log likelihood changes by less than ``tol`` of itself; returns the last."""
        before = None
        for _ in range(steps):
            now = self.step(df)
            if before is not None and abs(now - before) < tol * (abs(before) + 1e-12):
                break
            before = now
        return now

    def parameters(self) -> int:
        k, p = self.means.shape
        return k - 1 + k * p + k * p * (p + 1) // 2

    def criteria(self, df: DataFrame) -> DataFrame:
        """n, log_likelihood, parameters, aic, bic."""
        q = self.parameters()
        row = df.dropna(subset=self.x).agg(F.count("*").alias("n"), F.sum(self.log_likelihood()).alias("log_likelihood"))
        ll = F.col("log_likelihood")
        return row.select("n", "log_likelihood", F.lit(q).cast("long").alias("parameters"), (-2 * ll + 2 * q).alias("aic"), (-2 * ll + q * F.log("n")).alias("bic"))

    def with_clusters(self, df: DataFrame) -> DataFrame:
        """Adds cluster (the first at ties), confidence, entropy of the shares, and that entropy over its greatest value."""
        share = F.array(*self.responsibilities())
        top = F.array_max(share)
        entropy = -F.aggregate(share, F.lit(0.0), lambda s, r: s + F.when(r > 0, r * F.log(r)).otherwise(0.0))
        k = len(self.weights)
        return df.withColumns({"cluster": (F.array_position(share, top) - 1).cast("int"), "confidence": top, "entropy": entropy, "normalised_entropy": entropy / math.log(k) if k > 1 else F.lit(0.0)})

    def ellipse(self, k: int, level: float = 0.95, points: int = 64) -> np.ndarray:
        """Outline of a component of two variables that holds ``level`` of it."""
        angle = np.linspace(0, 2 * np.pi, points)
        radius = math.sqrt(-2 * math.log(1 - level))
        return self.means[k] + radius * np.stack([np.cos(angle), np.sin(angle)], 1) @ np.linalg.cholesky(self.covariances[k]).T


def started(df: DataFrame, x: list[str], k: int, seed: int = 1) -> Mixture:
    """Start at ``k`` rows taken by hash, with the covariance of all rows."""
    data = df.dropna(subset=x)
    rows = data.select(*[F.col(c).cast("double").alias(c) for c in x]).distinct().orderBy(F.xxhash64(*x, F.lit(seed)), *x).limit(k).collect()
    pairs = [(a, b) for i, a in enumerate(x) for b in x[i:]]
    got = data.agg(*[F.covar_pop(a, b).alias(f"{a}|{b}") for a, b in pairs]).first()
    cov = np.array([[got[f"{a}|{b}"] if f"{a}|{b}" in got.asDict() else got[f"{b}|{a}"] for b in x] for a in x])
    return Mixture(x, np.full(len(rows), 1 / len(rows)), np.array([list(r) for r in rows]), np.repeat((cov + 1e-6 * np.eye(len(x)))[None], len(rows), 0))


def multistart(df: DataFrame, x: list[str], k: int, starts: int = 3, steps: int = 50) -> tuple[Mixture, float]:
    """The fit of greatest likelihood over several starts."""
    fits = [(m, m.fit(df, steps)) for m in (started(df, x, k, s) for s in range(1, starts + 1))]
    return max(fits, key=lambda f: f[1])
