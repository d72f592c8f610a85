"""Flexible discriminants by optimal scoring: regression of scored class indicators on a basis, from one aggregation by class."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstat.operators.linear import gram, matrix
from lumenstat.operators.separate import nearest_mean


def _solve(per: dict, penalty: np.ndarray, lam: float, count: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From products by class (of 1 and the basis): squared correlations, scores of the classes, coefficients of the
    scored regressions (intercept first), and the shares of the classes."""
    names = sorted(per)
    total = sum(per[c] for c in names)
    n, sums = total[0, 0], np.array([per[c][0] for c in names])  # products of class indicators with 1 and the basis
    share = sums[:, 0] / n
    full = np.pad(penalty, ((1, 0), (1, 0))) * lam
    hat = np.linalg.pinv(total + full, rcond=1e-12, hermitian=True) @ sums.T  # regressions of the indicators
    fitted = sums @ hat / n
    root = 1 / np.sqrt(share)
    # the constant score is fitted without error: it is taken out, so that the others are centred
    m = root[:, None] * fitted * root[None]
    one = np.sqrt(share)
    m = m - np.outer(one, one)
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    top = np.argsort(values)[::-1][: count or len(names) - 1]
    scores = root[:, None] * vectors[:, top]
    return np.clip(values[top], 0.0, 1 - 1e-12), scores, hat @ scores, share


class FlexibleDiscriminant:
    """Classes told apart by the fits of their optimal scores on a basis (no constant among its columns), with a quadratic penalty.

    A linear basis gives the linear discriminants; splines, products or hinges give curved ones. Rows with nulls are left
    out. ``correlation`` has the squared correlation of each score with its fit; coordinates are scaled so that classes
    spread 1 within, and signs are set so that the greatest score is positive.
    ``times``: how many rows each row of ``df`` stands for (equal rows counted before).
    """

    def __init__(self, df: DataFrame, basis: list[Column], label: str, lam: float = 0.0, penalty: np.ndarray | None = None, count: int | None = None, times: str | None = None) -> None:
        self.basis, self.label = basis, label
        names = [f"_b{i}" for i in range(len(basis))]
        n = F.col(times) if times else F.lit(1.0)
        data = df.select(F.col(label).alias("_l"), n.cast("double").alias("_n"), *[b.cast("double").alias(n) for b, n in zip(basis, names, strict=True)]).dropna()
        per = {r["_l"]: matrix(r, len(basis) + 1) for r in gram(data, names, by=["_l"], weight="_n").collect()}
        self.penalty = np.eye(len(basis)) if penalty is None else penalty
        self._take(per, lam, count)

    def _take(self, per: dict, lam: float, count: int | None) -> None:
        self.names = sorted(per)
        self.correlation, self.scores, beta, self.share = _solve(per, self.penalty, lam, count)
        sign = np.sign(self.scores[np.abs(self.scores).argmax(0), np.arange(self.scores.shape[1])])
        self.scores, beta = self.scores * sign, beta * sign
        a = np.maximum(self.correlation, 1e-300)
        self.beta = beta / np.sqrt(a * (1 - a))  # classes spread 1 within
        total = sum(per.values())
        middle = total[0] @ self.beta / total[0, 0]
        self.beta[0] -= middle
        self.means = np.array([per[c][0] @ self.beta / per[c][0, 0] for c in self.names])

    def coordinates(self) -> list[Column]:
        return [sum((float(v) * c for v, c in zip(self.beta[1:, k], self.basis, strict=True)), F.lit(float(self.beta[0, k]))) for k in range(self.beta.shape[1])]

    def _distances(self) -> list[Column]:
        """Half the squared distance to each class mean less the log of its share, where coordinates weigh alike."""
        z = self.coordinates()
        return [0.5 * sum(((c - float(v)) * (c - float(v)) for c, v in zip(z, m, strict=True)), F.lit(0.0)) - float(np.log(s)) for m, s in zip(self.means, self.share, strict=True)]

    def predict(self) -> Column:
        """The class of greatest posterior, the first at ties."""
        d = self._distances()
        least, out = F.least(*d), F.lit(self.names[-1])
        for k in reversed(range(len(d) - 1)):
            out = F.when(d[k] <= least, F.lit(self.names[k])).otherwise(out)
        return out

    def nearest(self) -> Column:
        """The class whose mean is nearest, whatever its share."""
        return nearest_mean(self.coordinates(), self.names, self.means)

    def posterior(self) -> list[Column]:
        d = self._distances()
        least = F.least(*d)
        e = [F.exp(least - v) for v in d]
        return [v / sum(e[1:], e[0]) for v in e]


def flexible_cv(df: DataFrame, basis: list[Column], label: str, fold: Column, penalties: list[float], penalty: np.ndarray | None = None, count: int | None = None) -> list[tuple[float, int, int]]:
    """(penalty, rows, rows wrong) over folds: one aggregation by fold and class gives all fits, one more all errors."""
    names = [f"_b{i}" for i in range(len(basis))]
    data = df.select(F.col(label).alias("_l"), fold.alias("_f"), *[b.cast("double").alias(n) for b, n in zip(basis, names, strict=True)]).dropna()
    per = {(r["_f"], r["_l"]): matrix(r, len(basis) + 1) for r in gram(data, names, by=["_f", "_l"]).collect()}
    folds, classes = sorted({f for f, _ in per}), sorted({c for _, c in per})
    wrong = {lam: F.lit(0) for lam in penalties}
    for f in folds:
        rest = {c: sum(m for (g, k), m in per.items() if g != f and k == c) for c in classes if any(g != f and k == c for g, k in per)}
        for lam in penalties:
            fit = FlexibleDiscriminant.__new__(FlexibleDiscriminant)
            fit.basis, fit.label, fit.penalty = [F.col(n) for n in names], "_l", np.eye(len(basis)) if penalty is None else penalty
            fit._take(rest, lam, count)
            wrong[lam] = F.when(F.col("_f") == f, F.when(fit.predict() == F.col("_l"), 0).otherwise(1)).otherwise(wrong[lam])
    row = data.agg(F.count("*").alias("n"), *[F.sum(w).alias(f"w{i}") for i, w in enumerate(wrong.values())]).first()
    return [(float(lam), int(row["n"]), int(row[f"w{i}"] or 0)) for i, lam in enumerate(penalties)]
