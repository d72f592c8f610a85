"""Additive models with row weights, logistic additive models by local scoring, and their penalty by folds.

All turns of backfitting run on summed products: the rows are read once for a weighted fit, and once for each Newton
step of a logistic one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstat.operators.linear import gram, matrix
from lumenstat.operators.splines import additive_predict, difference_penalty
from lumenstat.operators.steps import with_numbers
from lumenstat.operators.validate import Row, path_cv, path_errors, quadratic


def block_penalty(sizes: list[int], order: int = 2) -> np.ndarray:
    """Difference penalties of several smooths along the diagonal; a smooth of one column has none."""
    out, at = np.zeros((sum(sizes), sum(sizes))), 0
    for p in sizes:
        if p > order:
            out[at : at + p, at : at + p] = difference_penalty(p, order)
        at += p
    return out


def turns(centred: np.ndarray, sizes: list[int], lam: float, sweeps: int, tol: float, ridge: float = 1e-8) -> np.ndarray:
    """Coefficients by backfitting on centred products of all basis columns and, last, the response."""
    cut = np.concatenate([[0], np.cumsum(sizes)])
    pen = block_penalty(sizes)
    spans = list(zip(cut[:-1], cut[1:], strict=True))
    solve = [np.linalg.inv(centred[a:b, a:b] + lam * pen[a:b, a:b] + ridge * np.eye(b - a)) for a, b in spans]
    beta = np.zeros(cut[-1])
    for _ in range(sweeps):
        moved = 0.0
        for s, (a, b) in zip(solve, spans, strict=True):
            new = s @ (centred[a:b, -1] - centred[a:b, :-1] @ beta + centred[a:b, a:b] @ beta[a:b])
            moved, beta[a:b] = max(moved, float(np.abs(new - beta[a:b]).max())), new
        if moved < tol:
            break
    return beta


def _wide(df: DataFrame, groups: list[list[Column]], more: dict[str, Column]) -> tuple[DataFrame, list[str]]:
    flat = [c for g in groups for c in g]
    names = [f"_b{i}" for i in range(len(flat))]
    return df.select(*[c.cast("double").alias(n) for n, c in more.items()], *[b.alias(n) for b, n in zip(flat, names, strict=True)]).dropna(), names


class WeightedAdditive:
    """Additive least squares with a weight a row: each smooth has weighted mean 0. Rows with nulls, or of weight 0, say nothing."""

    def __init__(self, df: DataFrame, groups: list[list[Column]], y: Column, weight: Column, lam: float, sweeps: int = 2000, tol: float = 1e-11) -> None:
        self.groups, self.sizes = groups, [len(g) for g in groups]
        data, names = _wide(df, groups, {"_y": y, "_w": weight})
        m = matrix(gram(data, names, "_y", weight="_w").first(), len(names) + 2)
        self.total, mean = m[0, 0], m[0, 1:] / m[0, 0]
        centred = m[1:, 1:] - self.total * np.outer(mean, mean)
        beta = turns(centred, self.sizes, lam, sweeps, tol)
        self.mean = float(mean[-1] - beta @ mean[:-1])
        self.rss = float(centred[-1, -1] - 2 * beta @ centred[:-1, -1] + beta @ centred[:-1, :-1] @ beta)
        cut = np.cumsum(self.sizes)[:-1]
        self.beta, self.offsets = np.split(beta, cut), [float(b @ c) for b, c in zip(np.split(beta, cut), np.split(mean[:-1], cut), strict=True)]
        self.intercept = float(mean[-1])

    def predict(self) -> Column:
        return additive_predict(self.mean, self.groups, self.beta)

    def smooths(self) -> list[Column]:
        """Each smooth on its own, of weighted mean 0: the model is their sum plus ``intercept``."""
        return [sum((float(v) * c for v, c in zip(b, g, strict=True)), F.lit(-off)) for b, g, off in zip(self.beta, self.groups, self.offsets, strict=True)]

    def partial_residuals(self, y: Column) -> list[Column]:
        """What each smooth is fitted to: the residual with the smooth added back."""
        return [y - self.predict() + s for s in self.smooths()]


class LogisticAdditive:
    """Logistic additive model: each Newton step gives a working response and weight, which a weighted backfitting fits.

    One aggregation a step holds the products and the deviance of the present fit. A step that would raise the penalised
    deviance is halved. ``path`` has the deviance before each step and at the end; 0/1 responses, rows with nulls left out.
    ``count``: how many rows each row of ``df`` stands for (equal rows counted before, kept for all steps).
    """

    def __init__(self, df: DataFrame, groups: list[list[Column]], y: str, lam: float, steps: int = 25, sweeps: int = 2000, tol: float = 1e-8, least: float = 1e-6, count: str | None = None) -> None:
        self.groups, self.sizes, k = groups, [len(g) for g in groups], sum(len(g) for g in groups)
        data, names = _wide(df, groups, {"_y": F.col(y), "_n": F.col(count) if count else F.lit(1.0)})
        data = data.persist() if count else data
        pen = lam * block_penalty(self.sizes) + 1e-8 * np.eye(k)
        first = data.agg(F.coalesce(F.sum("_n"), F.lit(0.0)).cast("long").alias("n"), (F.sum(F.col("_n") * F.col("_y")) / F.sum("_n")).alias("p")).first()
        self.n = first["n"]
        rate = min(max(first["p"] or 0.0, 1e-6), 1 - 1e-6)
        self.null_deviance = -2 * self.n * (rate * np.log(rate) + (1 - rate) * np.log(1 - rate)) if self.n else 0.0
        now, self.path, best, move = np.concatenate([[np.log(rate / (1 - rate))], np.zeros(k)]), [], np.inf, None
        for _ in range(steps if self.n else 0):
            eta = sum((F.col("_p")[i + 1] * F.col(c) for i, c in enumerate(names)), F.col("_p")[0])
            p = 1 / (1 + F.exp(-F.greatest(F.least(eta, F.lit(700.0)), F.lit(-700.0))))
            # log(1 + exp(eta)) without overflow
            soft = F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))
            step = with_numbers(data, now).withColumns({"_eta": eta, "_q": p, "_loss": F.col("_n") * 2 * (soft - F.col("_y") * eta)})
            step = step.withColumn("_w", F.greatest(F.col("_q") * (1 - F.col("_q")), F.lit(least)))
            step = step.withColumn("_z", F.col("_eta") + (F.col("_y") - F.col("_q")) / F.col("_w"))
            step = step.withColumn("_w", F.col("_n") * F.col("_w"))
            row = step.agg(*_products(names, "_z", "_w"), F.sum("_loss").alias("deviance")).first()
            value = row["deviance"] + now[1:] @ pen @ now[1:]
            if value > best + 1e-9 * abs(best) and np.abs(move).max() > tol:
                move = move / 2
                now = before + move
                continue
            self.path.append(float(row["deviance"]))
            if best - value < tol * abs(value):
                break
            best, before = value, now
            m = matrix(row, k + 2)
            mean = m[0, 1:] / m[0, 0]
            centred = m[1:, 1:] - m[0, 0] * np.outer(mean, mean)
            beta = turns(centred, self.sizes, lam, sweeps, 1e-11)
            new = np.concatenate([[mean[-1] - beta @ mean[:-1]], beta])
            move = new - now
            now = new
        if count:
            data.unpersist()
        self.mean, self.beta = float(now[0]), np.split(now[1:], np.cumsum(self.sizes)[:-1])
        self.deviance = self.path[-1] if self.path else 0.0

    def link(self) -> Column:
        return additive_predict(self.mean, self.groups, self.beta)

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-F.greatest(F.least(self.link(), F.lit(700.0)), F.lit(-700.0))))


def _products(x: list[str], y: str, weight: str) -> list[Column]:
    """The sums of ``gram`` as columns, to be taken with others in one aggregation."""
    w, cols = F.col(weight), [F.lit(1.0), *[F.col(c) for c in x], F.col(y)]
    return [F.sum(w * cols[i] * cols[j]).alias(f"s_{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]


def additive_cv(df: DataFrame, groups: list[list[Column]], y: str, fold: Column, penalties: list[float], same: list[str] | None = None) -> list[Row]:
    """(penalty, mean squared error, standard error) over folds: the additive fit of each fold's training rows, from one aggregation by fold.

    ``same``: the columns that ``groups`` are made of, where they take few values. Rows equal in these and in the fold are then
    summed first (how many, responses, squares), and the basis is evaluated once for each; the products are those of the rows.
    """
    fit = quadratic(block_penalty([len(g) for g in groups]))
    if same is None:
        data, names = _wide(df, groups, {"_y": F.col(y), "_fold": fold})
        return path_cv(data, names, "_y", "_fold", penalties, fit, scale=False)
    rows = df.select(*same, F.col(y).cast("double").alias("_y"), fold.alias("_fold")).dropna(subset=["_y", "_fold"])
    sums = rows.groupBy(*same, "_fold").agg(F.count("*").alias("_n"), F.sum("_y").alias("_y"), F.sum(F.col("_y") * F.col("_y")).alias("_yy"))
    data, names = _wide(sums, groups, {"_n": F.col("_n"), "_y": F.col("_y"), "_yy": F.col("_yy"), "_fold": F.col("_fold")})
    cols, last = [F.lit(1.0), *[F.col(c) for c in names]], len(names) + 1
    inner = [F.sum(F.col("_n") * cols[i] * cols[j]).alias(f"s_{i}_{j}") for i in range(last) for j in range(i, last)]
    outer = [F.sum(F.col("_y") * c).alias(f"s_{i}_{last}") for i, c in enumerate(cols)]
    per = {r["_fold"]: matrix(r, last + 1) for r in data.groupBy("_fold").agg(*inner, *outer, F.sum("_yy").alias(f"s_{last}_{last}")).collect()}
    return path_errors(per, len(names), penalties, fit, scale=False)
