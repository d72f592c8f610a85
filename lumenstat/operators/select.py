"""Choosing and joining linear models: bumping, averaging by information weights, fused lasso. All work on summed products."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenstat.operators.linear import gram, matrix
from lumenstat.operators.resample import copies


def bumping(df: DataFrame, x: list[str], y: str, key: str, replicates: int = 50) -> tuple[np.ndarray, float, int]:
    """Least squares on each replicate and on the rows themselves (number 0); the fit with the least mean squared error on the
    rows stays. A row goes to the replicates that draw it and sums are partial: one aggregation. Coefficients, error, replicate."""
    data = df.dropna(subset=[key, *x, y]).select(key, *x, y)
    drawn = F.array(F.lit(1), *[copies(F.col(key), b) for b in range(1, replicates + 1)])
    rows = data.select(*[F.col(c) for c in [*x, y]], F.posexplode(drawn).alias("_b", "_w")).filter("_w > 0")
    k = len(x) + 1
    sums = {r["_b"]: matrix(r, k + 1) for r in gram(rows, x, y, by=["_b"], weight="_w").collect()}
    if not sums:
        return np.full(k, np.nan), float("nan"), 0
    m, best = sums[0], None
    for b in sorted(sums):
        try:
            beta = np.linalg.solve(sums[b][:k, :k], sums[b][:k, k])
        except np.linalg.LinAlgError:
            continue
        e = float(m[k, k] - 2 * beta @ m[:k, k] + beta @ m[:k, :k] @ beta) / m[0, 0]
        if best is None or e < best[1] - 1e-12:
            best = (beta, e, b)
    return best if best else (np.full(k, np.nan), float("nan"), 0)


def averaged(df: DataFrame, x: list[str], y: str, criterion: str = "aic") -> tuple[np.ndarray, list[tuple[tuple[str, ...], float, float]]]:
    """Every subset of x (at most 15) from one pass: coefficients averaged by exp(-delta / 2), intercept first, and (subset, criterion, weight) by falling weight."""
    if len(x) > 15:
        raise ValueError("subsets of at most 15 columns")
    k = len(x) + 1
    m = matrix(gram(df.dropna(subset=[*x, y]), x, y).first(), k + 1)
    n, fits = m[0, 0], []
    for size in range(k):
        for use in itertools.combinations(range(1, k), size):
            at = [0, *use]
            beta = np.zeros(k)
            beta[at] = np.linalg.lstsq(m[np.ix_(at, at)], m[at, k], rcond=None)[0]
            rss = max(float(m[k, k] - beta @ m[:k, k]), 1e-300)
            price = 2.0 if criterion == "aic" else np.log(n)
            fits.append((tuple(x[i - 1] for i in use), n * np.log(rss / n) + price * (size + 2), beta))
    score = np.array([f[1] for f in fits])
    weight = np.exp(-(score - score.min()) / 2)
    weight /= weight.sum()
    table = sorted(((f[0], float(f[1]), float(w)) for f, w in zip(fits, weight)), key=lambda r: (-r[2], r[0]))
    return sum(w * f[2] for w, f in zip(weight, fits)), table


def differences(p: int, order: int = 1) -> np.ndarray:
    return np.diff(np.eye(p), n=order, axis=0)


def fused_lasso(df: DataFrame, x: list[str], y: str, sparse: float, smooth: float, order: int = 1, rho: float = 1.0, steps: int = 5000, tol: float = 1e-8) -> np.ndarray:
    """Minimises rss / 2n + sparse |b|_1 + smooth |D b|_1 on centred columns, D the differences of neighbouring columns, by
    alternating directions. One pass over the rows; every step is on the driver, on matrices as large as the columns."""
    k = len(x)
    m = matrix(gram(df.dropna(subset=[*x, y]), x, y).first(), k + 2)
    n, s = m[0, 0], m[1:, 0]
    centred = m[1:, 1:] - np.outer(s, s) / n
    a = np.vstack([np.eye(k), differences(k, order)])
    limit = np.concatenate([np.full(k, sparse), np.full(len(a) - k, smooth)]) / rho
    inverse = np.linalg.inv(centred[:k, :k] / n + rho * a.T @ a)
    z, u = np.zeros(len(a)), np.zeros(len(a))
    for _ in range(steps):
        b = inverse @ (centred[:k, k] / n + rho * a.T @ (z - u))
        v = a @ b + u
        new = np.sign(v) * np.maximum(np.abs(v) - limit, 0)
        u = v - new
        gap, moved, z = np.abs(a @ b - new).max(), np.abs(new - z).max(), new
        if max(gap, rho * moved) < tol:
            break
    return z[:k]
