"""Projections: independent and sparse components, kernel components and spectral maps over landmarks, classical scaling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstat.operators.linear import gram, matrix


def _linear(x: list[str], w: np.ndarray, mean: np.ndarray) -> Column:
    return sum((float(v) * (F.col(c) - float(m)) for v, c, m in zip(w, x, mean, strict=True)), F.lit(0.0))


def _moments(df: DataFrame, x: list[str]) -> tuple[float, np.ndarray, np.ndarray]:
    m = matrix(gram(df.dropna(subset=x), x).first(), len(x) + 1)
    mean = m[0, 1:] / m[0, 0]
    return m[0, 0], mean, m[1:, 1:] / m[0, 0] - np.outer(mean, mean)


def independent(df: DataFrame, x: list[str], k: int, steps: int = 100, tol: float = 1e-7, seed: int = 1) -> tuple[np.ndarray, list[Column]]:
    """Independent components by the symmetric fixed point with tanh on whitened columns, one aggregation a step: the unmixing matrix for centred x, and its columns."""
    _, mean, cov = _moments(df, x)
    value, vector = np.linalg.eigh(cov)
    keep = np.argsort(value)[::-1][:k]
    white = (vector[:, keep] / np.sqrt(value[keep])).T

    def unit(w: np.ndarray) -> np.ndarray:
        u, _, v = np.linalg.svd(w)
        return u @ v

    w = unit(np.random.default_rng(seed).normal(size=(k, k)))
    data = df.dropna(subset=x).select(*[_linear(x, row, mean).alias(f"z{i}") for i, row in enumerate(white)])
    for _ in range(steps):
        g = [F.tanh(sum((float(v) * F.col(f"z{i}") for i, v in enumerate(row)), F.lit(0.0))) for row in w]
        got = data.agg(*[F.avg(F.col(f"z{i}") * g[j]).alias(f"a{j}_{i}") for j in range(k) for i in range(k)], *[F.avg(1 - g[j] * g[j]).alias(f"d{j}") for j in range(k)]).first()
        new = unit(np.array([[got[f"a{j}_{i}"] - got[f"d{j}"] * w[j, i] for i in range(k)] for j in range(k)]))
        still = np.abs(np.abs((new * w).sum(1)) - 1).max() < tol
        w = new
        if still:
            break
    out = w @ white
    return out, [_linear(x, row, mean) for row in out]


def sparse_components(df: DataFrame, x: list[str], k: int, penalty: float, steps: int = 500) -> np.ndarray:
    """Rows of unit length with zeros: soft-thresholded power steps on the covariance, which is then deflated. One pass over the rows."""
    _, _, cov = _moments(df, x)
    out = []
    for _ in range(k):
        v = np.linalg.eigh(cov)[1][:, -1]
        for _ in range(steps):
            u = cov @ v
            u = np.sign(u) * np.maximum(np.abs(u) - penalty, 0)
            if not u.any():
                v = u
                break
            u /= np.linalg.norm(u)
            still, v = np.abs(u - v).max() < 1e-12, u
            if still:
                break
        v = v if v.sum() >= 0 else -v
        out.append(v)
        left = np.eye(len(x)) - np.outer(v, v)
        cov = left @ cov @ left
    return np.array(out)


def _kernel(x: list[str], at: list[list[float]], gamma: float) -> list[Column]:
    return [F.exp(-gamma * sum((F.pow(F.col(c) - float(v), F.lit(2)) for c, v in zip(x, row, strict=True)), F.lit(0.0))) for row in at]


def kernel_map(df: DataFrame, x: list[str], landmarks: list[list[float]], gamma: float, k: int, normal: bool = False) -> tuple[np.ndarray, list[Column]]:
    """First k eigenvalues (of the mean product) and columns of radial kernel components through landmarks; exact where the landmarks are
    the distinct rows. With ``normal`` rows are divided by the root of their degree and not centred: the map of spectral clustering.
    Two aggregations as wide as the landmarks, whose number the caller sets; no table of all pairs."""
    own = np.array(landmarks, float)
    base = np.exp(-gamma * ((own[:, None] - own[None]) ** 2).sum(-1))
    value, vector = np.linalg.eigh(base)
    keep = value > 1e-10 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    data = df.dropna(subset=x).select(F.array(*_kernel(x, landmarks, gamma)).alias("k"))
    names = [f"f{i}" for i in range(root.shape[1])]

    def feature(i: int, source: list[Column]) -> Column:
        return sum((float(v) * c for v, c in zip(root[:, i], source, strict=True)), F.lit(0.0))

    from_array = [F.col("k")[j] for j in range(len(own))]
    rows = data.select(*[feature(i, from_array).alias(n) for i, n in enumerate(names)])
    total = rows.agg(F.count("*").alias("n"), *[F.sum(n).alias(n) for n in names]).first()
    mean = np.array([total[n] for n in names]) / total["n"]
    raw = [feature(i, _kernel(x, landmarks, gamma)) for i in range(len(names))]
    if normal:
        weight = 1 / F.sqrt(F.greatest(sum((float(m) * F.col(n) for m, n in zip(mean, names, strict=True)), F.lit(0.0)), F.lit(1e-300)))
        own_weight = 1 / F.sqrt(F.greatest(sum((float(m) * c for m, c in zip(mean, raw, strict=True)), F.lit(0.0)), F.lit(1e-300)))
        m = matrix(gram(rows.select(*[(F.col(n) * weight).alias(n) for n in names]), names).first(), len(names) + 1)
        second, centre, raw = m[1:, 1:] / m[0, 0], np.zeros(len(names)), [c * own_weight for c in raw]
    else:
        m = matrix(gram(rows, names).first(), len(names) + 1)
        second, centre = m[1:, 1:] / m[0, 0] - np.outer(mean, mean), mean
    value, vector = np.linalg.eigh(second)
    at = np.argsort(value)[::-1][:k]
    return value[at], [sum((float(v) * (c - float(z)) for v, c, z in zip(vector[:, i], raw, centre, strict=True)), F.lit(0.0)) for i in at]


def classical_scaling(distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Points whose distances are as given, and the eigenvalues: for a matrix over few objects, on the driver."""
    n = len(distance)
    left = np.eye(n) - 1 / n
    value, vector = np.linalg.eigh(-0.5 * left @ np.asarray(distance, float) ** 2 @ left)
    at = np.argsort(value)[::-1][:k]
    return vector[:, at] * np.sqrt(np.maximum(value[at], 0)), value[at]


class KernelComponents:
    """Radial kernel components fitted on one table and applied to any other with the same columns: new rows meet the landmarks, and are
    centred by the means of the rows of the fit. ``values``: the first k eigenvalues, of the mean product."""

    def __init__(self, df: DataFrame, x: list[str], landmarks: list[list[float]], gamma: float, k: int) -> None:
        self.x, self.landmarks, self.gamma = x, landmarks, gamma
        self.values, self.columns = kernel_map(df, x, landmarks, gamma, k)

    def scores(self, rows: DataFrame, prefix: str = "k") -> DataFrame:
        """``rows`` with a column for each component; null where an x is null."""
        return rows.withColumns({f"{prefix}{i + 1}": c for i, c in enumerate(self.columns)})


class Centred:
    """Principal components of centred columns that can be turned back: scores, reconstruction from the first of them, and what it loses."""

    def __init__(self, df: DataFrame, x: list[str], k: int) -> None:
        self.x = x
        _, self.mean, cov = _moments(df, x)
        value, vector = np.linalg.eigh(cov)
        self.axes = vector[:, ::-1][:, :k]
        self.axes = self.axes * np.sign(self.axes[np.abs(self.axes).argmax(0), np.arange(self.axes.shape[1])])
        self.variance, self.total = value[::-1][:k], float(value.sum())

    def scores(self) -> list[Column]:
        return [_linear(self.x, a, self.mean) for a in self.axes.T]

    def rebuilt(self, scores: list[Column] | None = None) -> list[Column]:
        """The columns from the scores: those of the row itself, or any others given."""
        s = scores or self.scores()
        return [sum((float(a) * c for a, c in zip(row, s, strict=True)), F.lit(float(m))) for row, m in zip(self.axes, self.mean, strict=True)]

    def loss(self) -> Column:
        """Squared distance of a row from its reconstruction."""
        return sum((F.pow(F.col(c) - r, F.lit(2)) for c, r in zip(self.x, self.rebuilt(), strict=True)), F.lit(0.0))
