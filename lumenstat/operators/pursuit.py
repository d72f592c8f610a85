"""Search for interesting projections by the gradient of an index, one direction after another, each at right angles to those before.

Columns are whitened by one pass of products. The index of a direction and its gradient are averages over the rows: one
aggregation gives both for all starts, one more gives the index along each start's line on the sphere.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstat.operators.linear import gram, matrix
from lumenstat.operators.order import permuted
from lumenstat.operators.signals import log_cosh
from lumenstat.operators.steps import with_numbers

#: Mean of log cosh of a standard normal variable.
NORMAL_LOG_COSH = 0.3745672075

#: Index by name: g, g', and the value and outer derivative from the mean of g.
INDICES: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column], Callable[[float], float], Callable[[float], float]]] = {
    "kurtosis": (lambda p: F.pow(p, F.lit(4)), lambda p: 4 * F.pow(p, F.lit(3)), lambda m: abs(m - 3), lambda m: float(np.sign(m - 3))),
    "skewness": (lambda p: F.pow(p, F.lit(3)), lambda p: 3 * p * p, abs, lambda m: float(np.sign(m))),
    "negentropy": (log_cosh, F.tanh, lambda m: (m - NORMAL_LOG_COSH) ** 2, lambda m: 2 * (m - NORMAL_LOG_COSH)),
}
STEPS = (2.0, 1.0, 0.5, 0.25, 0.1, 0.03, 0.01)  # angles tried along a line on the sphere


def whitening(df: DataFrame, x: list[str], least: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and the matrix (rows: white columns) that gives centred columns variance 1 and no correlation."""
    m = matrix(gram(df.dropna(subset=x), x).first(), len(x) + 1)
    mean = m[0, 1:] / m[0, 0]
    value, vector = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))
    keep = value > least * value.max()
    return mean, (vector[:, keep] / np.sqrt(value[keep])).T[::-1]


def _dot(d: int, z: list[str]) -> Column:
    """Direction ``d`` of those that each row carries as one array."""
    return sum((F.col("_p")[d * len(z) + i] * F.col(c) for i, c in enumerate(z)), F.lit(0.0))


def index_and_gradient(white: DataFrame, z: list[str], directions: list[np.ndarray], index: str) -> list[tuple[float, np.ndarray]]:
    """Of each direction of white columns: its index and the gradient of the index in the direction. One aggregation."""
    g, slope, value, outer = INDICES[index]
    sums = []
    for d in range(len(directions)):
        p = _dot(d, z)
        sums += [F.avg(g(p)).alias(f"g{d}")] + [F.avg(slope(p) * F.col(c)).alias(f"s{d}_{i}") for i, c in enumerate(z)]
    row = with_numbers(white, np.concatenate(directions)).agg(*sums).first()
    return [(value(row[f"g{d}"]), outer(row[f"g{d}"]) * np.array([row[f"s{d}_{i}"] for i in range(len(z))])) for d in range(len(directions))]


def indices(white: DataFrame, z: list[str], directions: list[np.ndarray], index: str) -> list[float]:
    g, _, value, _ = INDICES[index]
    row = with_numbers(white, np.concatenate(directions)).agg(*[F.avg(g(_dot(d, z))).alias(f"g{d}") for d in range(len(directions))]).first()
    return [value(v) for v in row]


def orthogonal(w: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    """``w`` without its parts along ``found`` (orthonormal), of length one."""
    for f in found:
        w = w - (w @ f) * f
    n = np.linalg.norm(w)
    return w / n if n > 1e-12 else w * 0


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Absolute cosine: 1 for one line, whatever its sign."""
    return float(abs(np.dot(a, b)) / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-300))


class ProjectionSearch:
    """``count`` directions, each the best of ``starts`` searches at right angles to those before it.

    ``directions`` are of the centred columns (unit length, greatest entry positive), ``white`` of the whitened ones;
    ``values`` their indices, ``paths`` the index of the winning search by step, which never falls. Rows with nulls are left out.
    """

    def __init__(self, df: DataFrame, x: list[str], index: str = "negentropy", count: int = 1, starts: int = 4, steps: int = 30, tol: float = 1e-7, seed: int = 1) -> None:
        self.x, self.index = x, index
        self.mean, self.map = whitening(df, x)
        z, rng = [f"_z{i}" for i in range(len(self.map))], np.random.default_rng(seed)
        white = self.whitened(df)
        self.white: list[np.ndarray] = []
        self.values: list[float] = []
        self.paths: list[list[float]] = []
        for _ in range(min(count, len(z))):
            at = [orthogonal(rng.normal(size=len(z)), self.white) for _ in range(starts)]
            path: list[list[float]] = [[] for _ in at]
            going = set(range(len(at)))
            for _ in range(steps):
                live = sorted(going)
                known = index_and_gradient(white, z, [at[s] for s in live], index)
                lines = []
                for s, (value, g) in zip(live, known, strict=True):
                    path[s].append(value)
                    g = g - sum((g @ f) * f for f in self.white)
                    g = g - (g @ at[s]) * at[s]  # along the sphere
                    n = np.linalg.norm(g)
                    if n < 1e-12:
                        going.discard(s)
                    else:
                        lines += [(s, value, np.cos(t) * at[s] + np.sin(t) * g / n) for t in STEPS]
                if not lines:
                    break
                tried = indices(white, z, [w for _, _, w in lines], index)
                for s in {s for s, _, _ in lines}:
                    best, now, w = max(((v, n, w) for v, (k, n, w) in zip(tried, lines, strict=True) if k == s), key=lambda b: b[0])
                    if best <= now + tol * max(abs(now), 1e-3):
                        going.discard(s)
                    if best > now:
                        at[s] = orthogonal(w, self.white)
                if not going:
                    break
            final = indices(white, z, at, index)
            best = int(np.argmax(final))
            self.white.append(at[best])
            self.values.append(final[best])
            self.paths.append([*path[best], final[best]])
        self.directions = [self._oriented(w @ self.map) for w in self.white]

    @staticmethod
    def _oriented(d: np.ndarray) -> np.ndarray:
        d = d / np.linalg.norm(d)
        return d * (np.sign(d[np.argmax(np.abs(d))]) or 1.0)

    def whitened(self, df: DataFrame) -> DataFrame:
        centred = [F.col(c).cast("double") - float(m) for c, m in zip(self.x, self.mean, strict=True)]
        return df.dropna(subset=self.x).select(*[sum((float(v) * c for v, c in zip(row, centred, strict=True)), F.lit(0.0)).alias(f"_z{i}") for i, row in enumerate(self.map)])

    def scores(self) -> list[Column]:
        """Each row along each direction, of variance 1."""
        centred = [F.col(c).cast("double") - float(m) for c, m in zip(self.x, self.mean, strict=True)]
        return [sum((float(v) * c for v, c in zip(w @ self.map, centred, strict=True)), F.lit(0.0)) for w in self.white]


def null_indices(df: DataFrame, x: list[str], key: str, index: str = "negentropy", draws: int = 5, **search) -> list[float]:
    """Best index of tables whose columns are dealt anew one by one (``key``: a unique integer): what chance finds without structure
    across columns."""
    out = []
    for s in range(1, draws + 1):
        mixed = df.dropna(subset=x).select(key, *x)
        for i, c in enumerate(x[1:]):
            mixed = permuted(mixed, c, key, seed=100 * s + i)
        out.append(ProjectionSearch(mixed, x, index, 1, **search).values[0])
    return out
