"""Local polynomial fits at stated points, with fixed or nearest-share bandwidths and structured distances; mixtures of experts; projection pursuit."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstat.functions import epanechnikov, gaussian, tricube
from lumenstat.operators.inference import Logistic
from lumenstat.operators.linear import gram, matrix
from lumenstat.operators.signals import projection
from lumenstat.operators.splines import PenalizedFit, bspline, difference_penalty

KERNELS = {"epanechnikov": epanechnikov, "tricube": tricube, "gaussian": gaussian}
#: Most points at which fits are asked for at once: they are sent to every partition.
MOST_GRID = 2_000


def structured_distance(x: list[Column], at: list[Column], shape: np.ndarray) -> Column:
    """Root of the quadratic form of the differences in a symmetric matrix: identity for plain distance, zeros to leave a variable out."""
    d = [a - b for a, b in zip(x, at, strict=True)]
    total = sum((float(shape[i, j]) * d[i] * d[j] for i in range(len(d)) for j in range(len(d)) if shape[i, j]), F.lit(0.0))
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def local_polynomial(df: DataFrame, x: list[str], y: str, grid: list[list[float]], bandwidth: float | list[float], degree: int = 1, kernel: str = "tricube", shape: np.ndarray | None = None, ridge: float = 1e-10) -> list[tuple[int, float, float]]:
    """(point number, fit, weight of all rows) at each point of ``grid``: a weighted fit of all products up to ``degree``, centred at the point.

    One aggregation: each row meets the points whose kernel reaches it, and sums by point are partial. A list of bandwidths gives one to each point.
    """
    if len(grid) > MOST_GRID:
        raise ValueError(f"{len(grid)} points: ask at most {MOST_GRID} at once")
    spark, p = df.sparkSession, len(x)
    widths = bandwidth if isinstance(bandwidth, list) else [bandwidth] * len(grid)
    at = spark.createDataFrame([(i, float(h), *map(float, g)) for i, (g, h) in enumerate(zip(grid, widths, strict=True))], "_i long, _h double, " + ", ".join(f"_g{k} double" for k in range(p)))
    data = df.dropna(subset=[*x, y]).select(F.col(y).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(x)])
    dist = structured_distance([F.col(f"_x{k}") for k in range(p)], [F.col(f"_g{k}") for k in range(p)], np.eye(p) if shape is None else shape)
    rows = data.crossJoin(F.broadcast(at)).withColumn("_w", KERNELS[kernel](dist / F.col("_h"))).filter("_w > 0")
    powers = [c for d in range(1, degree + 1) for c in itertools.combinations_with_replacement(range(p), d)]
    cols = []
    for c in powers:
        out = F.lit(1.0)
        for k in c:
            out = out * (F.col(f"_x{k}") - F.col(f"_g{k}"))
        cols.append(out)
    names = [f"_t{i}" for i in range(len(cols))]
    sums = gram(rows.select("_i", "_w", "_y", *[c.alias(n) for c, n in zip(cols, names, strict=True)]), names, "_y", by=["_i"], weight="_w").collect()
    found = {}
    for r in sums:
        m = matrix(r, len(names) + 2)
        a = m[:-1, :-1] + ridge * np.trace(m[:-1, :-1]) * np.eye(len(names) + 1)
        found[r["_i"]] = (float(np.linalg.lstsq(a, m[:-1, -1], rcond=None)[0][0]), float(m[0, 0]))
    return [(i, *found.get(i, (math.nan, 0.0))) for i in range(len(grid))]


def nearest_share(df: DataFrame, x: str, grid: list[float], share: float) -> list[float]:
    """The distance at each point within which a share of the rows lies: by counts of distinct values, of which the column should have few."""
    counts = sorted((float(r[0]), r[1]) for r in df.dropna(subset=[x]).groupBy(F.col(x).cast("double")).agg(F.count("*")).collect())
    v, n = np.array([c[0] for c in counts]), np.array([c[1] for c in counts])
    need = max(1, math.ceil(share * n.sum()))
    out = []
    for g in grid:
        order = np.argsort(np.abs(v - g), kind="stable")
        k = int(np.searchsorted(np.cumsum(n[order]), need))
        out.append(float(abs(v[order][min(k, len(v) - 1)] - g)) * (1 + 1e-9) or 1e-9)
    return out


def local_cv(df: DataFrame, x: str, y: str, fold: str, bandwidths: list[float], degree: int = 1, kernel: str = "tricube") -> list[tuple[float, float]]:
    """(bandwidth, mean squared error) over folds: fits at the distinct values of x in each fold, from the other folds' rows."""
    values = sorted(float(r[0]) for r in df.select(F.col(x).cast("double")).dropna().distinct().collect())
    out = []
    for h in bandwidths:
        total, n = 0.0, 0
        for f in sorted(r[0] for r in df.select(fold).distinct().dropna().collect()):
            fit = {values[i]: v for i, v, w in local_polynomial(df.filter(F.col(fold) != f), [x], y, [[v] for v in values], h, degree, kernel) if w > 0}
            by = df.filter(F.col(fold) == f).groupBy(F.col(x).cast("double").alias("v")).agg(F.count(y).alias("n"), F.sum(y).alias("s"), F.sum(F.col(y) * F.col(y)).alias("q")).collect()
            for r in by:
                if r["v"] in fit:
                    total, n = total + r["q"] - 2 * fit[r["v"]] * r["s"] + r["n"] * fit[r["v"]] ** 2, n + r["n"]
        out.append((h, total / n if n else math.nan))
    return out


class Experts:
    """Two linear experts and a logistic gate, by expectation-maximisation: one weighted aggregation for the experts, Newton steps for the gate."""

    def __init__(self, df: DataFrame, x: list[str], y: str, steps: int = 10) -> None:
        self.x, self.y, k = x, y, len(x) + 1
        data = df.dropna(subset=[*x, y])
        first = data.agg(F.avg(x[0]).alias("m")).first()["m"]
        share = F.when(F.col(x[0]) > first, 0.8).otherwise(0.2)  # split at the mean of the first column
        self.beta, self.variance, self.path = np.zeros((2, k)), np.ones(2), []
        for _ in range(steps):
            held = data.withColumns({"_r0": 1 - share, "_r1": share})
            for e in range(2):
                m = matrix(gram(held, x, y, weight=f"_r{e}").first(), k + 1)
                self.beta[e] = np.linalg.lstsq(m[:k, :k], m[:k, k], rcond=None)[0]
                rss = m[k, k] - 2 * self.beta[e] @ m[:k, k] + self.beta[e] @ m[:k, :k] @ self.beta[e]
                self.variance[e] = max(float(rss / m[0, 0]), 1e-9)
            self.gate = Logistic(held, x, "_r1", steps=8, penalty=1e-6)
            likelihood = F.log(self._joint(0) + self._joint(1))
            self.path.append(data.agg(F.sum(likelihood)).first()[0])
            share = self._joint(1) / (self._joint(0) + self._joint(1))

    def expert(self, e: int) -> Column:
        return sum((float(b) * F.col(c) for b, c in zip(self.beta[e][1:], self.x, strict=True)), F.lit(float(self.beta[e][0])))

    def _joint(self, e: int) -> Column:
        s = math.sqrt(self.variance[e])
        p = self.gate.probability() if e else 1 - self.gate.probability()
        return p * F.exp(-0.5 * F.pow((F.col(self.y) - self.expert(e)) / s, F.lit(2))) / (s * math.sqrt(2 * math.pi)) + 1e-300

    def predict(self) -> Column:
        p = self.gate.probability()
        return (1 - p) * self.expert(0) + p * self.expert(1)

    def dominant(self) -> Column:
        return F.when(self.gate.probability() >= 0.5, 1).otherwise(0)

    def predict_variance(self) -> Column:
        """Within experts, and between them."""
        p = self.gate.probability()
        return (1 - p) * float(self.variance[0]) + p * float(self.variance[1]) + p * (1 - p) * F.pow(self.expert(0) - self.expert(1), F.lit(2))


def oriented(direction: np.ndarray) -> np.ndarray:
    """Length one, the greatest entry positive."""
    d = np.asarray(direction, float) / max(float(np.linalg.norm(direction)), 1e-300)
    return d * (np.sign(d[np.argmax(np.abs(d))]) or 1.0)


class Pursuit:
    """Sum of smooth functions of projections. Each direction starts at the gradient of the residual, is moved by Gauss-Newton steps on the
    smooth's slope (one aggregation each) while the error falls, and its smooth is a penalised spline of the projection."""

    def __init__(self, df: DataFrame, x: list[str], y: str, terms: int = 1, steps: int = 5, knots: int = 6, lam: float = 1e-3, seed: int = 1) -> None:
        data, rng = df.dropna(subset=[*x, y]), np.random.default_rng(seed)
        self.x, self.parts, self.mean = x, [], float(data.agg(F.avg(y)).first()[0])
        rest = F.col(y) - self.mean
        for _ in range(terms):
            row = data.select(*x, rest.alias("_e")).agg(*[F.covar_pop(c, "_e").alias(c) for c in x]).first()
            start = np.array([row[c] for c in x])
            direction = oriented(start if np.linalg.norm(start) > 1e-9 else rng.standard_normal(len(x)))
            best = None
            for _ in range(steps):
                fit, error, span = self._ridge(data, direction, rest, knots, lam)
                if best is not None and error >= best[2] - 1e-12:
                    break
                best = (direction, fit, error)
                h = (span[1] - span[0]) / 200
                v = projection(x, direction.tolist())
                basis_up, basis_down = (self._value(fit, v + s * h, span, knots) for s in (1, -1))
                slope = (basis_up - basis_down) / (2 * h)
                step = data.select(*[(slope * F.col(c)).alias(c) for c in x], (rest - self._value(fit, v, span, knots)).alias("_e"))
                m = matrix(gram(step, x, "_e").first(), len(x) + 2)[1:, 1:]
                direction = oriented(direction + np.linalg.lstsq(m[:-1, :-1] + 1e-8 * np.trace(m[:-1, :-1]) * np.eye(len(x)), m[:-1, -1], rcond=None)[0])
            direction, fit, _ = best
            span = self._span(data, direction)
            self.parts.append((direction, fit, span, knots))
            rest = rest - self._value(fit, projection(x, direction.tolist()), span, knots)

    def _span(self, data: DataFrame, direction: np.ndarray) -> tuple[float, float]:
        low, high = data.agg(F.min(projection(self.x, direction.tolist())), F.max(projection(self.x, direction.tolist()))).first()
        return float(low) - 1e-9, float(high) + 1e-9

    def _basis(self, v: Column, span: tuple[float, float], knots: int) -> list[Column]:
        inner = np.linspace(*span, knots + 2)[1:-1].tolist()
        return bspline(F.greatest(F.least(v, F.lit(span[1])), F.lit(span[0])), inner, *span, 2)

    def _ridge(self, data: DataFrame, direction: np.ndarray, rest: Column, knots: int, lam: float) -> tuple[np.ndarray, float, tuple[float, float]]:
        span = self._span(data, direction)
        basis = self._basis(projection(self.x, direction.tolist()), span, knots)
        fit = PenalizedFit(data.withColumn("_e", rest), basis, "_e", lam, difference_penalty(len(basis)))
        return fit.beta, fit.rss / fit.n, span

    def _value(self, beta: np.ndarray, v: Column, span: tuple[float, float], knots: int) -> Column:
        return sum((float(b) * c for b, c in zip(beta, self._basis(v, span, knots), strict=True)), F.lit(0.0))

    def predict(self) -> Column:
        return sum((self._value(b, projection(self.x, d.tolist()), s, k) for d, b, s, k in self.parts), F.lit(self.mean))


def principal_curve(df: DataFrame, x: list[str], knots: int = 4, rounds: int = 5, lam: float = 1e-3) -> tuple[list[np.ndarray], np.ndarray, list[float]]:
    """A smooth curve through the middle of the rows: coordinates are penalised splines of a place in [0, 1], first that along the principal
    component; each round places every row at the nearest of 101 points of the curve (a column) and fits the coordinates anew. Returns the
    coefficients by coordinate, the points, and the mean squared distance to the curve by round."""
    data = df.dropna(subset=x)
    m = matrix(gram(data, x).first(), len(x) + 1)
    mean = m[0, 1:] / m[0, 0]
    _, vectors = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))
    along = sum((float(v) * F.col(c) for v, c in zip(oriented(vectors[:, -1]), x, strict=True)), F.lit(0.0))
    low, high = data.agg(F.min(along), F.max(along)).first()
    place, path = (along - float(low)) / max(float(high) - float(low), 1e-12), []
    inner, t = np.linspace(0, 1, knots + 2)[1:-1].tolist(), np.linspace(0, 1, 101)
    grid = df.sparkSession.createDataFrame([(float(v),) for v in t], "_t double")
    basis_at = np.array([list(r) for r in grid.orderBy("_t").select(*bspline(F.col("_t"), inner, 0.0, 1.0, 3)).collect()])
    for _ in range(rounds):
        placed = data.withColumn("_t", place)
        basis = bspline(F.col("_t"), inner, 0.0, 1.0, 3)
        beta = [PenalizedFit(placed, basis, c, lam, difference_penalty(len(basis))).beta for c in x]
        points = basis_at @ np.array(beta).T
        # the points are one literal: the expression stays as small as a row's distance to one of them
        each = F.transform(F.array(*[F.array(*[F.lit(float(v)) for v in pt]) for pt in points]), lambda pt, i: F.struct(sum(((F.col(c) - pt[k]) * (F.col(c) - pt[k]) for k, c in enumerate(x)), F.lit(0.0)).alias("d"), i.alias("i")))
        nearest = F.array_min(each)
        path.append(float(data.agg(F.avg(nearest["d"])).first()[0]))
        place = nearest["i"] / 100.0
    return beta, points, path


def boltzmann_energy(v: list[Column], h: list[Column], w: np.ndarray, a: np.ndarray, b: np.ndarray) -> Column:
    """Of visible and hidden units: -a.v - b.h - v'Wh."""
    bias = sum((float(c) * u for c, u in zip([*a, *b], [*v, *h], strict=True)), F.lit(0.0))
    return -bias - sum((float(w[i, j]) * v[i] * h[j] for i in range(len(v)) for j in range(len(h))), F.lit(0.0))


def boltzmann_free_energy(v: list[Column], w: np.ndarray, a: np.ndarray, b: np.ndarray) -> Column:
    """-a.v less the softplus of each hidden unit's input: what is left when hidden units are summed out."""
    from lumenstat.operators.signals import softplus

    inputs = [sum((float(w[i, j]) * v[i] for i in range(len(v))), F.lit(float(b[j]))) for j in range(len(b))]
    return -sum((float(c) * u for c, u in zip(a, v, strict=True)), F.lit(0.0)) - sum((softplus(u) for u in inputs), F.lit(0.0))


def boltzmann_log_partition(w: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    """Exact, over all visible states: at most 20 units."""
    if len(a) > 20:
        raise ValueError("exact sums are taken over at most 20 visible units")
    states = (np.arange(2 ** len(a))[:, None] >> np.arange(len(a)) & 1).astype(float)
    f = states @ a + np.logaddexp(0, states @ w + b).sum(1)
    return float(f.max() + np.log(np.exp(f - f.max()).sum()))


def boltzmann_gibbs(v: np.ndarray, w: np.ndarray, a: np.ndarray, b: np.ndarray, steps: int = 1, seed: int = 1) -> np.ndarray:
    """Visible states after some turns of sampling hidden from visible units and back."""
    rng = np.random.default_rng(seed)
    for _ in range(steps):
        h = rng.random((len(v), len(b))) < 1 / (1 + np.exp(-(v @ w + b)))
        v = (rng.random(v.shape) < 1 / (1 + np.exp(-(h @ w.T + a)))).astype(float)
    return v
