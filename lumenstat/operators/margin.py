"""Linear support vector machines by batch subgradients, and the perceptron: one aggregation a step."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def margin(x: list[str], w: np.ndarray, b: float) -> Column:
    return sum((float(v) * F.col(c) for c, v in zip(x, w, strict=True)), F.lit(float(b)))


def svc(df: DataFrame, x: list[str], y: str, cost: float = 1.0, rate: float = 0.01, steps: int = 100, decay: float = 1e-4, tol: float = 1e-8) -> tuple[np.ndarray, float, list[float]]:
    """Half of |w|^2 plus ``cost`` times the summed hinge loss, y in {-1, 1}; rate / (1 + decay t). Weights, intercept and the objective before each step."""
    w, b, path = np.zeros(len(x)), 0.0, []
    data = df.dropna(subset=[*x, y])
    for t in range(steps):
        m = F.col(y) * margin(x, w, b)
        hit = F.when(m < 1, F.col(y).cast("double")).otherwise(0.0)
        got = data.agg(F.sum(F.greatest(1 - m, F.lit(0.0))).alias("loss"), F.sum(hit).alias("gb"), *[F.sum(hit * F.col(c)).alias(f"g{k}") for k, c in enumerate(x)]).first()
        path.append(0.5 * float(w @ w) + cost * (got["loss"] or 0.0))
        if t and abs(path[-2] - path[-1]) < tol:
            break
        step = rate / (1 + decay * t)
        w = w - step * (w - cost * np.array([got[f"g{k}"] or 0.0 for k in range(len(x))]))
        b = b + step * cost * (got["gb"] or 0.0)
    return w, b, path


def tube_loss(residual: Column, epsilon: float) -> Column:
    return F.greatest(F.abs(residual) - epsilon, F.lit(0.0))


def svr_objective(df: DataFrame, x: list[str], y: str, w: np.ndarray, b: float, cost: float = 1.0, epsilon: float = 0.5) -> DataFrame:
    """objective: half of |w|^2 plus ``cost`` times the summed loss outside the tube."""
    return df.agg((F.lit(0.5 * float(np.dot(w, w))) + cost * F.coalesce(F.sum(tube_loss(F.col(y) - margin(x, w, b), epsilon)), F.lit(0.0))).alias("objective"))


def svr(df: DataFrame, x: list[str], y: str, cost: float = 1.0, epsilon: float = 0.5, rate: float = 0.001, steps: int = 100, decay: float = 1e-4, tol: float = 1e-8) -> tuple[np.ndarray, float, list[float]]:
    """Linear support vector regression by batch subgradients; the intercept starts at the mean of y. Rows with nulls are left out."""
    data = df.dropna(subset=[*x, y])
    w, b, path = np.zeros(len(x)), float(data.agg(F.avg(y)).first()[0] or 0.0), []
    for t in range(steps):
        r = F.col(y) - margin(x, w, b)
        side = F.when(r > epsilon, 1.0).when(r < -epsilon, -1.0).otherwise(0.0)
        got = data.agg(F.sum(tube_loss(r, epsilon)).alias("loss"), F.sum(side).alias("gb"), *[F.sum(side * F.col(c)).alias(f"g{k}") for k, c in enumerate(x)]).first()
        path.append(0.5 * float(w @ w) + cost * (got["loss"] or 0.0))
        if t and abs(path[-2] - path[-1]) < tol:
            break
        step = rate / (1 + decay * t)
        w = w - step * (w - cost * np.array([got[f"g{k}"] or 0.0 for k in range(len(x))]))
        b = b + step * cost * (got["gb"] or 0.0)
    return w, b, path


def perceptron(df: DataFrame, x: list[str], y: str, rate: float = 1.0, epochs: int = 100) -> tuple[np.ndarray, int]:
    """Mistake-driven weights (intercept first) for y in {-1, 1}: each partition runs the online rule from the shared weights,
    the partitions' weights are averaged by their mistakes; with one partition this is the online rule itself. Returns the weights with the
    fewest errors on all rows (the pocket) and that number; ends at no errors. One job an epoch; nothing but weights leaves a task."""
    data = df.dropna(subset=[*x, y]).select(*[F.col(c).cast("double") for c in [*x, y]])
    w = np.zeros(len(x) + 1)
    best, least = w, None
    for _ in range(epochs + 1):
        now = w

        def learn(frames, now=now):
            own, wrong, moved = now.copy(), 0, 0
            for f in frames:
                a, sign = np.column_stack([np.ones(len(f)), f[x].to_numpy()]), f[y].to_numpy()
                wrong += int((np.where(a @ now >= 0, 1.0, -1.0) != sign).sum())
                for row, s in zip(a, sign):
                    if (1.0 if row @ own >= 0 else -1.0) != s:
                        own += rate * s * row
                        moved += 1
            yield pd.DataFrame({"w": [own.tolist()], "wrong": [wrong], "moved": [moved]})

        parts = data.mapInPandas(learn, "w array<double>, wrong long, moved long")
        got = parts.agg(F.sum("wrong").alias("wrong"), F.sum("moved").alias("moved"), *[F.sum(F.col("w")[k] * F.col("moved")).alias(f"w{k}") for k in range(len(w))]).first()
        wrong = got["wrong"] or 0
        if least is None or wrong < least:
            best, least = w, wrong
        if not wrong or not got["moved"]:
            break
        w = np.array([got[f"w{k}"] for k in range(len(w))]) / got["moved"]
    return best, least
