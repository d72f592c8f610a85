"""Networks trained on whole-table gradients: each partition sums its own, only sums of fixed size leave a task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summed(data: DataFrame, part: Callable[[pd.DataFrame], np.ndarray], size: int) -> np.ndarray:
    """Sum over all rows of the vector that ``part`` gives for a batch: a partial sum a partition, added in a tree of tasks by component."""

    def run(frames):
        total = np.zeros(size)
        for f in frames:
            if len(f):
                total += part(f)
        yield pd.DataFrame({"v": [total.tolist()]})

    got = data.mapInPandas(run, "v array<double>").select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(size)
    for r in got:
        out[r["i"]] = r["x"]
    return out


class Network:
    """One hidden layer of sigmoids; a linear output with squared error, or a sigmoid with cross-entropy (y 0 or 1). Batch gradient
    descent with momentum and weight decay; start weights by seed. Rows with nulls are left out."""

    def __init__(self, x: list[str], y: str, hidden: int = 5, classify: bool = False, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.x, self.y, self.h, self.classify = x, y, hidden, classify
        self.w = rng.normal(0, 0.7, hidden * (len(x) + 1) + hidden + 1)
        self.path: list[float] = []

    def _split(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.h * (len(self.x) + 1)
        return w[:cut].reshape(self.h, -1), w[cut:]

    def _gradient(self, f: pd.DataFrame, w: np.ndarray) -> np.ndarray:
        """Loss, number of rows and the gradient, summed over a batch."""
        a, b = self._split(w)
        x = np.column_stack([np.ones(len(f)), f[self.x].to_numpy(float)])
        y = f[self.y].to_numpy(float)
        z = 1 / (1 + np.exp(-np.clip(x @ a.T, -500, 500)))
        out = b[0] + z @ b[1:]
        if self.classify:
            p = 1 / (1 + np.exp(-np.clip(out, -500, 500)))
            loss = float(np.sum(np.logaddexp(0, out) - y * out))
        else:
            p, loss = out, 0.5 * float(np.sum((y - out) ** 2))
        d = p - y
        back = d[:, None] * b[1:] * z * (1 - z)
        return np.concatenate([[loss, len(f)], (back.T @ x).ravel(), [d.sum()], z.T @ d])

    def fit(self, df: DataFrame, steps: int = 100, rate: float = 0.5, momentum: float = 0.9, decay: float = 0.0) -> Network:
        data = df.dropna(subset=[*self.x, self.y]).select(*self.x, self.y)
        speed = np.zeros_like(self.w)
        for _ in range(steps):
            now = self.w.copy()
            got = summed(data, lambda f, now=now: self._gradient(f, now), len(now) + 2)
            if not got[1]:
                break
            self.path.append(got[0] / got[1])
            speed = momentum * speed - rate * (got[2:] / got[1] + decay * now)
            self.w = now + speed
        return self

    def predict(self) -> Column:
        """The network as an expression over x: scoring needs no Python."""
        a, b = self._split(self.w)

        def squash(c: Column) -> Column:
            return 1 / (1 + F.exp(-c))

        units = [squash(sum((float(v) * F.col(c) for v, c in zip(row[1:], self.x, strict=True)), F.lit(float(row[0])))) for row in a]
        out = sum((float(v) * u for v, u in zip(b[1:], units, strict=True)), F.lit(float(b[0])))
        return squash(out) if self.classify else out


def boltzmann(df: DataFrame, x: list[str], hidden: int = 4, steps: int = 50, rate: float = 0.2, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """Restricted machine over 0/1 columns by one step of contrastive divergence with mean-field units, so that reruns on other partitions
    agree up to rounding. Weights (visible by hidden), visible and hidden biases, mean squared reconstruction error before each step."""
    rng = np.random.default_rng(seed)
    p = len(x)
    w, a, b, path = rng.normal(0, 0.3, (p, hidden)), np.zeros(p), np.zeros(hidden), []
    data = df.dropna(subset=x).select(*x)

    def squash(v: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(v, -500, 500)))

    for _ in range(steps):

        def part(f, w=w, a=a, b=b):
            v = f[x].to_numpy(float)
            h = squash(v @ w + b)
            v2 = squash(h @ w.T + a)
            h2 = squash(v2 @ w + b)
            return np.concatenate([[len(f), ((v - v2) ** 2).sum()], (v.T @ h - v2.T @ h2).ravel(), (v - v2).sum(0), (h - h2).sum(0)])

        got = summed(data, part, 2 + p * hidden + p + hidden)
        if not got[0]:
            break
        path.append(got[1] / got[0] / p)
        step = rate * got[2:] / got[0]
        w, a, b = w + step[: p * hidden].reshape(p, hidden), a + step[p * hidden : p * hidden + p], b + step[p * hidden + p :]
    return w, a, b, path
