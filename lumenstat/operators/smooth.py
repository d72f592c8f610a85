"""Penalised splines and additive models: one aggregation over the basis, the penalty is solved on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstat.functions import hinge
from lumenstat.operators.linear import gram, matrix


class AdditiveSplines:
    """y as an intercept plus, for each x, a line and hinges at its knots; squared hinge weights cost ``penalty`` (one x: a smoothing line).

    ``gcv`` is n rss / (n - df)^2, df the trace of the smoother. All x are fitted together, where backfitting converges to.
    """

    def __init__(self, df: DataFrame, knots: dict[str, list[float]], y: str, penalty: float) -> None:
        self.terms = [(x, None) for x in knots] + [(x, k) for x, at in knots.items() for k in at]
        names = [f"t{i}_" for i in range(len(self.terms))]
        data = df.dropna(subset=[*knots, y]).select(*[self._term(t).alias(n) for t, n in zip(self.terms, names, strict=True)], F.col(y).cast("double").alias("y_"))
        m = matrix(gram(data, names, "y_").first(), len(names) + 2)
        self.n, a, b = m[0, 0], m[:-1, :-1], m[:-1, -1]
        cost = np.diag([0.0] + [0.0 if k is None else penalty for _, k in self.terms])
        self.beta = np.linalg.solve(a + cost, b)
        self.df = float(np.trace(np.linalg.solve(a + cost, a)))
        self.rss = float(m[-1, -1] - 2 * self.beta @ b + self.beta @ a @ self.beta)
        self.gcv = float(self.n * self.rss / (self.n - self.df) ** 2)

    @staticmethod
    def _term(t: tuple[str, float | None]) -> Column:
        return F.col(t[0]).cast("double") if t[1] is None else hinge(F.col(t[0]).cast("double"), t[1])

    def part(self, x: str) -> Column:
        """What x adds, without the intercept."""
        return sum((float(b) * self._term(t) for b, t in zip(self.beta[1:], self.terms, strict=True) if t[0] == x), F.lit(0.0))

    def predict(self) -> Column:
        return sum((self.part(x) for x in dict(self.terms)), F.lit(float(self.beta[0])))
