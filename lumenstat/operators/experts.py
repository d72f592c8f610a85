"""Linear experts under a tree of logistic gates, by expectation-maximisation with one aggregation a step.

Gates are numbered 1, 2, ... from the root, the children of gate g are 2g and 2g + 1; below the last gates stand the
experts. A row reaches an expert with the product of the gates' probabilities along its path. All densities, shares and
sums are expressions of the present coefficients, so that the plan is as large at the last step as at the first.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstat.operators.linear import matrix
from lumenstat.operators.steps import with_numbers


def _log_sigmoid(z: Column) -> Column:
    return F.least(z, F.lit(0.0)) - F.log1p(F.exp(-F.abs(z)))


def _log_total(logs: list[Column]) -> Column:
    top = F.greatest(*logs)
    return top + F.log(sum((F.exp(v - top) for v in logs[1:]), F.exp(logs[0] - top)))


class ExpertTree:
    """``depth`` levels of gates over 2**depth experts. Columns are standardised for the gates and the first split.

    Each step: responsibilities of the experts from the present model; every expert is fitted by weighted least squares,
    every gate moves by one Newton step towards the shares that its two sides have. A move that would lower the
    likelihood is halved, for the gates alone, so that ``path`` (the log likelihood before each step and at the end) never falls.
    Rows with nulls are left out.
    """

    def __init__(self, df: DataFrame, x: list[str], y: str, depth: int = 2, steps: int = 40, tol: float = 1e-6, ridge: float = 1e-3, least_variance: float = 1e-6) -> None:
        self.x, self.y, self.depth, self.ridge, self._fitting = x, y, depth, ridge, False
        self.leaves, self.gates, k = 2**depth, 2**depth - 1, len(x) + 1
        data = df.dropna(subset=[*x, y]).select(*[F.col(c).cast("double").alias(c) for c in [*x, y]])
        first = data.agg(F.count("*").alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v"), *[f(c).alias(f"{s}{i}") for i, c in enumerate(x) for s, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        self.n, self.path = first["n"], []
        self.shift, self.scale = np.array([first[f"m{i}"] or 0.0 for i in range(len(x))]), np.array([first[f"s{i}"] or 1.0 for i in range(len(x))])
        self.gate = np.zeros((self.gates + 1, k))
        for g in range(1, self.gates + 1):  # level by level the columns in turn part the rows about their means
            level = g.bit_length() - 1
            self.gate[g, 1 + level % len(x)] = 1.5
            self.gate[g, 0] = 0.0 if g & (g - 1) == 0 else 0.5 - (g - (1 << level)) / max((1 << level) - 1, 1)
        self.beta = np.zeros((self.leaves, k))
        self.beta[:, 0] = first["m"] or 0.0
        self.variance, flat = np.full(self.leaves, max(first["v"] or 1.0, least_variance)), True
        move, before = np.zeros_like(self.gate), self.gate
        for _ in range(steps if self.n else 0):
            self._fitting = True
            row = self._sums(with_numbers(data, [*self.gate.ravel(), *self.beta.ravel(), *self.variance]), flat).first()
            self._fitting = False
            likelihood = row["likelihood"]
            if not flat and self.path and likelihood < self.path[-1] - 1e-9 * abs(self.path[-1]) and np.abs(move).max() > 1e-9:
                move = move / 2
                self.gate = before + move
                continue
            if not flat:
                self.path.append(float(likelihood))
                if len(self.path) > 1 and self.path[-1] - self.path[-2] < tol * abs(self.path[-1]):
                    break
            self._experts(row, k, least_variance)
            before, move = self.gate, self._gate_moves(row, k) if not flat else np.zeros_like(self.gate)
            self.gate = before + move
            flat = False

    # expressions of the present coefficients: numbers, or in a fit the entries of an array that each row carries

    def _number(self, name: str, *at: int) -> Column:
        of = getattr(self, name)
        if not self._fitting:
            return F.lit(float(of[at]))
        before = {"gate": 0, "beta": self.gate.size, "variance": self.gate.size + self.beta.size}[name]
        return F.col("_p")[before + int(np.ravel_multi_index(at, of.shape))]

    def _inputs(self) -> list[Column]:
        return [(F.col(c) - float(m)) / float(s or 1.0) for c, m, s in zip(self.x, self.shift, self.scale, strict=True)]

    def _gate_score(self, g: int) -> Column:
        return sum((self._number("gate", g, i + 1) * z for i, z in enumerate(self._inputs())), self._number("gate", g, 0))

    def _path(self, leaf: int) -> list[tuple[int, int]]:
        """(gate, side) from the root to a leaf; side 1 is the gate's yes."""
        at = self.leaves + leaf
        return [(at >> k, at >> (k - 1) & 1) for k in range(self.depth, 0, -1)]

    def log_shares(self) -> list[Column]:
        """Of each expert: the log of the product of the gates along its path."""
        yes = {g: _log_sigmoid(self._gate_score(g)) for g in range(1, self.gates + 1)}
        no = {g: _log_sigmoid(-self._gate_score(g)) for g in range(1, self.gates + 1)}
        return [sum(((yes if side else no)[g] for g, side in self._path(e)), F.lit(0.0)) for e in range(self.leaves)]

    def shares(self) -> list[Column]:
        return [F.exp(v) for v in self.log_shares()]

    def expert(self, e: int) -> Column:
        return sum((self._number("beta", e, i + 1) * F.col(c) for i, c in enumerate(self.x)), self._number("beta", e, 0))

    def log_density(self, e: int, at: Column) -> Column:
        v = self._number("variance", e)
        return -0.5 * F.pow(at - self.expert(e), F.lit(2)) / v - 0.5 * F.log(2 * math.pi * v)

    def responsibilities(self) -> tuple[list[Column], Column]:
        """Share of each expert in a row's y, and the row's log likelihood."""
        joint = [s + self.log_density(e, F.col(self.y)) for e, s in enumerate(self.log_shares())]
        total = _log_total(joint)
        return [F.exp(j - total) for j in joint], total

    # one aggregation a step

    def _sums(self, data: DataFrame, flat: bool) -> DataFrame:
        """All sums of a step. ``flat``: as if no expert knew anything. What several sums need is a column, computed once."""
        gates, leaves = range(1, self.gates + 1), range(self.leaves)
        held = data.withColumns({f"_z{i}": z for i, z in enumerate(self._inputs())})
        held = held.withColumns({f"_g{g}": sum((self._number("gate", g, i + 1) * F.col(f"_z{i}") for i in range(len(self.x))), self._number("gate", g, 0)) for g in gates})
        held = held.withColumns({f"_s{side}{g}": _log_sigmoid(F.col(f"_g{g}") if side else -F.col(f"_g{g}")) for g in gates for side in (0, 1)})
        held = held.withColumns({f"_j{e}": sum((F.col(f"_s{side}{g}") for g, side in self._path(e)), F.lit(0.0) if flat else self.log_density(e, F.col(self.y))) for e in leaves})
        held = held.withColumn("_ll", _log_total([F.col(f"_j{e}") for e in leaves]))
        held = held.withColumns({f"_r{e}": F.exp(F.col(f"_j{e}") - F.col("_ll")) for e in leaves} | {f"_q{g}": F.exp(F.col(f"_s1{g}")) for g in gates})
        cols = [F.lit(1.0), *[F.col(c) for c in self.x], F.col(self.y)]
        out = [F.sum("_ll").alias("likelihood")]
        for e in range(self.leaves):
            out += [F.sum(F.col(f"_r{e}") * cols[i] * cols[j]).alias(f"e{e}_{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
        z = [F.lit(1.0), *[F.col(f"_z{i}") for i in range(len(self.x))]]
        for g in range(1, self.gates + 1):
            below = [e for e in range(self.leaves) if any(p == g for p, _ in self._path(e))]
            yes = [e for e in below if (g, 1) in self._path(e)]
            reach, took = (sum((F.col(f"_r{e}") for e in s), F.lit(0.0)) for s in (below, yes))
            p = F.col(f"_q{g}")
            out += [F.sum((took - reach * p) * z[i]).alias(f"g{g}_{i}") for i in range(len(z))]
            out += [F.sum(reach * p * (1 - p) * z[i] * z[j]).alias(f"h{g}_{i}_{j}") for i in range(len(z)) for j in range(i, len(z))]
        return held.agg(*out)

    def _experts(self, row, k: int, least: float) -> None:
        for e in range(self.leaves):
            m = matrix({f"s_{i}_{j}": row[f"e{e}_{i}_{j}"] for i in range(k + 1) for j in range(i, k + 1)}, k + 1)
            if m[0, 0] > 1e-9:
                self.beta[e] = np.linalg.lstsq(m[:k, :k] + 1e-10 * np.trace(m[:k, :k]) * np.eye(k), m[:k, k], rcond=None)[0]
                rss = m[k, k] - 2 * self.beta[e] @ m[:k, k] + self.beta[e] @ m[:k, :k] @ self.beta[e]
                self.variance[e] = max(float(rss / m[0, 0]), least)

    def _gate_moves(self, row, k: int) -> np.ndarray:
        out = np.zeros_like(self.gate)
        for g in range(1, self.gates + 1):
            h = matrix({f"s_{i}_{j}": row[f"h{g}_{i}_{j}"] for i in range(k) for j in range(i, k)}, k) + self.ridge * np.eye(k)
            out[g] = np.clip(np.linalg.solve(h, [row[f"g{g}_{i}"] for i in range(k)]), -2, 2)
        return out

    # what the model says

    def predict(self) -> Column:
        return sum((s * self.expert(e) for e, s in enumerate(self.shares())), F.lit(0.0))

    def variances(self) -> tuple[Column, Column]:
        """Of a new y, within the experts and between them."""
        mean, shares = self.predict(), self.shares()
        within = sum((s * float(v) for s, v in zip(shares, self.variance, strict=True)), F.lit(0.0))
        return within, sum((s * F.pow(self.expert(e) - mean, F.lit(2)) for e, s in enumerate(shares)), F.lit(0.0))

    def density(self, at: Column) -> Column:
        """Predictive density of y at a value."""
        return F.exp(_log_total([s + self.log_density(e, at) for e, s in enumerate(self.log_shares())]))

    def below(self, at: Column) -> Column:
        """Predictive probability that y is no greater than a value."""
        return sum((s * normal_below((at - self.expert(e)) / math.sqrt(self.variance[e])) for e, s in enumerate(self.shares())), F.lit(0.0))

    def dominant(self) -> Column:
        """The expert with the greatest share, the first at ties."""
        shares = self.log_shares()
        top, out = F.greatest(*shares), F.lit(self.leaves - 1)
        for e in reversed(range(self.leaves - 1)):
            out = F.when(shares[e] >= top, F.lit(e)).otherwise(out)
        return out

    def hard(self) -> Column:
        """Prediction of the dominant expert alone."""
        best, out = self.dominant(), self.expert(self.leaves - 1)
        for e in range(self.leaves - 1):
            out = F.when(best == e, self.expert(e)).otherwise(out)
        return out

    def counts(self) -> int:
        """Free parameters."""
        return self.gates * (len(self.x) + 1) + self.leaves * (len(self.x) + 2)


def normal_below(z: Column) -> Column:
    """Standard normal distribution function, to 1.5e-7: a rational form of the error function."""
    # Coefficients of the rational approximation of the error function.
    t = 1 / (1 + 0.3275911 * F.abs(z) / math.sqrt(2))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = 0.5 * poly * F.exp(-0.5 * z * z)
    return F.when(z >= 0, 1 - half).otherwise(half)
