"""Adaptive regression splines, mixture discriminants and repeated cross-validation, from sums of fixed size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstat.operators.linear import gram, matrix
from lumenstat.operators.neural import summed
from lumenstat.operators.trees import quantile_cuts

Term = tuple[tuple[str, float, int], ...]  # factors (column, knot, sign): max(0, sign (x - knot))


def _column(term: Term) -> Column:
    out = F.lit(1.0)
    for name, knot, sign in term:
        out = out * F.greatest(sign * (F.col(name) - knot), F.lit(0.0))
    return out


def _values(f: pd.DataFrame, term: Term) -> np.ndarray:
    out = np.ones(len(f))
    for name, knot, sign in term:
        out = out * np.maximum(sign * (f[name].to_numpy(float) - knot), 0)
    return out


def _gcv(rss: float, n: float, terms: int) -> float:
    left = 1 - (terms + 3 * (terms - 1) / 2) / n
    return rss / n / left**2 if left > 0 else np.inf


def adaptive_splines(df: DataFrame, x: list[str], y: str, most: int = 11, degree: int = 1, knots: int = 15) -> tuple[list[tuple[Term, float]], Column]:
    """Forward: the pair of hinges at a parent term, column and knot that lowers squared error most, one job a step, up to ``most`` terms;
    backward: terms leave while generalised cross-validation falls. Of equal gains the first candidate wins. Terms with coefficients, and the prediction."""
    data = df.dropna(subset=[*x, y]).select(*[F.col(c).cast("double") for c in [*x, y]])
    cuts = {c: quantile_cuts(data, c, knots) for c in x}
    terms: list[Term] = [()]
    while len(terms) + 2 <= most:
        m = len(terms)
        tries = [(p, c, t) for p in range(m) if len(terms[p]) < degree and len(terms[p]) == len({q[0] for q in terms[p]}) for c in x if c not in {q[0] for q in terms[p]} for t in cuts[c]]
        if not tries:
            break

        def part(f, terms=tuple(terms), tries=tuple(tries)):
            base = np.column_stack([_values(f, t) for t in terms])
            left = np.column_stack([base, f[y].to_numpy(float)])
            out = [(left.T @ left).ravel()]
            for p, c, t in tries:
                z = f[c].to_numpy(float) - t
                h = np.column_stack([base[:, p] * np.maximum(z, 0), base[:, p] * np.maximum(-z, 0)])
                out += [(left.T @ h).ravel(), (h * h).sum(0)]
            return np.concatenate(out)

        k, each = m + 1, 2 * (m + 1) + 2
        got = summed(data, part, k * k + each * len(tries))
        own, best = got[: k * k].reshape(k, k), None
        if not own[0, 0]:
            break
        for i in range(len(tries)):
            v = got[k * k + i * each : k * k + (i + 1) * each]
            cross, square = v[: 2 * k].reshape(k, 2), v[2 * k :]
            big = np.block([[own[:m, :m], cross[:m]], [cross[:m].T, np.diag(square)]])  # the two hinges are never both above 0
            rhs = np.concatenate([own[:m, m], cross[m]])
            rss = own[m, m] - rhs @ np.linalg.lstsq(big, rhs, rcond=1e-10)[0]
            if best is None or rss < best[0] - 1e-9 * own[m, m]:
                best = (rss, i)
        now = own[m, m] - own[:m, m] @ np.linalg.lstsq(own[:m, :m], own[:m, m], rcond=1e-10)[0]
        if now - best[0] <= 1e-9 * own[m, m]:
            break
        p, c, t = tries[best[1]]
        terms += [(*terms[p], (c, t, 1)), (*terms[p], (c, t, -1))]
    names = [f"t{i}" for i in range(1, len(terms))]
    m = matrix(gram(data.select(*[_column(t).alias(n) for t, n in zip(terms[1:], names, strict=True)], F.col(y).alias("y_")), names, "y_").first(), len(terms) + 1)
    n = m[0, 0]

    def fit(use: list[int]) -> tuple[float, np.ndarray]:
        b = np.linalg.lstsq(m[np.ix_(use, use)], m[use, -1], rcond=1e-10)[0]
        return _gcv(max(float(m[-1, -1] - b @ m[use, -1]), 0.0), n, len(use)), b

    use = list(range(len(terms)))
    if not n > 0:  # no rows: sums are null
        return [((), 0.0)], F.lit(0.0)
    kept, least = use, fit(use)[0]
    while len(use) > 1:
        score, out = min((fit([j for j in use if j != i])[0], i) for i in use[1:])
        use = [j for j in use if j != out]
        if score <= least:
            kept, least = use, score
    model = [(terms[i], float(b)) for i, b in zip(kept, fit(kept)[1], strict=True)]
    return model, sum((b * _column(t) for t, b in model), F.lit(0.0))


def described(term: Term) -> str:
    """A term in words: its hinges, or the constant."""
    return " * ".join(f"max(0, {name} - {knot:g})" if sign > 0 else f"max(0, {knot:g} - {name})" for name, knot, sign in term) or "1"


def spline_importance(df: DataFrame, model: list[tuple[Term, float]], x: list[str], y: str) -> dict[str, tuple[int, float]]:
    """Of each column: the number of its terms, and by how much squared error a row rises when these go and the rest is fitted anew. One pass."""
    terms = [t for t, _ in model if t]
    names = [f"t{i}" for i in range(len(terms))]
    data = df.dropna(subset=[*x, y])
    m = matrix(gram(data.select(*[_column(t).alias(n) for t, n in zip(terms, names, strict=True)], F.col(y).cast("double").alias("y_")), names, "y_").first(), len(terms) + 2)

    def error(use: list[int]) -> float:
        b = np.linalg.lstsq(m[np.ix_(use, use)], m[use, -1], rcond=1e-10)[0]
        return float(m[-1, -1] - b @ m[use, -1]) / m[0, 0]

    every = list(range(len(terms) + 1))
    base, out = error(every), {}
    for c in x:
        own = [i + 1 for i, t in enumerate(terms) if any(q[0] == c for q in t)]
        out[c] = (len(own), error([i for i in every if i not in own]) - base)
    return out


def spline_degree_cv(df: DataFrame, x: list[str], y: str, fold: str, degrees: tuple[int, ...] = (1, 2), **settings) -> list[tuple[int, float]]:
    """(degree, mean squared error over folds) of adaptive splines by the most factors a term may have; all models are scored in one pass."""
    data = df.dropna(subset=[*x, y, fold])
    folds, e = sorted(r[0] for r in data.select(fold).distinct().collect()), []
    for d in degrees:
        fit = F.lit(None)
        for f in folds:
            fit = F.when(F.col(fold) == f, adaptive_splines(data.filter(F.col(fold) != f), x, y, degree=d, **settings)[1]).otherwise(fit)
        e.append(F.avg(F.pow(F.col(y) - fit, F.lit(2))).alias(f"e{d}"))
    rows = data.groupBy(fold).agg(*e).collect()
    return [(d, float(np.mean([r[f"e{d}"] for r in rows]))) for d in degrees]


def mixture_discriminants(df: DataFrame, x: list[str], label: str, start: dict[object, list[list[float]]], steps: int = 20, ridge: float = 1e-8) -> tuple[dict[object, np.ndarray], dict[object, Column]]:
    """Each class is a mixture of Gaussians of one shared covariance: steps of expectation-maximisation from the centres ``start``, one job
    each. Centres of each class and its score, log prior plus log density up to what all share."""
    names, p = list(start), len(x)
    data = df.dropna(subset=[label, *x]).filter(F.col(label).isin(names)).select(F.col(label).alias("l_"), *[F.col(c).cast("double") for c in x])
    mean = {c: np.array(start[c], float) for c in names}
    share = {c: np.full(len(mean[c]), 1 / len(mean[c])) for c in names}
    m = matrix(gram(data, x).first(), p + 1)
    cov = m[1:, 1:] / m[0, 0] - np.outer(m[0, 1:], m[0, 1:]) / m[0, 0] ** 2
    sizes = dict.fromkeys(names, 0.0)
    for _ in range(steps):
        inverse = np.linalg.inv(cov + ridge * np.eye(p))

        def part(f, mean=mean, share=share, inverse=inverse):
            out = []
            for c in names:
                v = f.loc[f["l_"] == c, x].to_numpy(float)
                z = v[:, None] - mean[c]
                log = np.log(np.maximum(share[c], 1e-300)) - 0.5 * np.einsum("nri,ij,nrj->nr", z, inverse, z)
                r = np.exp(log - log.max(1, keepdims=True)) if len(v) else np.zeros((0, len(mean[c])))
                r /= r.sum(1, keepdims=True)
                out += [r.sum(0), np.einsum("nr,nri->ri", r, z).ravel(), np.einsum("nr,nri,nrj->ij", r, z, z).ravel()]
            return np.concatenate(out)

        got = summed(data, part, sum(len(mean[c]) * (1 + p) + p * p for c in names))
        at, total, spread, new = 0, 0.0, np.zeros((p, p)), {}
        for c in names:
            k = len(mean[c])
            w, s = got[at : at + k], got[at + k : at + k + k * p].reshape(k, p)
            move = s / np.maximum(w, 1e-12)[:, None]
            spread += got[at + k + k * p : at + k + k * p + p * p].reshape(p, p) - (move * w[:, None]).T @ move
            new[c], at, total = (mean[c] + move, w), at + k + k * p + p * p, total + w.sum()
        mean, sizes = {c: new[c][0] for c in names}, {c: float(new[c][1].sum()) for c in names}
        share, cov = {c: new[c][1] / max(sizes[c], 1e-12) for c in names}, spread / total
    inverse, total, score = np.linalg.inv(cov + ridge * np.eye(p)), sum(sizes.values()), {}
    for c in names:
        logs = []
        for a, w in zip(mean[c], share[c], strict=True):
            z = [F.col(n) - float(v) for n, v in zip(x, a, strict=True)]
            logs.append(float(np.log(max(w, 1e-300))) - 0.5 * sum((float(inverse[i, j]) * z[i] * z[j] for i in range(p) for j in range(p)), F.lit(0.0)))
        top = F.greatest(*logs) if len(logs) > 1 else logs[0]
        score[c] = float(np.log(max(sizes[c] / total, 1e-300))) + top + F.log(sum((F.exp(v - top) for v in logs), F.lit(0.0)))
    return mean, score


def repeated_cv(df: DataFrame, x: list[str], y: str, key: str, k: int = 10, repeats: int = 20) -> list[float]:
    """Mean squared error of least squares by k-fold cross-validation, once for each way of dealing the rows (a hash of key and repeat).
    A row goes to one fold of each repeat and sums are partial: one aggregation; a fold's error follows from its own products."""
    data = df.dropna(subset=[key, *x, y])
    folds = F.array(*[F.pmod(F.xxhash64(key, F.lit(r)), F.lit(k)) for r in range(repeats)])
    rows = data.select(*x, y, F.posexplode(folds).alias("_r", "_f"))
    sums = {(g["_r"], g["_f"]): matrix(g, len(x) + 2) for g in gram(rows, x, y, by=["_r", "_f"]).collect()}
    out = []
    for r in range(repeats):
        own = [m for (at, _), m in sums.items() if at == r]
        whole, error = sum(own), 0.0
        for m in own:
            rest = whole - m
            b = np.append(np.linalg.lstsq(rest[:-1, :-1], rest[:-1, -1], rcond=None)[0], -1.0)
            error += float(b @ m @ b)
        if own:
            out.append(error / whole[0, 0])
    return out
