"""Cross-validation: from sums by fold where the model needs no more, by a pair of functions for any other model."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstat.operators.linear import coordinate_descent, gram, matrix

Fit = Callable[[np.ndarray, np.ndarray, float, float], np.ndarray]  # standardised products, with y, rows, setting: coefficients
Row = tuple[float, float, float]  # setting, mean squared error, standard error over folds


def ridge(xtx: np.ndarray, xty: np.ndarray, n: float, lam: float) -> np.ndarray:
    return np.linalg.solve(xtx + lam * np.eye(len(xty)), xty)


def lasso(xtx: np.ndarray, xty: np.ndarray, n: float, lam: float) -> np.ndarray:
    return coordinate_descent(xtx, xty, n, lam)


def elastic(alpha: float) -> Fit:
    return lambda xtx, xty, n, lam: coordinate_descent(xtx, xty, n, lam, alpha)


def components(xtx: np.ndarray, xty: np.ndarray, n: float, count: float) -> np.ndarray:
    """Regression on the first ``count`` principal components."""
    values, vectors = np.linalg.eigh(xtx)
    keep = vectors[:, ::-1][:, : int(count)]
    return keep @ ((keep.T @ xty) / np.maximum(values[::-1][: int(count)], 1e-12))


def quadratic(penalty: np.ndarray) -> Fit:
    """Any quadratic penalty b'Pb, as of differences of neighbouring coefficients."""
    return lambda xtx, xty, n, lam: np.linalg.solve(xtx + lam * penalty + 1e-10 * np.eye(len(xty)), xty)


def subset_of_first(xtx: np.ndarray, xty: np.ndarray, n: float, count: float) -> np.ndarray:
    """Least squares on the first ``count`` columns: degrees of a polynomial, knots of a spline."""
    k, out = int(count), np.zeros(len(xty))
    out[:k] = np.linalg.lstsq(xtx[:k, :k], xty[:k], rcond=None)[0]
    return out


def path_cv(df: DataFrame, x: list[str], y: str, fold: str, settings: list[float], fit: Fit, scale: bool = True) -> list[Row]:
    """Error of each setting, every fold left out once. One aggregation by fold: training sums are all sums less a fold's.

    Columns are centred, and scaled unless ``scale`` is off, by the training rows of each fold alone.
    """
    k = len(x)
    per = {r[fold]: matrix(r, k + 2) for r in gram(df.dropna(subset=[*x, y, fold]), x, y, by=[fold]).collect()}
    return path_errors(per, k, settings, fit, scale)


def path_errors(per: dict, k: int, settings: list[float], fit: Fit, scale: bool = True) -> list[Row]:
    """``path_cv`` from the products of 1, ``k`` columns and the response, by fold."""
    total, errors = sum(per.values()), []
    for f in sorted(per):
        test, m = per[f], total - per[f]
        n, mean = m[0, 0], m[0, 1:] / m[0, 0]
        c = m[1:, 1:] - n * np.outer(mean, mean)
        sd = np.sqrt(np.diag(c)[:k] / n) if scale else np.ones(k)
        sd = np.where(sd < 1e-12, 1.0, sd)
        one = []
        for s in settings:
            b = fit(c[:k, :k] / np.outer(sd, sd), c[:k, k] / sd, n, s) / sd
            full = np.concatenate([[mean[k] - b @ mean[:k]], b])
            one.append(float(test[-1, -1] - 2 * full @ test[:-1, -1] + full @ test[:-1, :-1] @ full) / test[0, 0])
        errors.append(one)
    e = np.array(errors)
    return [(float(s), float(e[:, i].mean()), float(e[:, i].std(ddof=1) / np.sqrt(len(e)))) for i, s in enumerate(settings)]


def best_setting(rows: list[Row]) -> float:
    """The setting of least error, the first at ties."""
    return min(rows, key=lambda r: r[1])[0]


def one_se_setting(rows: list[Row], simplest_first: bool = True) -> float:
    """The simplest setting whose error is within a standard error of the least; ``rows`` go from simple to complex, or the other way."""
    low = min(rows, key=lambda r: r[1])
    return next(r[0] for r in (rows if simplest_first else rows[::-1]) if r[1] <= low[1] + low[2])


def k_fold(df: DataFrame, fold: str, fit: Callable[[DataFrame], object], predict: Callable[[object], Column], loss: Callable[[Column], Column]) -> list[tuple[int, int, float]]:
    """fold, rows, mean loss for any learner: ``fit`` sees the other folds' rows alone; ``predict`` gives a column; ``loss`` maps it to a row's loss."""
    out = []
    for f in sorted(r[0] for r in df.select(fold).distinct().dropna().collect()):
        model = fit(df.filter(F.col(fold) != f))
        n, e = df.filter(F.col(fold) == f).agg(F.count("*"), F.avg(loss(predict(model)))).first()
        out.append((f, n, e))
    return out


def effective_df(xtx: np.ndarray, penalty: np.ndarray, lam: float) -> float:
    """Trace of the smoother of a quadratic penalty."""
    return float(np.trace(np.linalg.solve(xtx + lam * penalty, xtx)))


def gcv(rss: float, n: float, df: float) -> float:
    return rss / n / (1 - df / n) ** 2
