"""Predictions from nearest rows for a stated set of queries, and medoids of weighted points."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenstat.operators.blocks import nearest_blocks
from lumenstat.operators.cluster import squared_distance

#: Most distinct points whose distances are held on the driver.
MOST_POINTS = 4_000


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, z: s + z)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


DISTANCES = {"euclidean": euclidean, "manhattan": manhattan}


def nearest_rows(queries: DataFrame, data: DataFrame, k: int, id_col: str, vec: str, metric: str = "euclidean", carry: list[str] | None = None) -> DataFrame:
    """query_id, rank, dist and the columns of ``data`` (or ``carry`` of them), of the ``k`` nearest other rows; the least id wins ties."""
    carry = data.columns if carry is None else carry
    found = nearest_blocks(queries, data, k, id_col, vec, metric, id_col, carry)
    return found.select(*carry, "query_id", "dist", "rank")


def knn_classify(near: DataFrame, label: str, weighted: bool = False, eps: float = 1e-8) -> DataFrame:
    """query_id, predicted, share: of ``nearest_rows``, the class with most votes or most inverse distance; the least class at ties."""
    vote = 1 / (F.col("dist") + eps) if weighted else F.lit(1.0)
    votes = near.groupBy("query_id", F.col(label).alias("predicted")).agg(F.sum(vote).alias("v"))
    best = votes.withColumn("share", F.col("v") / F.sum("v").over(Window.partitionBy("query_id"))).withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("v", 9).desc(), "predicted")))
    return best.filter("r = 1").select("query_id", "predicted", "share")


def knn_regress(near: DataFrame, y: str, weighted: bool = False, eps: float = 1e-8) -> DataFrame:
    """query_id, predicted: the mean, or the mean by inverse distance, of ``nearest_rows``."""
    w = 1 / (F.col("dist") + eps) if weighted else F.lit(1.0)
    return near.groupBy("query_id").agg((F.sum(w * F.col(y)) / F.sum(w)).alias("predicted"))


def knn_cv(queries: DataFrame, data: DataFrame, ks: list[int], id_col: str, vec: str, y: str, fold: str, classify: bool = True) -> list[tuple[int, float]]:
    """(k, error) over stated queries, each predicted from the rows of other folds: misclassified share, or mean squared error."""
    q = queries.select(F.col(id_col).alias("_q"), F.col(y).alias("_y"), F.col(fold).alias("_f"))
    out = []
    near = nearest_blocks(queries, data, max(ks), id_col, vec, "euclidean", fold, list(dict.fromkeys([id_col, y])))
    for k in ks:
        some = near.filter(F.col("rank") <= k)
        got = (knn_classify(some, y) if classify else knn_regress(some, y)).join(q, F.col("query_id") == F.col("_q"))
        miss = F.when(F.col("predicted") == F.col("_y"), 0.0).otherwise(1.0) if classify else F.pow(F.col("predicted") - F.col("_y"), F.lit(2))
        out.append((k, got.agg(F.avg(miss)).first()[0]))
    return out


def medoids(points: DataFrame, label: str, vec: str, weight: str, metric: str = "euclidean") -> DataFrame:
    """label, vec, cost: of each label the point with the least weighted total distance to its label's points, the first in order at ties.

    ``points`` holds distinct points with how often each occurs, aggregated before: pairs are of distinct points of one label.
    """
    a, b = points.select(label, F.col(vec).alias("vec")), points.select(label, F.col(vec).alias("_v"), F.col(weight).alias("_w"))
    cost = a.join(b, label).groupBy(label, "vec").agg(F.sum(F.col("_w") * DISTANCES[metric](F.col("vec"), F.col("_v"))).alias("cost"))
    order = Window.partitionBy(label).orderBy(F.round("cost", 9), "vec")
    return cost.withColumn("r", F.row_number().over(order)).filter("r = 1").select(label, F.col("vec").alias(vec), "cost")


def _points(points: DataFrame, vec: str, weight: str, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = points.select(vec, weight).limit(MOST_POINTS + 1).collect()
    if len(rows) > MOST_POINTS:
        raise ValueError(f"more than {MOST_POINTS} distinct points: aggregate or sample them")
    rows = sorted((list(map(float, r[0])), float(r[1])) for r in rows)
    x, w = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    apart = x[:, None, :] - x[None, :, :]
    return x, w, np.abs(apart).sum(2) if metric == "manhattan" else np.sqrt((apart**2).sum(2))


def _objective(d: np.ndarray, w: np.ndarray, at: list[int]) -> float:
    return float(w @ d[:, at].min(1))


def k_medoids(points: DataFrame, vec: str, weight: str, k: int, metric: str = "euclidean", start: list[int] | None = None, swaps: bool = True) -> tuple[np.ndarray, float]:
    """Medoids and objective over distinct weighted points (at most MOST_POINTS, else an error): alternating updates, then the best
    swap of a medoid for another point until none lowers the objective."""
    x, w, d = _points(points, vec, weight, metric)
    at = sorted(start if start is not None else np.linspace(0, len(x) - 1, k).astype(int).tolist())
    while True:
        own, new = d[:, at].argmin(1), []
        for j in range(len(at)):
            mine = np.flatnonzero(own == j)
            new.append(int(mine[np.argmin(np.round(d[np.ix_(mine, mine)] @ w[mine], 9))]) if len(mine) else at[j])
        if sorted(new) == at:
            break
        at = sorted(new)
    best = _objective(d, w, at)
    while swaps:
        trial = min((round(_objective(d, w, [*at[:j], i, *at[j + 1 :]]), 9), j, i) for j, i in itertools.product(range(len(at)), range(len(x))) if i not in at) if len(x) > len(at) else (best, 0, 0)
        if trial[0] >= best - 1e-9:
            break
        at[trial[1]] = trial[2]
        at, best = sorted(at), _objective(d, w, at)
    return x[at], best


def k_medoids_multistart(points: DataFrame, vec: str, weight: str, k: int, starts: int = 5, metric: str = "euclidean", seed: int = 1) -> tuple[np.ndarray, float]:
    """The least objective over random starts."""
    n, rng = points.count(), np.random.default_rng(seed)
    found = [k_medoids(points, vec, weight, k, metric, rng.choice(n, k, replace=False).tolist()) for _ in range(starts)]
    return min(found, key=lambda r: r[1])
