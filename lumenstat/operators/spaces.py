"""Distances, kernels and maps of a table of few points, as a table of pairs; graph Laplacians; how well a map keeps order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenstat.operators.cluster import squared_distance
from lumenstat.operators.nearby import manhattan

#: Most points whose pairs are formed: prototypes, landmarks, class or group means, not rows.
MOST = 5_000


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, z: s + z)


def polynomial_kernel(a: Column, b: Column, degree: int = 2, constant: float = 1.0) -> Column:
    return F.pow(inner_product(a, b) + constant, F.lit(degree))


def rbf_kernel(a: Column, b: Column, gamma: float = 1.0) -> Column:
    return F.exp(-gamma * squared_distance(a, b))


def pairs(points: DataFrame, key: str, vec: str, gamma: float = 1.0) -> DataFrame:
    """i, j, dot, sq_dist, manhattan, poly, rbf of all ordered pairs of at most MOST points (counted; more is an error)."""
    n = points.count()
    if n > MOST:
        raise ValueError(f"{n} points: pairs are formed of at most {MOST}")
    a, b = points.select(F.col(key).alias("i"), F.col(vec).alias("_a")), points.select(F.col(key).alias("j"), F.col(vec).alias("_b"))
    x, y = F.col("_a"), F.col("_b")
    return a.crossJoin(F.broadcast(b)).select("i", "j", inner_product(x, y).alias("dot"), squared_distance(x, y).alias("sq_dist"), manhattan(x, y).alias("manhattan"), polynomial_kernel(x, y).alias("poly"), rbf_kernel(x, y, gamma).alias("rbf"))


def centred(table: DataFrame, value: str) -> DataFrame:
    """i, j and ``value`` less the means of its row and column plus the mean of all: a kernel of centred features."""
    rows, cols, every = table.groupBy("i").agg(F.avg(value).alias("_r")), table.groupBy("j").agg(F.avg(value).alias("_c")), table.agg(F.avg(value).alias("_m"))
    both = table.join(rows, "i").join(cols, "j").crossJoin(F.broadcast(every))  # one row
    return both.select("i", "j", (F.col(value) - F.col("_r") - F.col("_c") + F.col("_m")).alias(value))


def gram_to_squared_distance(table: DataFrame, value: str) -> DataFrame:
    own = table.filter("i = j")
    a, b = own.select(F.col("i"), F.col(value).alias("_a")), own.select(F.col("j"), F.col(value).alias("_b"))
    return table.join(a, "i").join(b, "j").select("i", "j", (F.col("_a") + F.col("_b") - 2 * F.col(value)).alias("sq_dist"))


def squared_distance_to_gram(table: DataFrame, value: str = "sq_dist") -> DataFrame:
    """Inner products of centred points from their squared distances."""
    return centred(table.withColumn(value, -0.5 * F.col(value)), value)


def dense(table: DataFrame, value: str) -> tuple[list, np.ndarray]:
    """Keys in order, and the matrix of ``value``: of at most MOST points."""
    rows = table.select("i", "j", value).collect()
    keys = sorted({r["i"] for r in rows})
    at = {k: n for n, k in enumerate(keys)}
    m = np.zeros((len(keys), len(keys)))
    for r in rows:
        m[at[r["i"]], at[r["j"]]] = r[value]
    return keys, m


def kernel_ridge(kernel: np.ndarray, y: np.ndarray, lam: float) -> np.ndarray:
    """Dual coefficients of centred targets; predictions are kernel rows times them, plus the mean of y."""
    return np.linalg.solve(kernel + lam * np.eye(len(y)), y - y.mean())


def kernel_nearest_centroid(table: DataFrame, labels: DataFrame, value: str) -> DataFrame:
    """i, predicted: the class whose mean in the kernel's space is nearest (the least at ties). ``labels``: key, label."""
    a = table.join(labels.select(F.col("key").alias("j"), "label"), "j")
    own = table.filter("i = j").select("i", F.col(value).alias("_ii"))
    to = a.groupBy("i", "label").agg(F.avg(value).alias("_m"))
    inner = a.join(labels.select(F.col("key").alias("i"), F.col("label").alias("_l")), "i").filter("label = _l").groupBy("label").agg(F.avg(value).alias("_cc"))
    d = to.join(own, "i").join(inner, "label").select("i", "label", (F.col("_ii") - 2 * F.col("_m") + F.col("_cc")).alias("d"))
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.round("d", 9), "label"))
    return d.withColumn("r", rank).filter("r = 1").select("i", F.col("label").alias("predicted"), F.col("d").alias("sq_dist"))


def stress(distances: DataFrame, a: str, b: str) -> DataFrame:
    """raw, normalised: between two distances of unordered pairs (i < j) of one table."""
    p = distances.filter("i < j")
    raw = F.sum(F.pow(F.col(a) - F.col(b), F.lit(2)))
    return p.agg(raw.alias("raw"), F.sqrt(raw / F.sum(F.pow(F.col(a), F.lit(2)))).alias("normalised"), F.corr(a, b).alias("correlation"))


def ranks(distances: DataFrame, value: str, out: str) -> DataFrame:
    """``out``: rank from 1 of j among the others by distance from i, the least j at ties; own pairs are left out."""
    return distances.filter("i <> j").withColumn(out, F.row_number().over(Window.partitionBy("i").orderBy(F.round(value, 9), "j")))


def neighbourhood_kept(distances: DataFrame, a: str, b: str, k: int) -> DataFrame:
    """overlap, trustworthiness, continuity of a map with distances ``b`` of points with distances ``a``."""
    r = ranks(ranks(distances, a, "_ra"), b, "_rb")
    n = F.countDistinct("i")
    intruder, lost = F.sum(F.when((F.col("_rb") <= k) & (F.col("_ra") > k), F.col("_ra") - k).otherwise(0)), F.sum(F.when((F.col("_ra") <= k) & (F.col("_rb") > k), F.col("_rb") - k).otherwise(0))
    norm = 2 / (n * k * (2 * n - 3 * k - 1))
    return r.agg((F.sum(F.when((F.col("_ra") <= k) & (F.col("_rb") <= k), 1.0).otherwise(0.0)) / (n * k)).alias("overlap"), (1 - norm * intruder).alias("trustworthiness"), (1 - norm * lost).alias("continuity"))


def knn_graph(distances: DataFrame, value: str, k: int) -> DataFrame:
    """i, j: an edge where either point is among the k nearest of the other."""
    near = ranks(distances, value, "_r").filter(F.col("_r") <= k).select("i", "j")
    return near.unionByName(near.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct()


def laplacian(weights: DataFrame, value: str) -> DataFrame:
    """i, j, plain (D - W), walk (I - W / D), symmetric; pairs of one point count as weight 0, points without weight as 0 in the last two."""
    w = weights.withColumn("_w", F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.col(value)))
    deg = w.groupBy("i").agg(F.sum("_w").alias("_d"))
    both = w.join(deg, "i").join(deg.select(F.col("i").alias("j"), F.col("_d").alias("_e")), "j")
    same = F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)
    d, e = F.col("_d"), F.col("_e")
    return both.select("i", "j", (same * d - F.col("_w")).alias("plain"), F.when(d > 0, same - F.col("_w") / d).otherwise(0.0).alias("walk"), F.when((d > 0) & (e > 0), same - F.col("_w") / F.sqrt(d * e)).otherwise(0.0).alias("symmetric"))


def normalised_cut(weights: DataFrame, value: str, labels: DataFrame) -> DataFrame:
    """cut, normalised: weight between two or more labelled parts (key, label), and the sum of each part's share of its own weight that leaves it."""
    w = weights.filter("i <> j").join(labels.select(F.col("key").alias("i"), F.col("label").alias("_a")), "i").join(labels.select(F.col("key").alias("j"), F.col("label").alias("_b")), "j")
    leaves = F.when(F.col("_a") != F.col("_b"), F.col(value)).otherwise(0.0)
    return w.groupBy("_a").agg(F.sum(leaves).alias("c"), F.sum(value).alias("v")).agg((F.sum("c") / 2).alias("cut"), F.sum(F.col("c") / F.col("v")).alias("normalised"))


def eigengap(matrix: np.ndarray, most: int = 10) -> int:
    """Number of clusters before the widest gap among the least eigenvalues of a Laplacian."""
    values = np.linalg.eigvalsh(matrix)[: most + 1]
    return int(np.argmax(np.diff(values))) + 1


def metric_scaling(d: np.ndarray, dims: int = 2, steps: int = 500, rate: float = 0.05, local: int | None = None, tau: float = 0.5, seed: int = 1) -> tuple[np.ndarray, list[float]]:
    """Coordinates that lower the raw stress by gradient steps from the classical solution; with ``local``, stress of the ``local`` nearest
    pairs less ``tau`` times the mean distance of the others. Returns them and the objective by step; a step that raises it is halved."""
    n = len(d)
    j = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-0.5 * j @ d**2 @ j)
    x = vectors[:, ::-1][:, :dims] * np.sqrt(np.maximum(values[::-1][:dims], 1e-12))
    keep = ~np.eye(n, dtype=bool)
    if local is not None:
        near = np.argsort(d + 1e18 * np.eye(n), axis=1, kind="stable")[:, :local]
        keep = np.zeros((n, n), bool)
        keep[np.repeat(np.arange(n), local), near.ravel()] = True
        keep |= keep.T
    away = ~keep & ~np.eye(n, dtype=bool)

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        apart = x[:, None] - x[None]
        r = np.sqrt((apart**2).sum(2)) + 1e-12
        pull = np.where(keep, r - d, 0.0)
        push = np.where(away, tau / max(away.sum(), 1), 0.0) if local is not None else 0.0
        return float((pull**2).sum() / 2 - (push * r).sum()), ((2 * pull - 2 * push) / r)[:, :, None].repeat(dims, 2).__mul__(apart).sum(1)

    now, g = value(x)
    path = [now]
    for _ in range(steps):
        trial = x - rate * g
        new, ng = value(trial)
        if new <= now:
            x, now, g = trial, new, ng
        else:
            rate /= 2
        path.append(now)
        if rate < 1e-12:
            break
    return x, path


def cross_pairs(new: DataFrame, points: DataFrame, key: str, vec: str, gamma: float = 1.0) -> DataFrame:
    """i (of ``new``, of any size), j (of at most MOST ``points``, counted), dot, sq_dist, poly, rbf: each new row meets every point."""
    n = points.count()
    if n > MOST:
        raise ValueError(f"{n} points: rows meet at most {MOST}")
    a, b = new.select(F.col(key).alias("i"), F.col(vec).alias("_a")), points.select(F.col(key).alias("j"), F.col(vec).alias("_b"))
    x, y = F.col("_a"), F.col("_b")
    return a.crossJoin(F.broadcast(b)).select("i", "j", inner_product(x, y).alias("dot"), squared_distance(x, y).alias("sq_dist"), polynomial_kernel(x, y).alias("poly"), rbf_kernel(x, y, gamma).alias("rbf"))


def centred_new(cross: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """i, j and ``value`` of new rows i with points j, centred as the points' own ``table`` is: less the new row's mean and the point's
    mean in the table, plus the mean of the table."""
    row = cross.groupBy("i").agg(F.avg(value).alias("_r"))
    own = table.groupBy("j").agg(F.avg(value).alias("_c"))
    every = table.agg(F.avg(value).alias("_m"))
    both = cross.join(row, "i").join(F.broadcast(own), "j").crossJoin(F.broadcast(every))  # MOST points, one row
    return both.select("i", "j", (F.col(value) - F.col("_r") - F.col("_c") + F.col("_m")).alias(value))


def average_similarity(cross: DataFrame, labels: DataFrame, value: str) -> DataFrame:
    """i, predicted, similarity: the class whose points are most similar to the new row on average, the least label at ties. ``labels``: key, label of the points."""
    mean = cross.join(F.broadcast(labels.select(F.col("key").alias("j"), "label")), "j").groupBy("i", "label").agg(F.avg(value).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.round(-F.col("similarity"), 9), "label"))
    return mean.withColumn("_r", rank).filter("_r = 1").select("i", F.col("label").alias("predicted"), "similarity")


def nearest_by_distance(cross: DataFrame, labels: DataFrame, value: str, k: int) -> DataFrame:
    """i, predicted, share: the commonest label among the ``k`` nearest points, from a table of distances alone; the least label at ties."""
    near = cross.withColumn("_r", F.row_number().over(Window.partitionBy("i").orderBy(F.round(value, 9), "j"))).filter(F.col("_r") <= k)
    votes = near.join(F.broadcast(labels.select(F.col("key").alias("j"), "label")), "j").groupBy("i", "label").agg(F.count("*").alias("v"))
    share = F.col("v") / F.sum("v").over(Window.partitionBy("i"))
    ranked = votes.withColumn("share", share).withColumn("_r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("v"), "label")))
    return ranked.filter("_r = 1").select("i", F.col("label").alias("predicted"), "share")
