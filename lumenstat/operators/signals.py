"""Wavelet shrinkage over pairs of neighbouring rows, projection indices, activation functions, and posteriors from sums."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstat.functions import soft_threshold


def haar_pairs(df: DataFrame, place: str, value: str) -> DataFrame:
    """k, mean (scaled sum), detail, n: neighbours 2k and 2k + 1 of a series numbered from 0; a row alone at the end pairs with 0."""
    w = F.col(value).cast("double")
    even = F.sum(F.when(F.col(place) % 2 == 0, w).otherwise(0.0))
    odd = F.sum(F.when(F.col(place) % 2 == 1, w).otherwise(0.0))
    return df.groupBy(F.floor(F.col(place) / 2).alias("k")).agg(((even + odd) / math.sqrt(2)).alias("mean"), ((even - odd) / math.sqrt(2)).alias("detail"), F.count("*").alias("n"))


def haar_inverse(level: DataFrame) -> DataFrame:
    """place, value from k, mean, detail (of ``haar_pairs``, perhaps with changed details) and n, the rows that the pair had."""
    a, b = (F.col("mean") + F.col("detail")) / math.sqrt(2), (F.col("mean") - F.col("detail")) / math.sqrt(2)
    both = F.array(F.struct((2 * F.col("k")).alias("place"), a.alias("value")), F.struct((2 * F.col("k") + 1).alias("place"), b.alias("value")))
    return level.select("n", F.inline(both)).filter("n = 2 OR place % 2 = 0").select("place", "value")


def haar_levels(df: DataFrame, place: str, value: str, levels: int) -> DataFrame:
    """level, k, detail, n: details of levels 1 to ``levels``, and at level 0 the scaled sums that are left. Each level is an aggregation of the one before."""
    now, out = df.select(F.col(place).cast("long").alias("place"), F.col(value).cast("double").alias("value")), None
    for level in range(1, levels + 1):
        pairs = haar_pairs(now, "place", "value")
        part = pairs.select(F.lit(level).alias("level"), "k", "detail", "n")
        out = part if out is None else out.unionByName(part)
        now = pairs.select(F.col("k").alias("place"), F.col("mean").alias("value"))
    rest = now.select(F.lit(0).alias("level"), F.col("place").alias("k"), F.col("value").alias("detail"), F.lit(1).cast("long").alias("n"))
    return rest if out is None else out.unionByName(rest)


def haar_rebuilt(table: DataFrame, levels: int) -> DataFrame:
    """place, value from ``haar_levels``, perhaps with changed or missing details (missing ones are 0; a level's k must be there)."""
    now = table.filter("level = 0").select(F.col("k"), F.col("detail").alias("mean"))
    for level in range(levels, 0, -1):
        part = table.filter(F.col("level") == level).select("k", "detail", "n")
        now = haar_inverse(part.join(now, "k")).select(F.col("place").alias("k"), F.col("value").alias("mean"))
    return now.select(F.col("k").alias("place"), F.col("mean").alias("value"))


def thresholded(table: DataFrame, threshold: float, soft: bool = True, of: list[int] | None = None) -> DataFrame:
    """``haar_levels`` with the details of the levels ``of`` (all) shrunk or cut."""
    d = F.col("detail")
    hit = F.col("level") > 0 if of is None else F.col("level").isin(of)
    return table.withColumn("detail", F.when(hit, soft_threshold(d, threshold) if soft else hard_threshold(d, threshold)).otherwise(d))


def without_fine_levels(table: DataFrame, count: int) -> DataFrame:
    """Details of the finest ``count`` levels set to 0."""
    return table.withColumn("detail", F.when((F.col("level") > 0) & (F.col("level") <= count), 0.0).otherwise(F.col("detail")))


def nonzero_details(table: DataFrame, tol: float = 1e-12) -> DataFrame:
    """level, nonzero, n."""
    return table.filter("level > 0").groupBy("level").agg(F.count_if(F.abs("detail") > tol).alias("nonzero"), F.count("*").alias("n"))


def hard_threshold(x: Column, t: Column | float) -> Column:
    return F.when(F.abs(x) > t, x).otherwise(0.0)


def noise_level(level: DataFrame, detail: str = "detail") -> float:
    """Median absolute detail over 0.6745: of normal noise, its standard deviation. Absolute details are counted by value first."""
    counts = level.groupBy(F.abs(F.col(detail)).alias("a")).agg(F.count("*").alias("n"))
    return (counts.agg(F.percentile("a", 0.5, F.col("n"))).first()[0] or 0.0) / 0.6745


def universal_threshold(sigma: float, n: int) -> float:
    return sigma * math.sqrt(2 * math.log(n)) if n > 1 else 0.0


def shrunk(level: DataFrame, threshold: float, soft: bool = True) -> DataFrame:
    d = F.col("detail")
    return level.withColumn("detail", soft_threshold(d, threshold) if soft else hard_threshold(d, threshold))


def projection(cols: list[str], direction: list[float]) -> Column:
    """Along a direction scaled to length one."""
    size = math.sqrt(sum(v * v for v in direction))
    return sum((float(v / size) * F.col(c) for c, v in zip(cols, direction, strict=True)), F.lit(0.0))


def log_cosh(x: Column) -> Column:
    """Without overflow."""
    a = F.abs(x)
    return a + F.log1p(F.exp(-2 * a)) - math.log(2)


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def sigmoid(x: Column) -> Column:
    """Without overflow on either side."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


#: name: function, and its derivative.
ACTIVATIONS = {
    "tanh": (F.tanh, lambda x: 1 - F.pow(F.tanh(x), F.lit(2))),
    "relu": (relu, lambda x: F.when(x > 0, 1.0).otherwise(0.0)),
    "sigmoid": (sigmoid, lambda x: sigmoid(x) * (1 - sigmoid(x))),
    "softplus": (softplus, sigmoid),
}

#: Mean of log cosh of a standard normal variable.
LOG_COSH_NORMAL = 0.3745672075


def projection_indices(df: DataFrame, cols: list[str], directions: list[list[float]], tail: float = 2.0) -> DataFrame:
    """direction (its number), skewness, kurtosis (in excess), negentropy (by log cosh), tails (share beyond ``tail`` deviations).

    Two aggregations whatever the number of directions: means and deviations, then standardised moments.
    """
    data = df.dropna(subset=cols)
    along = [projection(cols, d) for d in directions]
    first = data.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(along) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    sums = []
    for i, c in enumerate(along):
        z = (c - float(first[f"m{i}"] or 0.0)) / float(first[f"s{i}"] or 1.0)
        sums += [F.avg(z * z * z).alias(f"a{i}"), F.avg(z * z * z * z).alias(f"b{i}"), F.avg(log_cosh(z)).alias(f"c{i}"), F.avg(F.when(F.abs(z) > tail, 1.0).otherwise(0.0)).alias(f"d{i}")]
    row = data.agg(*sums)
    each = [F.struct(F.lit(i).cast("long").alias("direction"), F.col(f"a{i}").alias("skewness"), (F.col(f"b{i}") - 3).alias("kurtosis"), F.pow(F.col(f"c{i}") - LOG_COSH_NORMAL, F.lit(2)).alias("negentropy"), F.col(f"d{i}").alias("tails")) for i in range(len(along))]
    return row.select(F.inline(F.array(*each)))


def random_projection_search(df: DataFrame, cols: list[str], index: str = "kurtosis", trials: int = 32, rounds: int = 3, seed: int = 1, against: list[list[float]] | None = None) -> tuple[list[float], float]:
    """The direction with the greatest absolute index among random ones, then among ever closer ones to the best; orthogonal to those of ``against``."""
    rng = np.random.default_rng(seed)
    best, top, width = np.zeros(len(cols)), -1.0, 1.0
    for _ in range(rounds):
        d = best + width * rng.standard_normal((trials, len(cols)))
        for other in against or []:
            o = np.array(other) / np.linalg.norm(other)
            d -= np.outer(d @ o, o)
        d /= np.linalg.norm(d, axis=1, keepdims=True)
        for r in projection_indices(df, cols, d.tolist()).collect():
            if abs(r[index]) > top:
                top, best = abs(r[index]), d[r["direction"]]
        width /= 3
    return (best * np.sign(best[np.argmax(np.abs(best))])).tolist(), top


def normal_posterior(df: DataFrame, x: str, mean: float, variance: float, noise: float) -> DataFrame:
    """n, mean, variance of a normal mean with a normal prior and known noise variance, and the predictive variance of a new value."""
    row = df.agg(F.count(x).alias("n"), F.avg(x).alias("_m"))
    precision = 1 / variance + F.col("n") / noise
    return row.select("n", ((mean / variance + F.col("n") * F.coalesce("_m", F.lit(0.0)) / noise) / precision).alias("mean"), (1 / precision).alias("variance"), (1 / precision + noise).alias("predictive_variance"))


def gibbs_normal(df: DataFrame, x: str, draws: int = 2000, burn: int = 200, mean: float = 0.0, variance: float = 1e6, shape: float = 0.01, rate: float = 0.01, seed: int = 1) -> np.ndarray:
    """Draws (mean, variance) of a normal sample by turns; the rows are read once, for their number, mean and sum of squares."""
    n, m, v = df.agg(F.count(x), F.avg(x), F.var_pop(x)).first()
    m, v, rng = m or 0.0, v or 0.0, np.random.default_rng(seed)
    mu, s2, out = m, max(v, 1e-12), np.zeros((draws, 2))
    for k in range(burn + draws):
        precision = 1 / variance + n / s2
        mu = rng.normal((mean / variance + n * m / s2) / precision, precision**-0.5)
        s2 = (rate + 0.5 * n * (v + (m - mu) ** 2)) / rng.gamma(shape + n / 2)
        if k >= burn:
            out[k - burn] = mu, s2
    return out


def haar_energies(df: DataFrame, place: str, value: str, bits: int = 12) -> DataFrame:
    """level, energy, n: squared Haar coefficients of every level, summed, and how many blocks of the level hold rows. ``place``: ranks from 0.

    Blocks of 2**bits rows give all their levels in one call, and a sum each, which is the next round's row: a round for every
    ``bits`` levels, each with as many times fewer rows. The series counts as padded with zeros to the next power of two."""
    import pyarrow as pa

    rows, out, at = df.select(F.col(place).cast("long").alias("k"), F.col(value).cast("double").alias("v")), None, 0
    n = rows.count()
    levels = max(1, (n - 1).bit_length())
    while at < levels:
        take, base = min(bits, levels - at), at

        def energies(key: tuple, t: pa.Table) -> pa.Table:
            dense, has = np.zeros(1 << take), np.zeros(1 << take, bool)
            where = t["k"].to_numpy() & ((1 << take) - 1)
            np.add.at(dense, where, t["v"].to_numpy())
            has[where] = True
            level, energy, count = [], [], []
            for k in range(1, take + 1):
                w = dense[0::2] - dense[1::2]
                dense, has = dense[0::2] + dense[1::2], has[0::2] | has[1::2]
                level.append(base + k)
                energy.append(float(w @ w) / 2.0 ** (base + k))
                count.append(int(has.sum()))
            size = len(level)
            return pa.table({"k": pa.array([key[0].as_py()] * size, pa.int64()), "level": pa.array(level, pa.int32()), "energy": energy, "n": pa.array(count, pa.int64()), "v": pa.array([float(dense[0])] * size)})

        found = rows.groupBy(F.expr(f"shiftright(k, {take})").alias("b")).applyInArrow(energies, "k long, level int, energy double, n long, v double")
        own = found.groupBy("level").agg(F.sum("energy").alias("energy"), F.sum("n").alias("n"))
        out = own if out is None else out.unionByName(own)
        rows, at = found.filter(F.col("level") == base + take).select("k", "v"), at + take
    return out
