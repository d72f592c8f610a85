"""Bootstrap replicates in one pass, and Gaussian mixtures by expectation-maximisation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distribution function of a Poisson variable of mean 1 at 0, 1, ... in units of 1 / 10007.
STEPS = [math.floor(10007 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(6)]


def copies(key: Column, replicate: int) -> Column:
    """How often a row is drawn in a replicate: nearly Poisson of mean 1, by integer arithmetic on its key."""
    h = F.pmod(F.pmod(key, F.lit(10007)) * (7919 + 31 * replicate) + 104729 * replicate, F.lit(10007))
    return sum((F.when(h >= s, 1).otherwise(0) for s in STEPS), F.lit(0))


def bootstrap_means(df: DataFrame, key: str, value: str, replicates: int) -> DataFrame:
    """replicate, mean: two sums a replicate in one aggregation; rows are not repeated."""
    w = [copies(F.col(key), b) for b in range(replicates)]
    row = df.dropna(subset=[key, value]).agg(*[(F.sum(c * F.col(value)) / F.sum(c)).alias(f"m{b}") for b, c in enumerate(w)])
    pairs = F.array(*[F.struct(F.lit(b).alias("replicate"), F.col(f"m{b}").alias("mean")) for b in range(replicates)])
    return row.select(F.inline(pairs))


def mixture(df: DataFrame, x: str, means: list[float], sds: list[float], weights: list[float], steps: int, least_sd: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Steps of expectation-maximisation for one variable: one aggregation each. Returns means, deviations, weights and the log likelihood before the last step."""
    m, s, p, loglik = np.array(means, float), np.array(sds, float), np.array(weights, float), float("nan")
    data = df.select(F.col(x).cast("double").alias("x_")).dropna()
    for _ in range(steps):
        dens = [float(p[k]) / float(s[k]) / math.sqrt(2 * math.pi) * F.exp(-0.5 * F.pow((F.col("x_") - float(m[k])) / float(s[k]), F.lit(2))) for k in range(len(m))]
        total = sum(dens[1:], dens[0])
        share = [d / total for d in dens]
        # centred at the present means, so that the second moment loses no digits
        z = [F.col("x_") - float(c) for c in m]
        got = data.agg(F.count("*").alias("n"), F.sum(F.log(total)).alias("ll"), *[F.sum(share[k] * z[k] ** j).alias(f"s{k}_{j}") for k in range(len(m)) for j in range(3)]).first()
        w, a, b = (np.array([got[f"s{k}_{j}"] for k in range(len(m))]) for j in range(3))
        m, s, p, loglik = m + a / w, np.maximum(np.sqrt(np.maximum(b / w - (a / w) ** 2, 0)), least_sd), w / got["n"], got["ll"]
    return m, s, p, float(loglik)


#: Distribution function of a Poisson variable of mean 1 at 0, 1, ... over 32-bit numbers.
WIDE_STEPS = [math.floor(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(9)]


def hashed(key: Column | str, salt: int) -> Column:
    """A 32-bit number from the digest of key and salt: the same on any engine, and no two rows go together by design."""
    text = F.concat(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), F.lit(f"|{salt}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def poisson_copies(key: Column | str, replicate: int) -> Column:
    """How often a row is drawn in a replicate: Poisson of mean 1 by the digest of its whole key."""
    h = hashed(key, replicate)
    return sum((F.when(h >= s, 1).otherwise(0) for s in WIDE_STEPS), F.lit(0))


def bootstrap_moments(df: DataFrame, key: str, x: str, y: str, replicates: int) -> DataFrame:
    """replicate, n, distinct share (rows drawn at least once), mean of y, correlation, slope and intercept of y on x: weighted sums of all
    replicates in one aggregation; rows are not repeated."""
    data = df.dropna(subset=[key, x, y])
    a, b, sums = F.col(x).cast("double"), F.col(y).cast("double"), [F.count("*").alias("rows")]
    for r in range(replicates):
        w = poisson_copies(key, r)
        sums += [F.sum(w * v).alias(f"{n}{r}") for n, v in (("n", F.lit(1.0)), ("a", a), ("b", b), ("aa", a * a), ("ab", a * b), ("bb", b * b))] + [F.sum(F.when(w > 0, 1).otherwise(0)).alias(f"u{r}")]
    each = []
    for r in range(replicates):
        n, ma, mb = F.col(f"n{r}"), F.col(f"a{r}") / F.col(f"n{r}"), F.col(f"b{r}") / F.col(f"n{r}")
        caa, cab, cbb = F.col(f"aa{r}") / n - ma * ma, F.col(f"ab{r}") / n - ma * mb, F.col(f"bb{r}") / n - mb * mb
        each.append(F.struct(F.lit(r).cast("long").alias("replicate"), n.cast("long").alias("n"), (F.col(f"u{r}") / F.col("rows")).alias("unique_share"), mb.alias("mean"), (cab / F.sqrt(caa * cbb)).alias("correlation"), (cab / caa).alias("slope"), (mb - cab / caa * ma).alias("intercept")))
    return data.agg(*sums).select(F.inline(F.array(*each)))


def bootstrap_summary(draws: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """mean, se and percentile interval over a replicate a row."""
    a = (1 - level) / 2
    return draws.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("se"), F.percentile(value, a).alias("low"), F.percentile(value, 1 - a).alias("high"))


def residual_bootstrap(df: DataFrame, key: str, x: str, y: str, replicates: int) -> DataFrame:
    """replicate, slope: each row keeps x and its fit, and takes a residual with the digest's sign (the wild form, which needs no second row)."""
    data = df.dropna(subset=[key, x, y]).select(key, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    s = data.agg(F.regr_slope("_y", "_x").alias("b"), F.regr_intercept("_y", "_x").alias("a"), F.avg("_x").alias("m"), F.var_pop("_x").alias("v"), F.count("*").alias("n")).first()
    e = F.col("_y") - (s["a"] + s["b"] * F.col("_x"))
    sums = [F.sum((F.col("_x") - s["m"]) * e * F.when(hashed(key, 1000 + r) % 2 == 0, 1.0).otherwise(-1.0)).alias(f"g{r}") for r in range(replicates)]
    each = [F.struct(F.lit(r).cast("long").alias("replicate"), (F.lit(s["b"]) + F.col(f"g{r}") / (s["n"] * s["v"])).alias("slope")) for r in range(replicates)]
    return data.agg(*sums).select(F.inline(F.array(*each)))
