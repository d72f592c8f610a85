"""Markov chains run one to a task, and their diagnostics as windows and aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def metropolis(spark: SparkSession, log_density: Callable[[float], float], chains: int, steps: int, width: float = 1.0, seed: int = 0, burn: int = 0) -> DataFrame:
    """chain, step, value, accepted: random-walk chains; a chain's draws depend on seed and number only, so a lost task gives the same chain again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for chain in b["id"]:
                rng = np.random.default_rng([seed, int(chain)])
                x = float(rng.normal())
                at, out, took = log_density(x), np.empty(steps), np.zeros(steps, bool)
                for t in range(steps):
                    y = x + width * rng.normal()
                    there = log_density(y)
                    if np.log(rng.random()) < there - at:
                        x, at, took[t] = y, there, True
                    out[t] = x
                yield pd.DataFrame({"chain": chain, "step": np.arange(burn, steps), "value": out[burn:], "accepted": took[burn:]})

    return spark.range(chains, numPartitions=chains).mapInPandas(run, "chain bigint, step bigint, value double, accepted boolean")


def rhat(draws: DataFrame) -> DataFrame:
    """Between and within chains of equal length: sqrt(((n - 1) / n W + B / n) / W)."""
    per = draws.groupBy("chain").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("*").alias("n"))
    within, n = F.avg("v"), F.max("n")
    return per.agg(F.sqrt(((n - 1) / n * within + F.var_samp("m")) / within).alias("rhat"))


BLOCK = 1 << 14  # steps of a block, at least


def autocorrelations(draws: DataFrame, lags: int, first: int = 1) -> DataFrame:
    """chain, lag, rho of lag 0 and of ``first`` to ``lags``: with the chain's mean and full sum of squares. Steps are cut into blocks; the
    last ``lags`` steps of a block are sent to the next one too, and a block adds up its own products of every lag. Whole steps, which may have gaps."""
    kind = draws.schema["chain"].dataType.simpleString()
    size = max(BLOCK, lags)
    means = draws.groupBy("chain").agg(F.avg("value").alias("m"))
    c = draws.join(F.broadcast(means), "chain").select("chain", F.col("step").cast("long").alias("step"), (F.col("value") - F.col("m")).alias("c")).dropna()  # a row a chain
    own = F.floor(F.col("step") / size).cast("long")
    blocks = F.when(F.pmod("step", F.lit(size)) >= size - lags, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = c.select("chain", "step", "c", F.explode(blocks).alias("block"))
    wanted = [0, *range(first, lags + 1)]

    def products(key: tuple, t: pa.Table) -> pa.Table:
        start = key[1].as_py() * size - lags
        dense = np.zeros(size + lags)
        np.add.at(dense, t["step"].to_numpy() - start, t["c"].to_numpy())
        here = dense[lags:]
        sums = [float(here @ dense[lags - k : lags - k + size]) for k in wanted]
        return pa.table({"chain": pa.array([key[0].as_py()] * len(wanted), t.schema.field("chain").type), "lag": pa.array(wanted, pa.int32()), "s": pa.array(sums, pa.float64())})

    sums = dealt.groupBy("chain", "block").applyInArrow(products, f"chain {kind}, lag int, s double").groupBy("chain", "lag").agg(F.sum("s").alias("s"))
    total = sums.filter("lag = 0").select("chain", F.col("s").alias("all"))
    lengths = draws.groupBy("chain").agg((F.max("step") - F.min("step")).alias("span"))
    return sums.join(total, "chain").join(lengths, "chain").filter(F.col("lag") <= F.col("span")).select("chain", "lag", (F.col("s") / F.col("all")).alias("rho"))


def effective_size(draws: DataFrame, lags: int = 1000) -> DataFrame:
    """chain, n, ess: n / (1 + 2 sum of rho), the sum ending before the first negative rho. Lags are taken in growing runs, until each chain has had a negative one."""
    sizes = {r["chain"]: r["count"] for r in draws.groupBy("chain").count().collect()}
    sums, going, first, last = dict.fromkeys(sizes, 0.0), set(sizes), 1, 64
    while going and first <= lags:
        last = min(last, lags)
        rows = autocorrelations(draws.filter(F.col("chain").isin(list(going))), last, first).filter("lag > 0").orderBy("lag").collect()
        seen = {r["chain"] for r in rows}
        for r in rows:
            if r["chain"] in going and r["rho"] is not None and r["rho"] < 0:
                going.discard(r["chain"])
            elif r["chain"] in going:
                sums[r["chain"]] += r["rho"] or 0.0
        going &= seen  # the others are shorter than the lag
        first, last = last + 1, 16 * last
    kind = draws.schema["chain"].dataType.simpleString()
    return draws.sparkSession.createDataFrame([(c, n, n / (1 + 2 * sums[c])) for c, n in sizes.items()], f"chain {kind}, n long, ess double")
