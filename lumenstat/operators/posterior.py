"""Posterior of a small network by many random-walk chains, whose proposals are scored together.

A step proposes new weights for every chain. One pass over the rows scores all of them: a task adds up the squared errors
of its rows, a number a chain, and only those sums leave it. So the table is read where it lies, however large it is, and
a step costs one aggregation for all chains. Weights, noise and the random numbers of the chains are on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class NetworkPosterior:
    """One hidden layer of tanh units, normal noise, normal priors: on all weights with deviation ``prior``, on the log of the
    noise with mean ``noise`` and deviation 1. Inputs and response are standardised. ``draws`` has a row for each chain and step.

    Proposals are normal steps of deviation ``width``, which is tuned to accept a share of about a quarter during ``burn``
    and fixed after it. Rows with nulls are left out; without rows the draws are those of the prior.
    """

    def __init__(self, df: DataFrame, x: list[str], y: str, hidden: int = 3, chains: int = 4, steps: int = 400, burn: int = 200, width: float = 0.05, prior: float = 1.0, noise: float = -1.0, seed: int = 1) -> None:
        self.x, self.y, self.hidden, self.chains, self.burn, self.prior, self.noise = x, y, hidden, chains, burn, prior, noise
        data = df.dropna(subset=[*x, y]).select(*[F.col(c).cast("double").alias(c) for c in [*x, y]])
        first = data.agg(F.count("*").alias("n"), *[f(c).alias(f"{s}{i}") for i, c in enumerate([*x, y]) for s, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        self.n = first["n"]
        self.shift = np.array([first[f"m{i}"] or 0.0 for i in range(len(x) + 1)])
        self.scale = np.array([first[f"s{i}"] or 1.0 for i in range(len(x) + 1)])
        size = self.parameters() + 1  # and the log of the noise
        rng = np.random.default_rng(seed)
        now = rng.normal(0, 0.3, (chains, size))
        now[:, -1] = noise
        at = self.log_posterior(now, self._errors(data, now))
        self.accepted, widths, draws = np.zeros(chains), np.full(chains, width), []
        for t in range(steps):
            there = now + widths[:, None] * rng.normal(size=now.shape)
            value = self.log_posterior(there, self._errors(data, there))
            take = np.log(rng.random(chains)) < value - at
            now, at = np.where(take[:, None], there, now), np.where(take, value, at)
            if t < burn:
                widths = widths * np.exp((take - 0.25) / np.sqrt(1 + t))
            else:
                self.accepted += take
                draws.append(now.copy())
        self.accepted = self.accepted / max(steps - burn, 1)
        self.draws = np.array(draws).reshape(len(draws), chains, size)

    def parameters(self) -> int:
        return self.hidden * (len(self.x) + 2) + 1

    def unpacked(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(..., hidden, inputs + 1) into the hidden units, (..., hidden + 1) into the output; the constant first."""
        cut = self.hidden * (len(self.x) + 1)
        return w[..., :cut].reshape(*w.shape[:-1], self.hidden, -1), w[..., cut : cut + self.hidden + 1]

    def forward(self, w: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Outputs, (sets of weights, rows), of standardised inputs."""
        a, b = self.unpacked(w)
        h = np.tanh(np.einsum("chi,ni->chn", a[..., 1:], z) + a[..., :1])
        return b[..., :1] + np.einsum("ch,chn->cn", b[..., 1:], h)

    def log_prior(self, w: np.ndarray) -> np.ndarray:
        return -0.5 * (w[:, :-1] ** 2).sum(1) / self.prior**2 - 0.5 * (w[:, -1] - self.noise) ** 2

    def log_likelihood(self, w: np.ndarray, errors: np.ndarray) -> np.ndarray:
        """From the summed squared errors of each chain."""
        return -self.n * (w[:, -1] + 0.5 * np.log(2 * np.pi)) - 0.5 * errors * np.exp(-2 * w[:, -1])

    def log_posterior(self, w: np.ndarray, errors: np.ndarray) -> np.ndarray:
        return self.log_prior(w) + self.log_likelihood(w, errors)

    def _standard(self, rows: np.ndarray) -> np.ndarray:
        return (rows - self.shift) / self.scale

    def _errors(self, data: DataFrame, w: np.ndarray) -> np.ndarray:
        """Summed squared error of each set of weights: one job."""
        chains = len(w)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(chains)
            for b in batches:
                for lo in range(0, b.num_rows, 4096):
                    part = b.slice(lo, 4096)
                    rows = self._standard(np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns]))
                    total += ((rows[:, -1] - self.forward(w, rows[:, :-1])) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(total[[k]]) for k in range(chains)], [f"e{k}" for k in range(chains)])

        row = data.mapInArrow(run, ", ".join(f"e{k} double" for k in range(chains))).agg(*[F.sum(f"e{k}") for k in range(chains)]).first()
        return np.array([v or 0.0 for v in row])

    def rhat(self) -> np.ndarray:
        """Of each parameter: between and within chains."""
        n = len(self.draws)
        within = self.draws.var(0, ddof=1).mean(0)
        return np.sqrt(((n - 1) / n * within + self.draws.mean(0).var(0, ddof=1)) / np.maximum(within, 1e-300))

    def _thinned(self, most: int) -> np.ndarray:
        flat = self.draws.reshape(-1, self.draws.shape[2])
        return flat[:: max(1, len(flat) // most)][:most]

    def __getstate__(self) -> dict:
        """What tasks need: not the draws."""
        return {k: v for k, v in self.__dict__.items() if k != "draws"}

    def predicted(self, df: DataFrame, level: float = 0.9, most: int = 200, seed: int = 7) -> DataFrame:
        """``df`` with mean, low, high (of a new y, by ``most`` draws at most), of_mean and of_noise: the variance of y split into
        that of the network's output over draws and the mean noise. Null where an input is null."""
        w, model = self._thinned(most), self
        names = ["mean", "low", "high", "of_mean", "of_noise"]
        noise = np.exp(w[:, -1])
        kicks = np.random.default_rng(seed).normal(size=len(w)) * noise
        x, unit = self.x, self.scale[-1]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                z = (f[x].to_numpy(float) - model.shift[:-1]) / model.scale[:-1]
                out = model.forward(w, z)
                new = out + kicks[:, None]
                f["mean"], f["of_mean"], f["of_noise"] = out.mean(0) * unit + model.shift[-1], out.var(0) * unit**2, np.mean(noise**2) * unit**2 + 0 * z[:, 0]
                f["low"], f["high"] = np.quantile(new, [(1 - level) / 2, (1 + level) / 2], axis=0) * unit + model.shift[-1]
                yield f

        inputs = df.select("*", *[F.lit(None).cast("double").alias(c) for c in names])
        out = inputs.mapInPandas(run, inputs.schema)
        return out.select(*df.columns, *[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) for c in names])

    def report(self, df: DataFrame, level: float = 0.9) -> DataFrame:
        """coverage and width of the intervals, root mean squared error, r_squared, and the mean split of the variance over the rows of ``df``."""
        rows = self.predicted(df.dropna(subset=[*self.x, self.y]).select(*self.x, F.col(self.y).cast("double").alias(self.y)), level)
        y, e = F.col(self.y), F.col(self.y) - F.col("mean")
        return rows.agg(F.count("*").alias("n"), F.avg(F.when(y.between(F.col("low"), F.col("high")), 1.0).otherwise(0.0)).alias("coverage"), F.avg(F.col("high") - F.col("low")).alias("width"),
                        F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.avg(e * e) / F.var_pop(y)).alias("r_squared"), F.avg("of_mean").alias("of_mean"), F.avg("of_noise").alias("of_noise"))
