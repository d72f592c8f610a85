"""Trees grown level by level: one aggregation over (node, feature, bin) for each level, whatever the rows.

Rows go left when the value is at most the cut. Of equal gains the first feature, then the smallest cut wins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenstat.operators.resample import copies


@dataclass
class Tree:
    """Root 1, children 2i and 2i + 1; the model becomes a nested CASE."""

    splits: dict[int, tuple[str, float]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def _walk(self, i: int, leaf) -> Column:
        if i not in self.splits:
            return leaf(i)
        name, cut = self.splits[i]
        return F.when(F.col(name) <= cut, self._walk(2 * i, leaf)).otherwise(self._walk(2 * i + 1, leaf))

    def node(self) -> Column:
        return self._walk(1, lambda i: F.lit(i))

    def predict(self) -> Column:
        return self._walk(1, lambda i: F.lit(self.values[i]))


def midpoints(df: DataFrame, x: str, most: int = 40) -> list[float]:
    """Midpoints of neighbouring distinct values; of more than ``most``, evenly spaced ones. One ordered window: for features of few distinct values, else ``quantile_cuts``."""
    w = Window.orderBy(x)
    cuts = df.select(x).dropna().distinct().withColumn("up", F.lead(x).over(w)).dropna().withColumn("at", F.row_number().over(w) - 1)
    n = cuts.count()
    keep = sorted({round(k) for k in np.linspace(0, n - 1, min(n, most))})
    return [float(r["cut"]) for r in cuts.filter(F.col("at").isin(keep)).select(((F.col(x) + F.col("up")) / 2).alias("cut")).orderBy("cut").collect()]


def quantile_cuts(df: DataFrame, x: str, most: int = 40) -> list[float]:
    """Cuts at approximate quantiles, merged from sketches of each partition: for features of many distinct values."""
    got = df.agg(F.percentile_approx(x, [(k + 1) / (most + 1) for k in range(most)], 10_000).alias("q")).first()["q"]
    return sorted({float(v) for v in got or []})


def _bin(x: Column, at: list[float]) -> Column:
    """How many cuts lie below x."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in at]), lambda c: c < x))


def best_splits(df: DataFrame, cuts: dict[str, list[float]], y: str, node: Column, weight: Column | None = None, min_leaf: float = 5, opposed: bool = False, allowed: Column | None = None) -> DataFrame:
    """node, f, cut, gain, nl, sl, nr, sr: the split of each node with the greatest fall in squared error.

    With ``opposed`` the gain is |left sum - right sum|, which is greatest where a vote of opposite signs errs least. ``allowed`` is a condition on node and f (a feature's number): which features each node may take.
    """
    w = weight if weight is not None else F.lit(1.0)
    bins = [F.struct(F.lit(k).alias("f"), _bin(F.col(x), at).alias("bin")) for k, (x, at) in enumerate(cuts.items())]
    rows = df.select(node.alias("node"), w.alias("w"), (w * F.col(y)).alias("wy"), F.explode(F.array(*bins)).alias("b"))
    rows = rows if allowed is None else rows.withColumn("f", F.col("b.f")).filter(allowed).drop("f")
    cells = rows.groupBy("node", "b.f", "b.bin").agg(F.sum("w").alias("n"), F.sum("wy").alias("s"))
    part = Window.partitionBy("node", "f")
    run = part.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    c = cells.select("node", "f", "bin", F.sum("n").over(run).alias("nl"), F.sum("s").over(run).alias("sl"), F.sum("n").over(part).alias("n"), F.sum("s").over(part).alias("s"))
    c = c.withColumns({"nr": F.col("n") - F.col("nl"), "sr": F.col("s") - F.col("sl")})
    c = c.filter((F.col("nl") >= min_leaf) & (F.col("nr") >= min_leaf) & (F.col("nr") > 0))
    gain = F.abs(F.col("sl") - F.col("sr")) if opposed else F.expr("sl*sl/nl + sr*sr/nr - s*s/n")
    table = F.array(*[F.array(*[F.lit(v) for v in at]) for at in cuts.values()])
    # gains are compared after rounding, so that the order of summation settles no tie
    c = c.withColumn("gain", gain).withColumn("key", F.struct(F.round(gain, 9).alias("g"), (-F.col("f")).alias("f"), (-F.col("bin")).alias("b")))
    best = c.groupBy("node").agg(F.max_by(F.struct("f", "bin", "gain", "nl", "sl", "nr", "sr"), "key").alias("t")).select("node", "t.*")
    return best.select("node", "f", F.get(F.get(table, F.col("f")), F.col("bin")).alias("cut"), "gain", "nl", "sl", "nr", "sr")


def grow(df: DataFrame, cuts: dict[str, list[float]], y: str, depth: int = 2, min_leaf: float = 5, weight: Column | None = None) -> Tree:
    """A regression tree by squared error; a node without a fall in error stays a leaf."""
    w = weight if weight is not None else F.lit(1.0)
    tree, names = Tree(), list(cuts)
    df = df.dropna(subset=[*cuts, y])
    top = df.agg((F.sum(w * F.col(y)) / F.sum(w)).alias("m")).first()["m"]
    tree.values[1] = float(top) if top is not None else 0.0
    open_nodes = {1}
    for _ in range(depth):
        at = tree.node()
        found = best_splits(df.filter(at.isin(sorted(open_nodes))), cuts, y, at, weight, min_leaf).collect()
        open_nodes = set()
        for r in found:
            if r["gain"] <= 1e-12:
                continue
            i = r["node"]
            tree.splits[i] = (names[r["f"]], float(r["cut"]))
            tree.values[2 * i], tree.values[2 * i + 1] = r["sl"] / r["nl"], r["sr"] / r["nr"]
            open_nodes |= {2 * i, 2 * i + 1}
        if not open_nodes:
            break
    return tree


def forest(df: DataFrame, cuts: dict[str, list[float]], y: str, key: str, count: int, depth: int = 3, tried: int | None = None, seed: int = 0) -> Column:
    """Mean of trees grown on bootstrap weights of the key; ``tried`` features are drawn for each tree (all: bagging)."""
    rng, names, total = np.random.default_rng(seed), list(cuts), F.lit(0.0)
    for t in range(count):
        pick = sorted(rng.choice(len(names), tried or len(names), replace=False).tolist())
        total = total + grow(df, {names[k]: cuts[names[k]] for k in pick}, y, depth, weight=copies(F.col(key), seed + t).cast("double")).predict()
    return total / count


def boost(df: DataFrame, cuts: dict[str, list[float]], y: str, rounds: int, rate: float = 0.1, depth: int = 1, huber: float | None = None) -> Column:
    """Gradient boosting: each round fits a tree to the residuals of the sum so far (cut off at ``huber``); leaves are mean residuals."""
    start = df.agg(F.avg(y).alias("m")).first()["m"]
    fit = F.lit(float(start))
    for _ in range(rounds):
        r = F.col(y) - fit
        r = F.greatest(F.least(r, F.lit(huber)), F.lit(-huber)) if huber else r
        fit = fit + rate * grow(df.withColumn("r_", r), cuts, "r_", depth).predict()
    return fit


def adaboost(df: DataFrame, cuts: dict[str, list[float]], y: str, rounds: int) -> tuple[list[tuple[str, float, int, float, float]], Column]:
    """Stumps of opposite signs for y in {-1, 1}: (feature, cut, sign of the left side, error, vote) of each round, and the summed vote.

    Weights are a function of the votes so far, so nothing is written between rounds. Stops at error 0.5
    or more without that stump, and at 1e-12 or less after it.
    """
    names, out, vote = list(cuts), [], F.lit(0.0)
    for _ in range(rounds):
        w = F.exp(-F.col(y) * vote)
        r = best_splits(df, cuts, y, F.lit(1), w, 0, opposed=True).first()
        if r is None:
            break
        error = 0.5 * (1 - abs(r["sl"] - r["sr"]) / (r["nl"] + r["nr"]))
        if error >= 0.5:
            break
        sign = 1 if r["sl"] >= r["sr"] else -1
        name, cut = names[r["f"]], float(r["cut"])
        alpha = 0.5 * float(np.log((1 - max(error, 1e-12)) / max(error, 1e-12)))
        out.append((name, cut, sign, float(error), alpha))
        vote = vote + F.when(F.col(name) <= cut, alpha * sign).otherwise(-alpha * sign)
        if error <= 1e-12:
            break
    return out, vote
