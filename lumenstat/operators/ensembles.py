"""Looking into trees and ensembles: size, rules, importance, rows left out; random forests with features drawn at each split; logistic boosting."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstat.operators.order import permuted
from lumenstat.operators.resample import poisson_copies
from lumenstat.operators.signals import sigmoid, softplus
from lumenstat.operators.trees import Tree, best_splits, grow


def leaves(tree: Tree) -> list[int]:
    """Numbers of the leaves that can be reached, left to right at each depth."""
    return sorted(i for i in ({1} | {c for k in tree.splits for c in (2 * k, 2 * k + 1)}) if i not in tree.splits)


def nodes(tree: Tree) -> int:
    return len(tree.splits) + len(leaves(tree))


def depth(tree: Tree) -> int:
    return max(i.bit_length() for i in leaves(tree)) - 1


def printed(tree: Tree, at: int = 1, indent: str = "") -> list[str]:
    """A line for each split and leaf."""
    if at not in tree.splits:
        return [f"{indent}-> {tree.values[at]:.6g}"]
    name, cut = tree.splits[at]
    return [f"{indent}{name} <= {cut:.6g}", *printed(tree, 2 * at, indent + "  "), f"{indent}{name} > {cut:.6g}", *printed(tree, 2 * at + 1, indent + "  ")]


def importance(df: DataFrame, trees: list[Tree], x: list[str], y: str, weights: list[Column] | None = None) -> dict[str, float]:
    """Fall in squared error at the splits of each variable, summed over trees: one aggregation over leaves a tree; inner nodes follow from their leaves."""
    out = dict.fromkeys(x, 0.0)
    data = df.dropna(subset=[*x, y])
    for k, tree in enumerate(trees):
        w = weights[k] if weights else F.lit(1.0)
        sums = {r["node"]: np.array([r["n"], r["s"]]) for r in data.groupBy(tree.node().alias("node")).agg(F.sum(w).cast("double").alias("n"), F.sum(w * F.col(y)).cast("double").alias("s")).collect()}
        for i in sorted(tree.splits, reverse=True):
            left, right = (sums.get(c, np.zeros(2)) for c in (2 * i, 2 * i + 1))
            sums[i] = left + right
            square = lambda v: v[1] ** 2 / v[0] if v[0] else 0.0
            out[tree.splits[i][0]] += float(square(left) + square(right) - square(sums[i]))
    return out


def grow_drawn(df: DataFrame, cuts: dict[str, list[float]], y: str, depth_: int, tried: int, rng: np.random.Generator, weight: Column | None = None, min_leaf: float = 5) -> Tree:
    """A regression tree that looks at ``tried`` features drawn anew for each node."""
    w, tree, names = weight if weight is not None else F.lit(1.0), Tree(), list(cuts)
    data = df.dropna(subset=[*cuts, y])
    top = data.agg((F.sum(w * F.col(y)) / F.sum(w)).alias("m")).first()["m"]
    tree.values[1] = float(top) if top is not None else 0.0
    todo = {1}
    for _ in range(depth_):
        may = " OR ".join(f"(node = {i} AND f IN ({', '.join(map(str, sorted(rng.choice(len(names), tried, replace=False).tolist())))}))" for i in sorted(todo))
        at = tree.node()
        found = best_splits(data.filter(at.isin(sorted(todo))), cuts, y, at, weight, min_leaf, allowed=F.expr(may)).collect()
        todo = set()
        for r in (r for r in found if r["gain"] > 1e-12):
            i = r["node"]
            tree.splits[i] = (names[r["f"]], float(r["cut"]))
            tree.values[2 * i], tree.values[2 * i + 1] = r["sl"] / r["nl"], r["sr"] / r["nr"]
            todo |= {2 * i, 2 * i + 1}
        if not todo:
            break
    return tree


class Forest:
    """Trees on replicates drawn by the digest of the key; a row that a replicate does not draw is out of that tree's bag."""

    def __init__(self, df: DataFrame, cuts: dict[str, list[float]], y: str, key: str, count: int = 10, depth: int = 3, tried: int | None = None, seed: int = 0) -> None:
        self.x, self.y, self.key, rng = list(cuts), y, key, np.random.default_rng(seed)
        self.drawn = [poisson_copies(key, seed * 1000 + t) for t in range(count)]
        self.trees = [grow_drawn(df, cuts, y, depth, tried or len(cuts), rng, w.cast("double")) for w in self.drawn]

    def predict(self) -> Column:
        """The mean of all trees; of trees on a 0/1 column, the mean probability."""
        return sum((t.predict() for t in self.trees), F.lit(0.0)) / len(self.trees)

    def out_of_bag(self) -> Column:
        """The mean of the trees that did not draw the row; null where all did."""
        out = [F.when(w == 0, t.predict()) for w, t in zip(self.drawn, self.trees, strict=True)]
        total, n = sum((F.coalesce(o, F.lit(0.0)) for o in out), F.lit(0.0)), sum((F.when(w == 0, 1).otherwise(0) for w in self.drawn), F.lit(0))
        return F.when(n > 0, total / n)

    def error(self, df: DataFrame) -> float:
        return df.agg(F.avg(F.pow(F.col(self.y) - self.out_of_bag(), F.lit(2)))).first()[0]

    def correlation(self, df: DataFrame) -> tuple[float, float]:
        """Mean correlation of two trees' predictions, and the variance of their mean over the mean variance of a tree."""
        p = [f"_t{k}" for k in range(len(self.trees))]
        data = df.dropna(subset=self.x).select(*[t.predict().alias(n) for t, n in zip(self.trees, p, strict=True)])
        every = sum((F.col(n) for n in p), F.lit(0.0)) / len(p)
        pairs = list(itertools.combinations(p, 2))
        row = data.agg(*[F.corr(a, b).alias(f"{a}{b}") for a, b in pairs], *[F.var_pop(n).alias(n) for n in p], F.var_pop(every).alias("all")).first()
        found = [row[f"{a}{b}"] for a, b in pairs if row[f"{a}{b}"] is not None]
        return float(np.mean(found)) if found else float("nan"), row["all"] / max(float(np.mean([row[n] for n in p])), 1e-300)

    def permutation_importance(self, df: DataFrame, seed: int = 1) -> dict[str, float]:
        """Rise of each tree's error on its rows out of the bag when a feature is dealt anew, averaged over trees: a join of ranks for each
        feature, then one aggregation for all trees and features."""
        data = df.dropna(subset=[*self.x, self.y]).select(self.key, *self.x, self.y)
        wide = data
        for k, c in enumerate(self.x):
            wide = wide.join(permuted(data.select(self.key, c), c, self.key, seed + k).select(self.key, F.col(c).alias(f"_p{k}")), self.key)
        sums = []
        for t, (w, tree) in enumerate(zip(self.drawn, self.trees, strict=True)):
            e = lambda p: F.avg(F.when(w == 0, F.pow(F.col(self.y) - p, F.lit(2))))  # noqa: B023, E731
            sums.append(e(tree.predict()).alias(f"b{t}"))
            for k, c in enumerate(self.x):
                other = Tree({i: (f"_p{k}" if n == c else n, cut) for i, (n, cut) in tree.splits.items()}, tree.values)
                sums.append(e(other.predict()).alias(f"e{t}_{k}"))
        row = wide.agg(*sums).first()
        rises = {c: [row[f"e{t}_{k}"] - row[f"b{t}"] for t in range(len(self.trees)) if row[f"b{t}"] is not None] for k, c in enumerate(self.x)}
        return {c: float(np.mean(v)) if v else 0.0 for c, v in rises.items()}


def logistic_boost(df: DataFrame, cuts: dict[str, list[float]], y: str, rounds: int, rate: float = 0.1, depth_: int = 1) -> tuple[Column, list[Tree], list[float]]:
    """Boosting of the log odds of a 0/1 column: each tree follows the negative gradient y - p, its leaves take a Newton step.

    Returns the score, the trees and the mean loss before each round and at the end.
    """
    data = df.dropna(subset=[*cuts, y])
    p0 = float(np.clip(data.agg(F.avg(y).cast("double")).first()[0] or 0.5, 1e-6, 1 - 1e-6))
    score, trees, path = F.lit(float(np.log(p0 / (1 - p0)))), [], []
    for _ in range(rounds):
        p = sigmoid(score)
        tree = grow(data.withColumn("_r", F.col(y) - p), cuts, "_r", depth_)
        sums = [F.sum(F.col(y) - p).alias("g"), F.sum(p * (1 - p)).alias("h"), F.sum(softplus(score) - F.col(y) * score).alias("loss"), F.count("*").alias("n")]
        rows = data.groupBy(tree.node().alias("node")).agg(*sums).collect()
        path.append(sum(r["loss"] for r in rows) / sum(r["n"] for r in rows))
        tree.values |= {r["node"]: r["g"] / max(r["h"], 1e-9) for r in rows}
        trees.append(tree)
        score = score + rate * tree.predict()
    path.append(data.agg(F.avg(softplus(score) - F.col(y) * score)).first()[0])
    return score, trees, path
