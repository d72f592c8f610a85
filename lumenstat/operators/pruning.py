"""Weakest-link pruning of trees and ensembles of their rules."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstat.operators.linear import coordinate_descent, gram, matrix
from lumenstat.operators.trees import Tree


def pruned(df: DataFrame, tree: Tree, y: str) -> list[tuple[float, Tree]]:
    """(alpha, tree) from the whole tree to its root: each alpha is where the next subtree stops paying for its leaves. One aggregation by leaf."""
    x = {name for name, _ in tree.splits.values()}
    got = df.dropna(subset=[*x, y]).groupBy(tree.node().alias("i")).agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(F.col(y) * F.col(y)).alias("q")).collect()
    sums = {r["i"]: np.array([r["n"], r["s"], r["q"]], float) for r in got}
    for i in sorted(tree.splits, reverse=True):
        sums[i] = sums.get(2 * i, np.zeros(3)) + sums.get(2 * i + 1, np.zeros(3))
    error = {i: float(v[2] - v[1] ** 2 / v[0]) if v[0] else 0.0 for i, v in sums.items()}

    def leaves(splits: dict, i: int) -> list[int]:
        return [i] if i not in splits else leaves(splits, 2 * i) + leaves(splits, 2 * i + 1)

    def under(k: int, i: int) -> bool:
        while k > i:
            k //= 2
        return k == i

    def made(splits: dict) -> Tree:
        return Tree(dict(splits), {i: float(sums[i][1] / sums[i][0]) if i in sums and sums[i][0] else tree.values.get(i, 0.0) for i in leaves(splits, 1)})

    splits, out = dict(tree.splits), [(0.0, made(tree.splits))]
    while splits:
        cost = {i: (error[i] - sum(error.get(j, 0.0) for j in leaves(splits, i))) / (len(leaves(splits, i)) - 1) for i in splits}
        least = min(cost.values())
        for i in [i for i, c in cost.items() if c <= least + 1e-12]:
            splits = {k: v for k, v in splits.items() if not under(k, i)}
        out.append((max(least, 0.0), made(splits)))
    return out


def conditions(tree: Tree) -> list[tuple[str, Column]]:
    """Every node but the root as (text, 0/1 column): all of its splits hold."""
    out = []

    def walk(i: int, text: list[str], holds: Column) -> None:
        if text:
            out.append((" and ".join(text), F.when(holds, 1.0).otherwise(0.0)))
        if i in tree.splits:
            name, cut = tree.splits[i]
            walk(2 * i, [*text, f"{name} <= {cut:g}"], holds & (F.col(name) <= cut))
            walk(2 * i + 1, [*text, f"{name} > {cut:g}"], holds & (F.col(name) > cut))

    walk(1, [], F.lit(True))
    return out


def rule_ensemble(df: DataFrame, trees: list[Tree], x: list[str], y: str, penalty: float) -> tuple[dict[str, float], Column]:
    """Lasso over the distinct rules of the trees and the columns x, each scaled by its deviation: coefficients that are not 0 (with "(intercept)"), and the prediction."""
    rules = dict(pair for t in trees for pair in conditions(t))
    terms = rules | {c: F.col(c).cast("double") for c in x}
    names = [f"t{i}" for i in range(len(terms))]
    data = df.dropna(subset=[*x, y]).select(*[c.alias(n) for n, c in zip(names, terms.values(), strict=True)], F.col(y).alias("y_"))
    m = matrix(gram(data, names, "y_").first(), len(names) + 2)
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    cov = m[1:, 1:] - n * np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:-1] / n, 0))
    use = np.flatnonzero(sd > 1e-9)
    b = np.zeros(len(names))
    b[use] = coordinate_descent(cov[np.ix_(use, use)] / np.outer(sd[use], sd[use]), cov[use, -1] / sd[use], n, penalty) / sd[use]
    start = float(mean[-1] - b @ mean[:-1])
    kept = {k: float(v) for k, v in zip(terms, b, strict=True) if v}
    return {"(intercept)": start, **kept}, sum((v * terms[k] for k, v in kept.items()), F.lit(start))
