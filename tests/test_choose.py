import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenstat.operators import baskets, cluster, margin, order, select


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3))
    y = 1 + 2 * x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=200)
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))] + [(200, None, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double").cache()


def test_support_vector_regression_lowers_its_objective(points):
    w, b, path = margin.svr(points, ["a", "b"], "y", epsilon=0.2, rate=0.002, steps=40)
    assert path[-1] < 0.2 * path[0] and w[0] > 1.5 and w[1] < -0.6
    assert margin.svr_objective(points.dropna(), ["a", "b"], "y", w, b, 1.0, 0.2).first()[0] <= path[0]
    assert list(margin.svr(points.filter("false"), ["a"], "y", steps=2)[0]) == [0.0]


def test_perceptron_separates(points):
    df = points.withColumn("s", F.when(F.col("a") + F.col("b") > 0, 1).otherwise(-1)).filter("abs(a + b) > 0.3")
    for parts in (1, 3):
        w, errors = margin.perceptron(df.repartition(parts), ["a", "b"], "s", epochs=30)
        assert errors == 0 and w[1] > 0 and w[2] > 0
    assert margin.perceptron(df.filter("false"), ["a"], "s")[1] == 0


def test_ranks_folds_and_permutations(spark, points):
    df = spark.range(1000).select("id", F.when(F.col("id") < 700, "x").when(F.col("id") < 990, "y").alias("k"))
    assert sorted(r["r"] for r in order.ranked(df, "id", "r", buckets=7).collect()) == list(range(1000))
    n = order.stratified_folds(df, "k", "id", 3).groupBy("k", "fold").count().collect()
    for k in ("x", "y", None):
        sizes = [r["count"] for r in n if r["k"] == k]
        assert len(sizes) == 3 and max(sizes) - min(sizes) <= 1
    own = points.select("id", "c").dropna()
    new = order.permuted(own, "c", "id", 2)
    assert sorted(r["c"] for r in new.collect()) == sorted(r["c"] for r in own.collect())
    assert new.exceptAll(own).count() > 150
    got = order.permutation_importance(points, ["a", "b", "c"], "y", "id", 1 + 2 * F.col("a") - F.col("b"))
    assert got["a"] > got["b"] > 0.5 and got["c"] == pytest.approx(0)


def test_runs(spark):
    df = spark.createDataFrame([(t, v) for t, v in enumerate([0.0, 0.0, 1.0, 1.0, 1.005, 0.0])], "t int, v double")
    assert [r["segment"] for r in order.segments(df, "t", "v").orderBy("t").collect()] == [1, 1, 2, 2, 2, 3]
    assert tuple(order.total_variation(df, "t", "v").first()) == (pytest.approx(2.01), 3)
    assert [tuple(r) for r in order.active_intervals(df, "t", F.col("v") > 0).collect()] == [(2, 4, 3)]
    assert order.active_intervals(df.filter("false"), "t", F.col("v") > 0).count() == 0


def test_bumping_and_averaging(points):
    beta, e, _ = select.bumping(points, ["a", "b"], "y", "id", 5)
    assert beta == pytest.approx([1, 2, -1], abs=0.05) and e < 0.02
    mean, fits = select.averaged(points, ["a", "b", "c"], "y")
    assert mean[:3] == pytest.approx([1, 2, -1], abs=0.05) and abs(mean[3]) < 0.05
    assert sum(f[2] for f in fits) == pytest.approx(1) and len(fits) == 8 and {"a", "b"} <= set(fits[0][0])


def test_fused_lasso_joins_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6))
    y = x @ [2, 2, 2, 0, 0, 0] + 0.1 * rng.normal(size=300)
    names = [f"x{i}" for i in range(6)]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], ", ".join(f"{c} double" for c in [*names, "y"]))
    b = select.fused_lasso(df, names, "y", 0.05, 0.2)
    assert np.abs(np.diff(b))[[0, 1, 3, 4]] == pytest.approx(0, abs=0.02) and b[1] - b[4] > 1.3
    zero = select.fused_lasso(df, names, "y", 0.0, 0.0)
    xc, yc = x - x.mean(0), y - y.mean()
    assert zero == pytest.approx(np.linalg.lstsq(xc, yc, rcond=None)[0], abs=1e-5)


def test_silhouettes_equal_all_pairs(points):
    df = points.dropna().withColumn("k", F.when(F.col("id") == 7, 9).otherwise(F.col("id") % 3))
    got = {r["id"]: r["silhouette"] for r in cluster.silhouettes(df, "k", ["a", "b"]).collect()}
    rows = [(r["id"], r["k"], np.array([r["a"], r["b"]])) for r in df.collect()]
    for i, k, v in rows[:20]:
        far = {c: [((v - w) ** 2).sum() for j, l, w in rows if l == c and j != i] for c in {r[1] for r in rows}}
        own, other = far.pop(k), min(np.mean(f) for f in far.values())
        assert got[i] == pytest.approx(0 if not own else (other - np.mean(own)) / max(other, np.mean(own)), abs=1e-9)


def test_rules_and_redundancy_by_brute_force(spark):
    rng = np.random.default_rng(2)
    txns = [sorted({str(c) for c in rng.choice(list("abcd"), size=3)}) for _ in range(60)]
    items = spark.createDataFrame([(t, i) for t, s in enumerate(txns) for i in s], "txn int, item string")
    found = baskets.rules(baskets.supports(items, 3, 0.02))
    count = lambda s: sum(set(s) <= set(t) for t in txns)
    want = {}
    for size in (2, 3):
        for s in itertools.combinations("abcd", size):
            if count(s) >= 0.02 * len(txns):
                want |= {(",".join(i for i in s if i != r), r): count(s) / count([i for i in s if i != r]) for r in s}
    got = {(r["lhs"], r["rhs"]): r["confidence"] for r in found.collect()}
    assert got == pytest.approx(want)
    keep = {k for k, c in want.items() if not any(r == k[1] and set(lhs.split(",")) < set(k[0].split(",")) and d >= c - 1e-12 for (lhs, r), d in want.items())}
    assert {(r["lhs"], r["rhs"]) for r in baskets.without_redundant(found).collect()} == keep
