"""Ensembles, local fits, experts, pursuit, curves and unit energies."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenstat.operators import ensembles, local, signals
from lumenstat.operators.trees import Tree, grow


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    x = rng.uniform(-1, 1, size=(400, 3))
    y = np.where(x[:, 0] > 0, 2.0, -1.0) + 0.5 * x[:, 1] + 0.1 * rng.normal(size=400)
    z = (rng.random(400) < 1 / (1 + np.exp(-4 * x[:, 0]))).astype(int)
    data = [(i, *map(float, np.round(r, 2)), float(v), int(c), i % 4) for i, (r, v, c) in enumerate(zip(x, y, z))]
    return spark.createDataFrame(data, "id long, a double, b double, c double, y double, z int, fold int").cache()


CUTS = {n: [-0.5, 0.0, 0.5] for n in "abc"}


def test_trees_and_forests(rows):
    tree = grow(rows, CUTS, "y", 2)
    assert ensembles.nodes(tree) == 2 * len(ensembles.leaves(tree)) - 1 and ensembles.depth(tree) <= 2 and ensembles.printed(tree)[0] == "a <= 0"
    assert ensembles.depth(Tree({}, {1: 1.0})) == 0 and ensembles.printed(Tree({}, {1: 1.0})) == ["-> 1"]
    p = rows.toPandas()
    got = ensembles.importance(rows, [Tree({1: ("a", 0.0)}, {})], ["a", "b"], "y")
    left, right = p.y[p.a <= 0], p.y[p.a > 0]
    assert got["b"] == 0 and got["a"] == pytest.approx(len(left) * (left.mean() - p.y.mean()) ** 2 + len(right) * (right.mean() - p.y.mean()) ** 2)
    f = ensembles.Forest(rows, CUTS, "y", "id", count=5, depth=2, tried=2)
    assert f.error(rows) < 0.5 * p.y.var() and f.correlation(rows)[1] <= 1.0001
    imp = f.permutation_importance(rows)
    assert imp["a"] > 10 * abs(imp["c"]) and imp["a"] > imp["b"]


def test_logistic_boosting(rows):
    score, trees, path = ensembles.logistic_boost(rows, CUTS, "z", 4, 0.5)
    assert len(trees) == 4 and all(a > b for a, b in zip(path, path[1:])) and path[0] == pytest.approx(0.69, abs=0.02)
    assert rows.select(F.avg(F.when((score > 0) == (F.col("z") == 1), 1.0).otherwise(0.0))).first()[0] > 0.75


def test_local_fits(rows):
    p = rows.toPandas()
    got = local.local_polynomial(rows, ["b"], "y", [[0.0], [0.5], [99.0]], 0.8, 2, "epanechnikov", ridge=0.0)
    for i, at in ((0, 0.0), (1, 0.5)):
        u = (p.b - at) / 0.8
        w = np.where(u.abs() < 1, 0.75 * (1 - u**2), 0)
        t = np.column_stack([np.ones(len(p)), p.b - at, (p.b - at) ** 2])
        want = np.linalg.solve((t * w[:, None]).T @ t, t.T @ (w * p.y))[0]
        assert got[i][1] == pytest.approx(want)
    assert math.isnan(got[2][1])
    two = local.local_polynomial(rows, ["a", "b"], "y", [[0.5, 0.0]], 0.6, 1, "tricube", np.diag([1.0, 0.25]))
    assert two[0][1] == pytest.approx(2, abs=0.3)
    h = local.nearest_share(rows, "b", [0.0], 0.25)[0]
    assert (p.b.abs() <= h).sum() >= 100 and (p.b.abs() < h * 0.98).sum() <= 105
    cv = local.local_cv(rows, "a", "y", "fold", [0.3, 3.0])
    assert cv[0][1] < cv[1][1]


def test_experts_and_pursuit(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-2, 2, 400)
    y = np.where(x > 0.3, 3 * x, -2 * x + 1) + 0.1 * rng.normal(size=400)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    m = local.Experts(df, ["x"], "y", steps=8)
    error = df.select(F.avg(F.pow(F.col("y") - m.predict(), F.lit(2))), F.min(m.predict_variance())).first()
    assert m.path[-1] > m.path[0] and error[0] < 0.5 and error[1] > 0
    w = rng.normal(size=(500, 3))
    v = np.tanh(2 * (w @ [0.8, -0.6, 0.0]))
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(w, v)], "a double, b double, c double, y double")
    p = local.Pursuit(df, ["a", "b", "c"], "y")
    assert abs(p.parts[0][0] @ [0.8, -0.6, 0.0]) > 0.97
    assert df.select(F.avg(F.pow(F.col("y") - p.predict(), F.lit(2)))).first()[0] < 0.05 * v.var()


def test_principal_curve(spark):
    rng = np.random.default_rng(3)
    t = rng.uniform(-1, 1, 300)
    df = spark.createDataFrame([(float(a), float(a * a + 0.02 * e)) for a, e in zip(t, rng.normal(size=300))], "x double, y double")
    _, points, path = local.principal_curve(df, ["x", "y"], rounds=3)
    assert points.shape == (101, 2) and path[-1] <= path[0] + 1e-9 and path[-1] < 0.005


def test_boltzmann_sums():
    rng = np.random.default_rng(4)
    w, a, b = rng.normal(size=(3, 2)), rng.normal(size=3), rng.normal(size=2)
    total = sum(math.exp(np.dot(a, v) + np.dot(b, h) + np.array(v) @ w @ np.array(h)) for v in itertools.product([0, 1], repeat=3) for h in itertools.product([0, 1], repeat=2))
    assert local.boltzmann_log_partition(w, a, b) == pytest.approx(math.log(total))
    states = local.boltzmann_gibbs(np.zeros((2000, 3)), w, a, b, steps=20)
    p = {v: sum(math.exp(np.dot(a, v) + np.dot(b, h) + np.array(v) @ w @ np.array(h)) for h in itertools.product([0, 1], repeat=2)) / total for v in itertools.product([0, 1], repeat=3)}
    for v, q in p.items():
        assert (states == np.array(v)).all(1).mean() == pytest.approx(q, abs=0.05)


def test_wavelet_levels(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([3, 1, 4, 1, 5, 9, 2])], "p long, x double")
    t = signals.haar_levels(df, "p", "x", 3)
    assert [r.value for r in signals.haar_rebuilt(t, 3).orderBy("place").collect()][:7] == pytest.approx([3, 1, 4, 1, 5, 9, 2])
    assert signals.nonzero_details(signals.without_fine_levels(t, 2)).filter("nonzero > 0").count() == 1
    flat = signals.haar_rebuilt(signals.thresholded(t, 1e9), 3).collect()
    assert len({round(r.value, 9) for r in flat}) == 1
