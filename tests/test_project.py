import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenstat.operators import neural, project, pruning, trees


def frame(spark, x, names):
    return spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names))


def test_network_learns_and_its_gradient_is_right(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, (300, 2))
    df = frame(spark, np.column_stack([x, (x[:, 0] * 2 > x[:, 1])]), ["a", "b", "y"]).repartition(3).cache()
    net = neural.Network(["a", "b"], "y", 3, classify=True)
    f, w = df.toPandas(), net.w.copy()
    g = net._gradient(f, w)
    for i in range(len(w)):
        up, down = w.copy(), w.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        assert g[2 + i] == pytest.approx((net._gradient(f, up)[0] - net._gradient(f, down)[0]) / 2e-5, abs=1e-4)
    net.fit(df, 25, 2.0)
    assert net.path[-1] < 0.6 * net.path[0]
    assert df.agg(F.avg(F.when((net.predict() > 0.5) == (F.col("y") == 1), 1.0).otherwise(0.0))).first()[0] > 0.9
    assert neural.Network(["a"], "y").fit(df.filter("false"), 2).path == []


def test_boltzmann_rebuilds_its_rows(spark):
    df = frame(spark, [[1, 1, 0, 0], [0, 0, 1, 1]] * 40, list("abcd"))
    *_, path = neural.boltzmann(df, list("abcd"), 2, 25, 1.0)
    assert path[-1] < 0.7 * path[0]


def test_independent_components_part_two_sources(spark):
    rng = np.random.default_rng(6)
    s = rng.uniform(-1, 1, (800, 2))
    x = s @ np.array([[1.0, 0.4], [0.3, 1.0]])
    w, _ = project.independent(frame(spark, x, "ab"), ["a", "b"], 2, 20)
    c = np.abs(np.corrcoef(np.column_stack([(x - x.mean(0)) @ w.T, s]).T)[:2, 2:])
    assert c.max(1).min() > 0.98 and set(c.argmax(1)) == {0, 1}


def test_sparse_and_kernel_components(spark):
    rng = np.random.default_rng(7)
    z = rng.normal(size=(300, 2))
    x = np.column_stack([3 * z[:, 0], 3 * z[:, 0], 0.1 * z[:, 1], 0.1 * z[:, 1]]) + 0.01 * rng.normal(size=(300, 4))
    v = project.sparse_components(frame(spark, x, "abcd"), list("abcd"), 1, 0.5)[0]
    assert v[:2] == pytest.approx([0.5**0.5] * 2, abs=0.01) and not v[2:].any()
    p = np.vstack([rng.normal(0, 0.2, (15, 2)), rng.normal(4, 0.2, (15, 2))])
    df = frame(spark, p, "ab")
    value, cols = project.kernel_map(df, ["a", "b"], p.tolist(), 0.3, 2)
    k = np.exp(-0.3 * ((p[:, None] - p[None]) ** 2).sum(-1))
    h = np.eye(30) - 1 / 30
    assert value == pytest.approx(np.linalg.eigvalsh(h @ k @ h)[::-1][:2] / 30, abs=1e-8)
    got = df.select("a", cols[0].alias("c")).toPandas()
    side = np.sign(got.c)
    assert len(set(side[got.a < 2])) == len(set(side[got.a > 2])) == 1 and side[got.a < 2].iloc[0] != side[got.a > 2].iloc[0]
    value, _ = project.kernel_map(df, ["a", "b"], p.tolist(), 0.3, 2, normal=True)
    d = k.sum(1)
    assert value == pytest.approx(np.linalg.eigvalsh(k / np.sqrt(np.outer(d, d)))[::-1][:2], abs=1e-6)


def test_scaling_gives_the_distances_back():
    p = np.random.default_rng(8).normal(size=(6, 2))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    q, _ = project.classical_scaling(d, 2)
    assert np.sqrt(((q[:, None] - q[None]) ** 2).sum(-1)) == pytest.approx(d)


def test_pruning_and_rules(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 10, (300, 2))
    y = np.where(x[:, 0] <= 4, 0.0, 5.0) + np.where(x[:, 1] <= 2, 0.0, 1.0)
    df = frame(spark, np.column_stack([x, y]), ["a", "b", "y"]).cache()
    tree = trees.grow(df, {c: trees.midpoints(df, c) for c in "ab"}, "y", 2)
    path = pruning.pruned(df, tree, "y")
    assert [len(t.values) for _, t in path] == sorted([len(t.values) for _, t in path], reverse=True)
    assert path[-1][1].values[1] == pytest.approx(y.mean()) and all(a[0] <= b[0] + 1e-9 for a, b in zip(path, path[1:]))
    assert len(pruning.conditions(tree)) == 6
    coef, fit = pruning.rule_ensemble(df, [tree], ["a", "b"], "y", 0.01)
    assert df.agg(F.avg(F.pow(F.col("y") - fit, F.lit(2)))).first()[0] < 0.05 * y.var() and "(intercept)" in coef
