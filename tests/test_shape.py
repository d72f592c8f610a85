import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenstat.operators import baskets, boxes, chains, cluster, graph, margin, reduce


def _frame(spark, x, names):
    return spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names))


def test_components_are_orthonormal_and_carry_all_variance(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 3))
    y = x @ [1.0, 2.0, -1.0] + 5
    df = _frame(spark, np.c_[x, y], ["a", "b", "c", "y"])
    c = reduce.Components(df, ["a", "b", "c"])
    assert np.allclose(c.axes.T @ c.axes, np.eye(3)) and c.share.sum() == pytest.approx(1)
    got = df.select(*[c.score(k).alias(f"s{k}") for k in range(3)]).toPandas().to_numpy()
    assert np.allclose(np.cov(got.T), np.diag(c.variance), atol=1e-8)
    b0, b = reduce.component_regression(df, ["a", "b", "c"], "y", 3)
    assert np.allclose([b0, *b], [5, 1, 2, -1])


def test_svc_lowers_its_objective(spark):
    rng = np.random.default_rng(2)
    y = np.where(rng.random(200) < 0.5, 1.0, -1.0)
    df = _frame(spark, np.c_[rng.normal(size=(200, 2)) + 2 * y[:, None], y], ["a", "b", "y"])
    w, b, path = margin.svc(df, ["a", "b"], "y", 0.1, 0.05, 15)
    assert path[-1] < 0.2 * path[0]
    assert df.filter(F.when(margin.margin(["a", "b"], w, b) >= 0, 1).otherwise(-1) != F.col("y")).count() < 10


def test_peeling_finds_the_bump_and_keeps_support(spark):
    rng = np.random.default_rng(4)
    x = rng.random((500, 2))
    y = ((x[:, 0] > 0.6) & (x[:, 1] < 0.5)).astype(float)
    df = _frame(spark, np.c_[x, y], ["a", "b", "y"])
    path = boxes.peel(df, ["a", "b"], "y", 0.1, 0.15)
    assert path[-1][4] > 0.9 and min(p[3] for p in path) >= 0.15
    assert all(p[4] < q[4] for p, q in zip(path, path[1:]))
    empty = boxes.box_statistics(df, "y", {"a": (5.0, 6.0)}).first()
    assert empty["n"] == 0 and empty["mean"] is None
    assert boxes.peel(df.filter("false"), ["a"], "y") == []


def test_chain_diagnostics(spark):
    draws = chains.metropolis(spark, lambda x: -0.5 * x * x, 3, 400, 2.4, seed=5).cache()
    again = chains.metropolis(spark, lambda x: -0.5 * x * x, 3, 400, 2.4, seed=5)
    assert draws.exceptAll(again).isEmpty()
    assert chains.rhat(draws).first()[0] < 1.1
    for r in chains.effective_size(draws, 50).collect():
        v = np.array([x["value"] for x in draws.filter(F.col("chain") == r["chain"]).orderBy("step").collect()])
        c, s = v - v.mean(), 0.0
        for lag in range(1, 51):
            rho = c[lag:] @ c[:-lag] / (c @ c)
            if rho < 0:
                break
            s += rho
        assert r["ess"] == pytest.approx(400 / (1 + 2 * s))


def test_borders_graph_tables_and_rand(spark):
    items = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a")], "txn long, item string")
    found = baskets.supports(items, 2, 0.1)
    assert {r.itemset for r in baskets.closed(found).collect()} == {"a", "a,b"}
    assert {r.itemset for r in baskets.maximal(found).collect()} == {"a,b"}
    nodes, edges = spark.range(3), spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "src long, dst long")
    assert {tuple(r) for r in graph.degrees(nodes, edges).collect()} == {(0, 2, 0, False), (1, 1, 1, False), (2, 0, 2, True)}
    assert graph.transition(edges).filter("src = 0").first()["probability"] == 0.5
    home = spark.createDataFrame([(0, 2.0)], "id long, weight double")
    want, jump = np.full(3, 1 / 3), np.array([1.0, 0, 0])
    step = np.array([[0, 0.5, 0.5], [0, 0, 1], [1, 0, 0]])  # the dangling node jumps home
    for _ in range(3):
        want = 0.15 * jump + 0.85 * want @ step
    assert np.allclose([r["rank"] for r in graph.pagerank(nodes, edges, 3, teleport=home).orderBy("id").collect()], want)
    same = spark.createDataFrame([(i, i % 3, (i % 3) * 7) for i in range(9)], "id long, a long, b long")
    assert tuple(cluster.rand_index(same, "a", "b").first()) == (1.0, 1.0)
    s = cluster.sums_of_squares(same, "a", ["id"]).first()
    assert s["total"] == pytest.approx(60) and s["within"] == pytest.approx(54) and s["between"] == pytest.approx(6)
