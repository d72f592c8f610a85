import numpy as np
import pytest

from lumenstat.operators.baskets import pair_rules, supports
from lumenstat.operators.cluster import kmeans, neighbours
from lumenstat.operators.evaluate import auc
from lumenstat.operators.graph import pagerank
from lumenstat.operators.linear import LeastSquares, coordinate_descent, least_angle
from lumenstat.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_runs_with_stable_schema(spark, name):
    df = registry.queries()[name](spark, SF)
    assert df.columns == df.toPandas().columns.tolist()
    assert df.count() > 0


def test_oracles_have_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_least_squares_identities(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = 1 + x @ [2.0, -3.0] + rng.normal(size=200)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, y double")
    fit = LeastSquares(df, ["a", "b"], "y")
    want, *_ = np.linalg.lstsq(np.hstack([np.ones((200, 1)), x]), y, rcond=None)
    assert np.allclose(fit.beta, want)
    r = df.select((df.y - fit.predict()).alias("e"), "a", fit.leverage().alias("h")).toPandas()
    assert abs((r.e * r.a).sum()) < 1e-8 and abs(r.h.sum() - 3) < 1e-8


def test_lasso_and_least_angle_end_at_least_squares():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(100, 4))
    x = (x - x.mean(0)) / x.std(0)
    y = x @ [3, 0, -2, 1] + rng.normal(size=100)
    y -= y.mean()
    ols = np.linalg.solve(x.T @ x, x.T @ y)
    assert np.allclose(coordinate_descent(x.T @ x, x.T @ y, 100, 0.0), ols, atol=1e-6)
    assert np.allclose(least_angle(x.T @ x, x.T @ y)[-1], ols, atol=1e-8)
    assert not coordinate_descent(x.T @ x, x.T @ y, 100, 1e3).any()


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, p double")
    assert auc(df, df.y, df.p).first()[0] == pytest.approx(0.875)


def test_kmeans_keeps_empty_centre_and_knn_ties_take_least_id(spark):
    df = spark.createDataFrame([(i, float(i % 2) * 10) for i in range(8)], "id long, x double")
    centres, out = kmeans(df, ["x"], [[0.0], [10.0], [99.0]], 3)
    assert centres == [[0.0], [10.0], [99.0]] and out.select("cluster").distinct().count() == 2
    v = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [-1.0])], "id long, v array<double>")
    assert neighbours(v.filter("id = 0"), v, 1, "id", "v").first()["id"] == 1


def test_rules_and_pagerank(spark):
    items = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a")], "txn long, item string")
    assert {r.itemset: r.n for r in supports(items, 2, 0.1).collect()} == {"a": 3, "b": 2, "a,b": 2}
    assert pair_rules(items, 0.1).filter("lhs = 'b'").first()["conviction"] == float("inf")
    nodes = spark.createDataFrame([(i,) for i in range(3)], "id long")
    rank = pagerank(nodes, spark.createDataFrame([(0, 1), (1, 0)], "src long, dst long"), 4)
    assert sum(r["rank"] for r in rank.collect()) == pytest.approx(1)
