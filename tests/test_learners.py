import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenstat.operators import classify, resample, trees


@pytest.fixture(scope="module")
def curve(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 20, size=(400, 2))
    y = np.where(x[:, 0] <= 7, 1.0, 4.0) + np.where(x[:, 1] <= 3, 2.0, 0.0)
    rows = [(i, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y))] + [(400, None, 1.0, 9.0)]
    return spark.createDataFrame(rows, "id long, a double, b double, y double").cache()


def test_tree_finds_the_steps_and_leaves_nulls_out(curve):
    cuts = {c: trees.midpoints(curve, c) for c in ("a", "b")}
    tree = trees.grow(curve, cuts, "y", 2)
    assert tree.splits == {1: ("a", 7.5), 2: ("b", 3.5), 3: ("b", 3.5)}
    assert curve.dropna().agg(F.max(F.abs(F.col("y") - tree.predict()))).first()[0] == pytest.approx(0)
    assert trees.grow(curve.filter("false"), cuts, "y", 2).values == {1: 0.0}


def test_forest_and_boosting_lower_the_error(curve):
    df = curve.dropna()
    cuts = {c: trees.quantile_cuts(df, c, 19) for c in ("a", "b")}
    base = df.agg(F.var_pop("y")).first()[0]
    for fit in (trees.forest(df, cuts, "y", "id", 4, 2), trees.boost(df, cuts, "y", 4, 0.5, 1), trees.boost(df, cuts, "y", 3, 0.5, 1, huber=1.0)):
        assert df.agg(F.avg(F.pow(F.col("y") - fit, F.lit(2)))).first()[0] < 0.5 * base


def test_adaboost_stops_at_a_perfect_stump(curve):
    df = curve.dropna().withColumn("z", F.when(F.col("a") <= 7, 1).otherwise(-1))
    rounds, vote = trees.adaboost(df, {"a": trees.midpoints(df, "a")}, "z", 5)
    assert len(rounds) == 1 and rounds[0][:3] == ("a", 7.5, 1)
    assert df.filter(F.signum(vote) != F.col("z")).count() == 0


def test_discriminants_and_logistic(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 300)
    x = rng.normal(size=(300, 2)) + y[:, None] * 2
    df = spark.createDataFrame([(float(a), float(b), int(v)) for (a, b), v in zip(x, y)], "a double, b double, y int")
    m = classify.Moments(df, "y", ["a", "b"])
    for kind in ("linear", "diagonal", "quadratic"):
        wrong = df.filter(classify.first_best(m.labels, classify.discriminants(m, kind)) != F.col("y")).count()
        assert wrong < 45
    beta = classify.logistic(df, ["a", "b"], "y")
    p = 1 / (1 + np.exp(-(beta[0] + x @ beta[1:])))
    assert np.abs((y - p) @ np.c_[np.ones(300), x]).max() < 1e-6


def test_bootstrap_and_mixture(spark):
    df = spark.range(10007).withColumn("v", F.when(F.col("id") % 2 == 0, F.randn(1)).otherwise(F.randn(2) + 8))
    means = [r["mean"] for r in resample.bootstrap_means(df, "id", "v", 10).collect()]
    assert 0.01 < np.std(means) < 0.1
    m, s, p, before = resample.mixture(df, "v", [1.0, 6.0], [2.0, 2.0], [0.5, 0.5], 12)
    assert np.allclose(m, [0, 8], atol=0.1) and np.allclose(s, 1, atol=0.1) and np.allclose(p, 0.5, atol=0.02)
    assert resample.mixture(df, "v", m, s, p, 1)[3] >= before
