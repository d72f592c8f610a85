import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenstat.operators import adaptive
from lumenstat.operators.trees import quantile_cuts


def frame(spark, x, names):
    return spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names))


def test_splines_find_the_bend_and_drop_noise(spark):
    rng = np.random.default_rng(11)
    x = rng.uniform(0, 10, (400, 2))
    y = np.maximum(x[:, 0] - 5, 0) * 2 + 0.1 * rng.normal(size=400)
    df = frame(spark, np.column_stack([x, y]), ["a", "b", "y"]).cache()
    model, fit = adaptive.adaptive_splines(df, ["a", "b"], "y", most=5, knots=9)
    assert df.agg(F.avg(F.pow(F.col("y") - fit, F.lit(2)))).first()[0] < 0.05
    # the first pair is the best of all candidates, by refitting each
    def rss(c, t):
        z = x[:, "ab".index(c)] - t
        a = np.column_stack([np.ones(400), np.maximum(z, 0), np.maximum(-z, 0)])
        return ((y - a @ np.linalg.lstsq(a, y, rcond=None)[0]) ** 2).sum()

    best = min((rss(c, t), c, t) for c in "ab" for t in quantile_cuts(df, c, 9))
    first, _ = adaptive.adaptive_splines(df, ["a", "b"], "y", most=3, knots=9)
    assert {f[:2] for term, _ in first for f in term} == {best[1:]}
    assert {f[0] for term, _ in model for f in term} == {"a"}
    assert adaptive.adaptive_splines(df.filter("false"), ["a"], "y")[0] == [((), 0.0)]


def test_mixture_discriminants_part_what_no_line_can(spark):
    rng = np.random.default_rng(12)
    c = np.array([[-3.0, 0], [3, 0], [0, 0]])
    v = np.vstack([m + 0.5 * rng.normal(size=(60, 2)) for m in c])
    df = frame(spark, np.column_stack([v, np.repeat([0, 0, 1], 60)]), ["a", "b", "k"]).cache()
    mean, score = adaptive.mixture_discriminants(df, ["a", "b"], "k", {0.0: [[-1, 0], [1, 0]], 1.0: [[0, 0]]}, 10)
    assert sorted(mean[0.0][:, 0]) == pytest.approx([-3, 3], abs=0.3)
    hit = (score[0.0] > score[1.0]) == (F.col("k") == 0)
    assert df.filter(~hit).count() <= 4


def test_repeated_cv_equals_refitting(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(60, 2))
    y = x @ [1.0, 2.0] + rng.normal(size=60)
    df = frame(spark, np.column_stack([np.arange(60), x, y]), ["id", "a", "b", "y"])
    got = adaptive.repeated_cv(df, ["a", "b"], "y", "id", 4, 2)
    for r in range(2):
        f = np.array([t["f"] for t in df.select(F.pmod(F.xxhash64("id", F.lit(r)), F.lit(4)).alias("f")).collect()])
        a, e = np.column_stack([np.ones(60), x]), 0.0
        for k in range(4):
            e += ((y[f == k] - a[f == k] @ np.linalg.lstsq(a[f != k], y[f != k], rcond=None)[0]) ** 2).sum()
        assert got[r] == pytest.approx(e / 60)
