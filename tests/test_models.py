"""New operators against brute force, closed forms and known values."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenstat.functions import distributions as dist
from lumenstat.functions import fold
from lumenstat.operators import baskets, gaussian, graph, inference, nearby, resample, separate, signals, spaces, splines, validate
from lumenstat.operators.linear import LeastSquares, gram, matrix


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    y = 1 + 2 * x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=300)
    z = (rng.random(300) < 1 / (1 + np.exp(-(0.5 + x[:, 0])))).astype(int)
    rows = [(i, *map(float, r), float(v), int(c), i % 5) for i, (r, v, c) in enumerate(zip(x, y, z))] + [(300, None, 1.0, 1.0, 1.0, 1, 0)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, z int, fold int").cache()


def frame(points):
    return points.dropna().toPandas()


def test_distribution_functions():
    assert dist.t_quantile(0.975, 10) == pytest.approx(2.2281388520, abs=1e-8) and dist.t_quantile(0.975, 1) == pytest.approx(12.7062047362, abs=1e-6)
    assert dist.chi2_cdf(3.841458820694124, 1) == pytest.approx(0.95, abs=1e-10) and dist.chi2_cdf(18.307038053, 10) == pytest.approx(0.95, abs=1e-9)
    assert dist.f_cdf(4.964602744, 1, 10) == pytest.approx(0.95, abs=1e-9) and dist.normal_cdf(1.959963984540054) == pytest.approx(0.975)
    assert dist.t_cdf(-2.0, 7) + dist.t_cdf(2.0, 7) == pytest.approx(1) and dist.beta_cdf(0.3, 2, 3) == pytest.approx(0.3483)
    assert dist.gamma_cdf(2.0, 3) == pytest.approx(1 - math.exp(-2) * 5) and dist.f_cdf(-1, 2, 3) == 0


def test_fold_takes_any_key(spark):
    df = spark.createDataFrame([(9_000_000_000_000_000_000,), (-5,), (17,)], "k long").select("k", fold(F.col("k"), 7).alias("f"))
    assert {r.k: r.f for r in df.collect()} == {k: (k * 7919 + 104729) % 7 for k in (9_000_000_000_000_000_000, -5, 17)}


def test_intervals_and_tests(points):
    fit, p = LeastSquares(points, ["a", "b"], "y"), frame(points)
    f, pv = inference.overall_test(fit)
    tests = inference.coefficient_tests(fit)
    assert pv < 1e-12 and f > 100 and all(low < b < high for _, b, _, _, _, low, high in tests) and tests[1][4] < 1e-12
    out = inference.with_intervals(points.dropna(), fit).toPandas()
    inside = ((out.y > out.pred_low) & (out.y < out.pred_high)).mean()
    assert 0.9 < inside <= 1 and (out.mean_high - out.mean_low < out.pred_high - out.pred_low).all() and len(out) == len(p)


def test_logistic_against_newton(points):
    p = frame(points)
    x, beta = np.column_stack([np.ones(len(p)), p.a, p.b]), np.zeros(3)
    for _ in range(30):
        mu = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve((x * (mu * (1 - mu))[:, None]).T @ x, x.T @ (p.z - mu))
    fit = inference.Logistic(points, ["a", "b"], "z")
    assert np.allclose(fit.beta, beta, atol=1e-8)
    lr, pv, r2 = fit.likelihood_ratio()
    assert lr == pytest.approx(fit.null_deviance() - fit.deviance) and 0 < r2 < 1 and pv < 1e-3
    assert fit.wald()[1][5] == pytest.approx(math.exp(beta[1])) and inference.Logistic(points.filter("false"), ["a"], "z").beta.tolist() == [0, 0]


def test_path_cv_against_brute_force(points):
    p, x = frame(points), ["a", "b", "c"]

    def brute(solve):
        out = []
        for f in range(5):
            tr, te = p[p.fold != f], p[p.fold == f]
            m, s = tr[x].mean(), tr[x].std(ddof=0)
            z, t = (tr[x] - m) / s, (te[x] - m) / s
            b = solve(z.to_numpy(), (tr.y - tr.y.mean()).to_numpy())
            out.append(((te.y - tr.y.mean() - t.to_numpy() @ b) ** 2).mean())
        return float(np.mean(out))

    rows = validate.path_cv(points, x, "y", "fold", [0.0, 5.0, 500.0], validate.ridge)
    for lam, mse, _ in rows:
        assert mse == pytest.approx(brute(lambda z, y, lam=lam: np.linalg.solve(z.T @ z + lam * np.eye(3), z.T @ y)))
    assert validate.best_setting(rows) == 0.0 and validate.one_se_setting(rows, simplest_first=False) in (0.0, 5.0, 500.0)
    lasso = validate.path_cv(points, x, "y", "fold", [10.0, 0.0], validate.lasso)
    assert lasso[1][1] == pytest.approx(rows[0][1], abs=1e-6) and lasso[0][1] > 3 * lasso[1][1]
    assert validate.path_cv(points, x, "y", "fold", [3.0], validate.components)[0][1] == pytest.approx(rows[0][1])
    assert validate.path_cv(points, x, "y", "fold", [0.1], validate.elastic(0.5))[0][1] > rows[0][1]
    assert validate.path_cv(points, x, "y", "fold", [1.0], validate.quadratic(splines.difference_penalty(3, 1)))[0][2] > 0
    general = validate.k_fold(points.dropna(), "fold", lambda t: LeastSquares(t, x, "y"), lambda m: m.predict(), lambda e: F.pow(F.col("y") - e, F.lit(2)))
    assert np.mean([r[2] for r in general]) == pytest.approx(rows[0][1])


def test_splines(spark, points):
    df = spark.createDataFrame([(float(v),) for v in np.linspace(0, 1, 101)], "x double")
    basis = splines.bspline(F.col("x"), [0.3, 0.6], 0, 1, 3)
    m = np.array([list(r) for r in df.select(*basis).collect()])
    assert m.shape == (101, 6) and np.allclose(m.sum(1), 1) and (m >= 0).all() and m[-1, -1] == 1
    d = df.withColumn("y", F.sin(6 * F.col("x")))
    loose, stiff = (splines.PenalizedFit(d, basis, "y", lam, splines.difference_penalty(6)) for lam in (1e-6, 1e6))
    assert loose.df > 5.9 and stiff.df < 2.1 and loose.rss < 0.05 < stiff.rss and loose.gcv < stiff.gcv
    h = np.array([r[0] for r in d.select(loose.leverage()).collect()])
    assert h.sum() == pytest.approx(loose.df, abs=1e-3) and loose.loocv(d, "y") < 0.01
    t = splines.tensor_product(basis[:2], basis[2:4])
    assert len(t) == 4 and splines.tensor_penalty(2, 3, 1).shape == (6, 6)
    groups = [splines.bspline(F.col(c), [0.0], -5, 5, 1) for c in ("a", "b")]
    mean, beta = splines.backfitted(points.dropna(), groups, "y", 1e-6)
    left = points.dropna().select(F.avg(F.pow(F.col("y") - splines.additive_predict(mean, groups, beta), F.lit(2)))).first()[0]
    assert left < 0.12
    fit, wide = splines.logistic_spline(points.dropna(), groups[0], "z")
    assert fit.beta[-1] > fit.beta[1] - 20 and wide.count() == 300


def test_neighbour_predictions_and_cv(points):
    p = frame(points)
    v = points.dropna().withColumn("v", F.array("a", "b"))
    near = nearby.nearest_rows(v.filter("id < 20"), v, 7, "id", "v", "manhattan")
    got = {r.query_id: r.predicted for r in nearby.knn_regress(near, "y").collect()}
    for q in range(20):
        d = (p.a - p.a[q]).abs() + (p.b - p.b[q]).abs()
        d[q] = 1e9
        assert got[q] == pytest.approx(p.y[d.nsmallest(7).index].mean())
    votes = nearby.knn_classify(near, "z", weighted=True)
    assert votes.count() == 20 and votes.filter("share <= 0.4").count() == 0
    cv, x = dict(nearby.knn_cv(v, v, [1, 15], "id", "v", "y", "fold", classify=False)), p[["a", "b"]].to_numpy()
    for k in (1, 15):
        e = []
        for q in range(len(p)):
            d = ((x - x[q]) ** 2).sum(1) + 1e9 * (p.fold == p.fold[q])
            e.append((p.y[q] - p.y[d.nsmallest(k).index].mean()) ** 2)
        assert cv[k] == pytest.approx(np.mean(e))
    assert dict(nearby.knn_cv(v, v, [5], "id", "v", "z", "fold"))[5] < 0.5


def test_medoids_against_all_choices(spark):
    rng = np.random.default_rng(1)
    pts = [([float(a), float(b)], int(n)) for a, b, n in zip(rng.integers(0, 20, 14), rng.integers(0, 20, 14), rng.integers(1, 5, 14))]
    df = spark.createDataFrame(pts, "v array<double>, n long").groupBy("v").agg(F.sum("n").alias("n"))
    rows = sorted((r.v, r.n) for r in df.collect())
    x, w = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    d = np.abs(x[:, None] - x[None]).sum(2)
    best = min(w @ d[:, list(c)].min(1) for c in itertools.combinations(range(len(x)), 2))
    _, value = nearby.k_medoids_multistart(df, "v", "n", 2, metric="manhattan")
    assert value == pytest.approx(best)
    assert nearby.k_medoids(df, "v", "n", 2, "manhattan")[1] <= nearby.k_medoids(df, "v", "n", 2, "manhattan", swaps=False)[1]


def test_gaussian_mixture(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.multivariate_normal([0, 0], [[1, 0.5], [0.5, 1]], 300), rng.multivariate_normal([6, 3], [[0.5, 0], [0, 2]], 200)])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None, 1.0)], "a double, b double")
    m, ll = gaussian.multistart(df, ["a", "b"], 2, starts=2, steps=25)
    order = np.argsort(m.means[:, 0])
    assert np.allclose(m.means[order], [[0, 0], [6, 3]], atol=0.3) and np.allclose(m.weights[order], [0.6, 0.4], atol=0.02)
    row = m.criteria(df).first()
    assert row.n == 500 and row.parameters == 11 and row.bic > row.aic and row.log_likelihood >= ll - 1e-6
    out = m.with_clusters(df.dropna()).toPandas()
    assert (out.cluster.to_numpy()[:300] == order[0]).mean() > 0.98 and (out.normalised_entropy <= 1).all()
    assert m.ellipse(0).shape == (64, 2)


def test_spaces(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 3))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "key long, v array<double>")
    p = spaces.pairs(df, "key", "v", 0.5).cache()
    _, k = spaces.dense(p, "rbf")
    _, d2 = spaces.dense(p, "sq_dist")
    assert np.allclose(d2, ((x[:, None] - x[None]) ** 2).sum(2)) and np.allclose(k, np.exp(-0.5 * d2)) and np.linalg.eigvalsh(k)[0] > 0
    y = x @ [1, 2, 3] + 1
    assert np.allclose(k @ spaces.kernel_ridge(k, y, 1e-10) + y.mean(), y, atol=1e-4)
    z, path = spaces.metric_scaling(np.sqrt(d2), 3)
    assert path[-1] < 1e-6 and path[-1] <= path[0]
    flat, path = spaces.metric_scaling(np.sqrt(d2), 2)
    local, lpath = spaces.metric_scaling(np.sqrt(d2), 2, local=4)
    assert path[-1] <= path[0] and lpath[-1] <= lpath[0] and flat.shape == local.shape == (12, 2)
    two = np.kron(np.eye(2), np.ones((4, 4)))
    assert spaces.eigengap(np.diag(two.sum(1)) - two) == 2


def test_signals(spark, points):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([3, 1, 4, 1, 5, 9, 2])], "p long, x double")
    level = signals.haar_pairs(df, "p", "x")
    assert [r.value for r in signals.haar_inverse(level).orderBy("place").collect()] == pytest.approx([3, 1, 4, 1, 5, 9, 2])
    flat = signals.haar_inverse(signals.shrunk(level, 1e9)).orderBy("place").collect()
    assert flat[0].value == pytest.approx(2) and flat[1].value == pytest.approx(2) and signals.noise_level(level.filter("false")) == 0
    q = points.dropna().withColumn("b", F.pow("b", F.lit(3)))
    best, top = signals.random_projection_search(q, ["a", "b", "c"])
    assert abs(best[1]) > 0.9 * np.linalg.norm(best) and top > 3
    other, _ = signals.random_projection_search(q, ["a", "b", "c"], against=[best])
    assert abs(np.dot(best, other)) < 1e-9
    draws = signals.gibbs_normal(points, "y", 400, 50)
    p = frame(points)
    assert draws[:, 0].mean() == pytest.approx(p.y.mean(), abs=0.1) and draws[:, 1].mean() == pytest.approx(p.y.var(), rel=0.15)
    empty = signals.normal_posterior(points.filter("false"), "y", 2.0, 3.0, 1.0).first()
    assert empty["mean"] == pytest.approx(2) and empty["variance"] == pytest.approx(3)
    wide = spark.createDataFrame([(800.0,), (-800.0,)], "x double")
    for r in wide.select(signals.softplus(F.col("x")), signals.sigmoid(F.col("x")), signals.log_cosh(F.col("x"))).collect():
        assert all(math.isfinite(v) for v in r)


def test_bootstrap_draws(spark, points):
    df = spark.range(20_000)
    r = df.select(F.avg(resample.poisson_copies("id", 3)).alias("m"), F.var_pop(resample.poisson_copies("id", 3)).alias("v"), F.corr(resample.poisson_copies("id", 3), resample.poisson_copies(F.col("id") + 10007, 3)).alias("c")).first()
    assert r.m == pytest.approx(1, abs=0.03) and r.v == pytest.approx(1, abs=0.05) and abs(r.c) < 0.03
    draws = resample.bootstrap_moments(points, "id", "a", "y", 20)
    s = resample.bootstrap_summary(draws, "slope").first()
    fit = LeastSquares(points, ["a"], "y")
    assert s["mean"] == pytest.approx(fit.beta[1], abs=3 * fit.se[1]) and 0.4 * fit.se[1] < s["se"] < 2 * fit.se[1]
    wild = resample.residual_bootstrap(points, "id", "a", "y", 20).toPandas().slope
    assert 0.4 * fit.se[1] < wild.std() < 2 * fit.se[1]


def test_discriminants_and_descent(points):
    names, means, n, within, between = separate.class_scatter(points, ["a", "b"], "z")
    values, a = separate.fisher_directions(within, between)
    assert names == [0, 1] and n.sum() == 300 and values[0] > values[1] - 1e-12 and np.allclose(a.T @ within @ a, np.eye(2))
    out = separate.discriminant_coordinates(points.dropna(), ["a", "b"], a, 1)
    called = out.withColumn("p", separate.nearest_mean([F.col("f1")], names, means @ a[:, :1]))
    acc = {r.z: r.accuracy for r in separate.class_accuracy(called, "z", "p").collect()}
    assert min(acc.values()) > 0.5
    m = matrix(gram(points.dropna(), ["a", "b"], "y").first(), 4)
    beta, path = separate.least_squares_descent(m, steps=200)
    assert np.allclose(beta, LeastSquares(points, ["a", "b"], "y").beta, atol=1e-6) and all(x >= y - 1e-12 for x, y in zip(path, path[1:]))
    assert separate.condition(m)[0] >= 1 and np.allclose(separate.numerical_gradient(lambda v: float(v @ v), np.array([1.0, -2.0])), [2, -4], atol=1e-6)
    spc = separate.SupervisedComponents(points.dropna(), ["a", "b", "c"], "y", count=2, top=2)
    e = points.dropna().select(F.avg(F.pow(F.col("y") - spc.predict(), F.lit(2)))).first()[0]
    assert spc.x == ["a", "b"] and e == pytest.approx(LeastSquares(points, ["a", "b"], "y").rss / 300, rel=1e-6)


def test_rules_and_ranks(spark):
    items = spark.createDataFrame([(t, i) for t, s in enumerate(["abc", "abc", "ab", "ac", "bc", "a"]) for i in s], "txn long, item string")
    table = baskets.set_rules(baskets.supports(items, 3, 0.1)).cache()
    assert table.count() == 6 + 6  # a pair has two rules, a triple six
    r = table.filter("lhs = 'a' AND rhs = 'b,c'").first()
    assert r.confidence == pytest.approx(2 / 5) and r.lift == pytest.approx(0.4 / 0.5)
    assert baskets.filtered(table, lhs="a", lift=1.0).filter("NOT array_contains(split(lhs, ','), 'a') OR lift < 1").count() == 0
    better = {(x.lhs, x.rhs): x.improvement for x in baskets.with_improvement(table).collect()}
    assert better["a,b", "c"] == pytest.approx(2 / 3 - 3 / 4) and better["a", "b"] == pytest.approx(3 / 5 - 4 / 6)
    new = baskets.evaluated(table.select("lhs", "rhs"), items.filter("txn < 2")).collect()
    assert all(x.new_support == 1 and x.new_confidence == 1 for x in new)
    nodes, edges = spark.range(5).select("id"), spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 0), (0, 2)], "src long, dst long")
    direct, steps = dict(graph.pagerank_direct(nodes, edges)), {r["id"]: r["rank"] for r in graph.pagerank(nodes, edges, 200, tol=1e-10).collect()}
    assert all(direct[k] == pytest.approx(steps[k], abs=1e-8) for k in direct)
    surf = {r.id: r.share for r in graph.random_surfer(nodes, edges, 15, 2000).collect()}
    assert all(abs(surf.get(k, 0) - direct[k]) < 0.05 for k in direct)
    assert graph.google_matrix(nodes, edges).groupBy("src").agg(F.sum("probability").alias("s")).filter("abs(s - 1) > 1e-12").count() == 0
