"""Paths, nested fits and searches against refits and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenstat.operators import adaptive, additive, boxes, chains, experts, flexible, posterior, project, pursuit, quantiles, resample, separate, signals, spaces, splines, supportpath, trees, tuning
from lumenstat.plans import deep


def svm_objective(x, y, n, cost, kernel=supportpath.linear_kernel):
    q = np.outer(y, y) * kernel(x, x)
    a, b = supportpath.dual(q, y, cost * n)
    f = kernel(x, x) @ (a * y) + b
    return 0.5 * a @ q @ a + cost * (np.maximum(1 - y * f, 0) @ n), (a * y) @ x, b


@pytest.mark.parametrize("seed,shape", [(1, "plain"), (2, "weights"), (3, "unequal"), (4, "lattice"), (5, "radial"), (6, "apart")])
def test_support_path_equals_refits(seed, shape):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(40, 2))
    y = np.where(x[:, 0] + 0.7 * rng.normal(size=40) > (0.8 if shape == "unequal" else 0), 1.0, -1.0)
    n = rng.integers(1, 6, 40).astype(float) if shape in ("weights", "lattice") else np.ones(40)
    kernel = supportpath.radial_kernel(0.5) if shape == "radial" else supportpath.linear_kernel
    if shape == "lattice":
        x = np.round(x * 2) / 2
        keep = np.unique(np.column_stack([x, y]), axis=0)
        x, y, n = keep[:, :2], keep[:, 2], n[: len(keep)]
    if shape == "apart":
        x[:, 0] += 3 * y
    path = supportpath.SupportPath(x, y, n, 0.01, 20.0, kernel)
    costs = [k.cost for k in path.knots]
    assert costs == sorted(costs) and costs[0] == 0.01 and costs[-1] == pytest.approx(20.0) and len(costs) > 3
    between = [(a + b) / 2 for a, b in zip(costs, costs[1:])]
    for c in [*np.geomspace(0.01, 20, 9), *between[:: max(1, len(between) // 8)]]:
        want, w, _ = svm_objective(x, y, n, c, kernel)
        assert path.objective(c) == pytest.approx(want, rel=1e-6, abs=1e-8)
        a, _ = path.at(c)
        assert abs(a @ y) < 1e-7 * max(1, a.sum()) and (a >= -1e-9).all() and (a <= c * n * (1 + 1e-7)).all()
        if shape != "radial":
            assert np.allclose(path.coefficients(c)[0], w, atol=1e-5)
    if shape == "plain":  # a row that enters lies on the margin at its knot
        for k in path.knots:
            if k.event == "enters":
                assert y[k.row] * path.scores(k.cost, x[[k.row]])[0] == pytest.approx(1, abs=1e-6)


def test_support_elbow_updates_equal_inverses():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(8, 5)), np.where(rng.random(8) < 0.5, 1.0, -1.0)
    e = supportpath.Elbow(np.outer(y, y) * (x @ x.T), y)
    for move, i in [("add", 0), ("add", 3), ("add", 5), ("add", 1), ("remove", 3), ("add", 7), ("remove", 0)]:
        getattr(e, move)(i)
        if len(e.rows) > 1:
            assert np.allclose(e.inverse @ e._system(), np.eye(len(e.rows) + 1), atol=1e-8)


def test_support_path_by_folds(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), float(a), float(b), 1.0 if a + b + rng.normal() > 0 else -1.0) for i, (a, b) in enumerate(np.round(rng.normal(size=(150, 2)), 1))] + [(999, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double").withColumn("fold", F.col("id") % 3)
    got = {(r.cost, r.fold): r for r in supportpath.support_path_cv(df, ["a", "b"], "y", "fold", [0.1, 1.0]).collect()}
    assert len(got) == 6
    x, y, f = np.array([r[1:3] for r in rows[:-1]]), np.array([r[3] for r in rows[:-1]]), np.arange(150) % 3
    for (c, k), r in got.items():
        points, at = np.unique(np.column_stack([x, y])[f != k], axis=0, return_inverse=True)
        _, w, b = svm_objective(points[:, :2], points[:, 2], np.bincount(at.ravel()).astype(float), c)
        assert r.n == (f == k).sum() and r.hinge == pytest.approx(np.maximum(1 - y[f == k] * (x[f == k] @ w + b), 0).sum(), rel=1e-3, abs=1e-3)
    with pytest.raises(ValueError):
        supportpath.weighted_points(df, ["a", "b"], "y", most=10)


@pytest.fixture(scope="module")
def waves(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, (1500, 2))
    eta = 2 * np.sin(3 * x[:, 0]) - 2 * x[:, 1] ** 2
    y = (rng.random(1500) < 1 / (1 + np.exp(-eta))).astype(float)
    rows = [(i, float(a), float(b), float(v), float(e)) for i, ((a, b), v, e) in enumerate(zip(x, y, eta))] + [(9999, None, 0.0, 1.0, 0.0)]
    return spark.createDataFrame(rows, "id long, u double, v double, y double, eta double").cache()


def bases():
    return [splines.bspline(F.col("u"), [-0.5, 0.0, 0.5], -1.0, 1.0, 3), splines.bspline(F.col("v"), [0.0], -1.0, 1.0, 3)]


def matrix_of(df, groups):
    rows = df.dropna().orderBy("id").select(*[c.alias(f"c{i}") for i, c in enumerate(c for g in groups for c in g)], "y", "eta").collect()
    a = np.array(rows, float)
    return a[:, :-2], a[:, -2], a[:, -1]


def test_logistic_additive_equals_joint_fit(waves):
    lam, groups = 2.0, bases()
    fit = additive.LogisticAdditive(waves, groups, "y", lam, steps=40, sweeps=20_000)
    assert all(b <= a + 1e-7 for a, b in zip(fit.path, fit.path[1:])) and fit.deviance < 0.9 * fit.null_deviance
    x, y, _ = matrix_of(waves, groups)
    a, p = np.column_stack([np.ones(len(x)), x]), np.zeros((x.shape[1] + 1,) * 2)
    p[1:, 1:] = lam * additive.block_penalty([len(g) for g in groups]) + 1e-8 * np.eye(x.shape[1])
    beta = np.zeros(a.shape[1])
    for _ in range(60):
        mu = 1 / (1 + np.exp(-(a @ beta)))
        beta += np.linalg.lstsq((a * (mu * (1 - mu))[:, None]).T @ a + p, a.T @ (y - mu) - p @ beta, rcond=None)[0]
    got = np.array([r[0] for r in waves.dropna().orderBy("id").select(fit.link()).collect()])
    assert np.abs(got - a @ beta).max() < 2e-3


def test_logistic_additive_of_counted_rows(spark):
    df = spark.range(400).selectExpr("CAST(id % 7 AS DOUBLE) AS a", "CAST(id % 3 AS DOUBLE) AS b", "CAST(id % 5 = 0 AS DOUBLE) AS y")
    groups = [[F.col("a")], [F.col("b")]]
    rows = additive.LogisticAdditive(df, groups, "y", 0.0, steps=4)
    few = additive.LogisticAdditive(df.groupBy("a", "b", "y").agg(F.count("*").alias("n")), groups, "y", 0.0, steps=4, count="n")
    assert few.n == rows.n == 400 and few.path == pytest.approx(rows.path) and few.null_deviance == pytest.approx(rows.null_deviance)
    assert np.allclose(np.concatenate(few.beta), np.concatenate(rows.beta), atol=1e-9)


def test_weighted_additive_equals_joint_fit_and_folds(waves):
    groups = bases()
    w = 1 + F.pmod("id", F.lit(3))
    fit = additive.WeightedAdditive(waves, groups, F.col("eta"), w, 0.5, sweeps=20_000)
    x, _, z = matrix_of(waves, groups)
    a, k = np.column_stack([np.ones(len(x)), x]), 1.0 + np.arange(len(x)) % 3
    p = np.zeros((a.shape[1],) * 2)
    p[1:, 1:] = 0.5 * additive.block_penalty([len(g) for g in groups]) + 1e-8 * np.eye(x.shape[1])
    want = a @ np.linalg.lstsq((a * k[:, None]).T @ a + p, a.T @ (k * z), rcond=None)[0]
    row = waves.dropna().select(*[f.alias(n) for f, n in zip([fit.predict(), *fit.smooths()], "abc")], w.alias("w"), "id")
    got = np.array(row.orderBy("id").collect())
    assert np.abs(got[:, 0] - want).max() < 1e-4
    assert np.allclose(got[:, 1] + got[:, 2] + fit.intercept, got[:, 0], atol=1e-8) and abs(got[:, 1] @ got[:, 3]) < 1e-5
    rows = additive.additive_cv(waves, groups, "eta", F.pmod("id", F.lit(4)), [0.01, 1.0, 1e6])
    assert rows[0][1] < 0.05 < rows[2][1]


def test_tree_of_experts(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, (2000, 2))
    line = np.select([(x[:, 0] > 0) & (x[:, 1] > 0), x[:, 0] > 0, x[:, 1] > 0], [2 + 3 * x[:, 0], -2 - x[:, 1], 1 - 3 * x[:, 1]], -1 + 2 * x[:, 0])
    y = line + 0.2 * rng.normal(size=2000)
    df = spark.createDataFrame([(float(a), float(b), float(v), float(t)) for (a, b), v, t in zip(x, y, line)] + [(None, 0.0, 1.0, 1.0)], "a double, b double, y double, t double").cache()
    fit = experts.ExpertTree(df, ["a", "b"], "y", 2, 25)
    assert len(fit.path) > 5 and all(b >= a - 1e-6 * abs(a) for a, b in zip(fit.path, fit.path[1:]))
    within, between = fit.variances()
    shares = fit.shares()
    got = df.dropna().agg(F.avg(F.pow(F.col("t") - fit.predict(), F.lit(2))).alias("e"), F.avg(F.pow(F.col("t") - fit.hard(), F.lit(2))).alias("h"), F.avg(within + between).alias("v"), F.avg(F.pow(F.col("y") - fit.predict(), F.lit(2))).alias("r"),
                          F.max(F.abs(sum(shares[1:], shares[0]) - 1)).alias("one"), F.countDistinct(fit.dominant()).alias("k"), F.sum(F.log(fit.density(F.col("y")))).alias("ll"), F.avg(fit.below(F.col("y"))).alias("u")).first()
    assert got.e < 0.08 and got.h < 0.2 and got.one < 1e-9 and got.k == 4 and got.ll == pytest.approx(fit.path[-1], rel=0.02)
    assert abs(got.v - got.r) < 0.1 and abs(got.u - 0.5) < 0.03 and fit.counts() == 25
    assert not experts.ExpertTree(df.filter("false"), ["a", "b"], "y").path


def test_flexible_discriminants(spark):
    rng = np.random.default_rng(3)
    label = rng.integers(0, 3, 900)
    x = rng.normal(size=(900, 2)) @ [[1.0, 0.5], [0.0, 0.8]] + np.array([[0, 0], [2, 0], [1, 2]])[label]
    df = spark.createDataFrame([(float(a), float(b), int(k)) for (a, b), k in zip(x, label)] + [(None, 1.0, 1)], "a double, b double, l int")
    fit = flexible.FlexibleDiscriminant(df, [F.col("a"), F.col("b")], "l")
    _, _, n, within, between = separate.class_scatter(df, ["a", "b"], "l")
    values, directions = separate.fisher_directions(within, between)
    lda = directions * np.sqrt(n.sum())
    assert np.allclose(np.abs(fit.beta[1:]), np.abs(lda[:, :2]), atol=1e-6) and np.allclose(fit.correlation / (1 - fit.correlation), values[:2])
    ok = df.dropna().agg(F.avg((fit.predict() == F.col("l")).cast("double")).alias("p"), F.avg((fit.nearest() == F.col("l")).cast("double")).alias("q")).first()
    assert ok.p > 0.75 and ok.q > 0.75
    post = fit.posterior()
    assert df.dropna().agg(F.max(F.abs(post[0] + post[1] + post[2] - 1))).first()[0] < 1e-9


def test_flexible_discriminants_part_rings(spark):
    rng = np.random.default_rng(5)
    angle, ring = rng.uniform(0, 6.28, 600), np.arange(600) % 2
    r = np.where(ring, 2.0, 0.6) + 0.15 * rng.normal(size=600)
    df = spark.createDataFrame([(int(i), float(a * np.cos(t)), float(a * np.sin(t)), int(k)) for i, (a, t, k) in enumerate(zip(r, angle, ring))], "id long, a double, b double, l int")
    line = flexible.FlexibleDiscriminant(df, [F.col("a"), F.col("b")], "l")
    basis = [b for c in ("a", "b") for b in splines.bspline(F.col(c), [-1.0, 0.0, 1.0], -3.0, 3.0, 3)[1:]]
    curve = flexible.FlexibleDiscriminant(df, basis, "l", 1e-3)
    share = lambda f: df.agg(F.avg((f.predict() == F.col("l")).cast("double"))).first()[0]
    assert share(line) < 0.65 and share(curve) > 0.97
    rows = flexible.flexible_cv(df, basis, "l", F.col("id") % 3, [1e-3, 1e6])
    assert rows[0][1] == 600 and rows[0][2] < 30 < rows[1][2] + 300


def test_network_posterior(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(-2, 2, 300)
    df = spark.createDataFrame([(float(a), float(np.sin(2 * a) + 0.2 * e)) for a, e in zip(x, rng.normal(size=300))] + [(None, 1.0), (0.5, None)], "x double, y double").coalesce(2).cache()
    fit = posterior.NetworkPosterior(df, ["x"], "y", 4, 4, 120, 80, seed=3)
    assert fit.draws.shape == (40, 4, 14) and (fit.accepted > 0.02).all() and (fit.accepted < 0.8).all() and np.isfinite(fit.rhat()).all()
    got = fit.report(df).first()
    assert got.n == 300 and 0.7 < got.coverage <= 1 and got.r_squared > 0.1 and got.of_mean > 0 and got.of_noise > 0
    out = fit.predicted(df.select("x")).filter("x IS NULL").first()
    assert out["mean"] is None and out["low"] is None
    w = fit.draws[-1]
    data = df.dropna()
    z = (np.array(data.select("x", "y").collect()) - fit.shift) / fit.scale
    assert np.allclose(fit._errors(data, w), ((z[:, 1] - fit.forward(w, z[:, :1])) ** 2).sum(1))
    a, b = fit.unpacked(w)
    assert np.allclose(fit.forward(w, z[:3, :1])[1, 2], b[1, 0] + b[1, 1:] @ np.tanh(a[1, :, 0] + a[1, :, 1] * z[2, 0]))


def test_projection_search_finds_planted_directions(spark):
    rng = np.random.default_rng(7)
    n = 3000
    s = np.column_stack([np.where(rng.random(n) < 0.5, -1, 1) + 0.2 * rng.normal(size=n), rng.laplace(size=n), *rng.normal(size=(2, n))])
    mix = rng.normal(size=(4, 4))
    x = s @ mix.T
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(n, None, 1.0, 1.0, 1.0)], "id long, a double, b double, c double, d double").cache()
    cols, back = ["a", "b", "c", "d"], np.linalg.inv(mix)
    fit = pursuit.ProjectionSearch(df, cols, "kurtosis", 2, starts=4, steps=25)
    found = np.abs(np.corrcoef((x @ np.array(fit.directions).T).T, s[:, :2].T)[:2, 2:])
    assert set(found.argmax(0)) == {0, 1} and found.max(0).min() > 0.95
    assert pursuit.similarity(fit.directions[found[:, 0].argmax()], back[0]) > 0.95
    assert abs(fit.white[0] @ fit.white[1]) < 1e-9 and all(b >= a - 1e-9 for p in fit.paths for a, b in zip(p, p[1:]))
    got = df.dropna().agg(F.corr(*fit.scores()), F.var_pop(fit.scores()[0])).first()
    assert abs(got[0]) < 1e-6 and got[1] == pytest.approx(1)
    white, z = fit.whitened(df), [f"_z{i}" for i in range(4)]
    w = pursuit.orthogonal(rng.normal(size=4), [])
    for name in pursuit.INDICES:
        ((_, g),) = pursuit.index_and_gradient(white, z, [w], name)
        e = 1e-5
        up, down = pursuit.indices(white, z, [w + e * np.eye(4)[1], w - e * np.eye(4)[1]], name)
        assert g[1] == pytest.approx((up - down) / (2 * e), rel=1e-3, abs=1e-5)
    null = pursuit.null_indices(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rng.normal(size=(800, 2)))], "id long, a double, b double"), ["a", "b"], "id", "kurtosis", 1, starts=2, steps=5)
    assert max(null) < max(fit.values)


def test_pasting_and_covering(spark):
    rng = np.random.default_rng(9)
    x = rng.uniform(0, 10, (2000, 2))
    one, two = ((x > [1, 1]) & (x < [4, 4])).all(1), ((x > [6, 6]) & (x < [9, 8])).all(1)
    y = 3.0 * one + 2.0 * two + 0.3 * rng.normal(size=2000)
    df = spark.createDataFrame([(i, float(a), float(b), float(v), bool(p)) for i, ((a, b), v, p) in enumerate(zip(x, y, one))] + [(-1, None, 1.0, 9.0, False)], "id long, a double, b double, y double, one boolean").cache()
    found = boxes.cover(df.filter("id % 3 <> 0"), df.filter("id % 3 = 0"), ["a", "b"], "y", 2, 0.15, 0.03)
    assert len(found) == 2 and found[0][2] > 2.5 and 1.5 < found[1][2] < 2.6
    centres = [[sum(b[c]) / 2 for c in "ab"] for b, _, _ in found]
    assert np.abs(np.array(centres) - [[2.5, 2.5], [7.5, 7.0]]).max() < 0.8
    got = boxes.overlap(df, found[0][0], F.col("one")).first()
    assert got.precision > 0.85 and got.recall > 0.6 and got.jaccard > 0.55
    assert boxes.box_rules({"a": (1.0, 4.0), "b": (0.0, 3.0)}, {"a": (0.0, 4.0), "b": (0.0, 9.0)}) == ["a >= 1", "b <= 3"]
    small = {"a": (2.0, 3.0), "b": (2.0, 3.0)}
    inner = ((x >= 2) & (x <= 3)).all(1)
    need = int(np.ceil(0.1 * inner.sum()))
    for c, side, cut, n, mean in boxes.paste_sides(df, ["a", "b"], "y", small, 0.1):
        j = "ab".index(c)
        rest = inner_other = (x[:, 1 - j] >= 2) & (x[:, 1 - j] <= 3)
        out = np.flatnonzero(rest & (x[:, j] < 2 if side == "low" else x[:, j] > 3))
        near = out[np.argsort(np.abs(x[out, j] - 2.5))][:need]
        assert n == inner.sum() + need and mean == pytest.approx(y[np.concatenate([np.flatnonzero(inner), near])].mean()) and inner_other.any()
        assert cut == pytest.approx(x[near[-1], j])
    best = boxes.best_threshold(df.dropna(), ["a", "b"], "y", 0.2)
    values = []
    for j in range(2):
        order = np.argsort(x[:, j])
        for o, side in ((order, "high"), (order[::-1], "low")):
            k = np.arange(1, 2001)
            m = np.where(k >= 0.2 * 2000, np.cumsum(y[o]) / k, -np.inf)
            values.append((m.max(), "ab"[j], side))
    assert best[4] == pytest.approx(max(values)[0]) and best[:2] == max(values)[1:]


def test_exact_quantiles_by_ranges(spark):
    rng = np.random.default_rng(10)
    rows = [(k, float(v)) for k, size in (("a", 3000), ("b", 7), (None, 400), ("one", 1)) for v in np.round(rng.exponential(size=size) ** 3, 2)] + [("a", None)] * 5 + [("a", 0.01)] * 1000 + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for step in (1_000_000, 50):
        got = {r.g: r for r in quantiles.exact_quantiles(df, "v", {"low": 0.025, "mid": 0.5, "high": 0.975, "top": 1.0}, ["g"], step).collect()}
        assert set(got) == {"a", "b", None, "one"}
        for k, r in got.items():
            v = [x for g, x in rows if g == k and x is not None]
            assert [r.low, r.mid, r.high, r.top] == pytest.approx(np.quantile(v, [0.025, 0.5, 0.975, 1.0]))
        whole = quantiles.exact_quantiles(df, "v", {"mid": 0.5}, None, step).first()
        assert whole.mid == pytest.approx(np.median([x for _, x in rows if x is not None]))
    assert quantiles.exact_quantiles(df.filter("false"), "v", {"mid": 0.5}, ["g"]).count() == 0


def test_bootstrap_of_any_statistic(spark):
    rng = np.random.default_rng(11)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(np.round(rng.normal(size=500), 2))] + [(None, 5.0), (900, None)], "id long, v double")
    weights = np.array([list(r) for r in df.filter("id < 500").orderBy("id").select(*[resample.poisson_copies("id", b).alias(f"w{b}") for b in range(5)]).collect()])
    v = np.array([r.v for r in df.filter("id < 500").orderBy("id").collect()])
    for step in (1_000_000, 20):
        got = {r.replicate: r for r in quantiles.bootstrap_quantiles(df, "id", "v", 0.5, 5, range_rows=step).collect()}
        for b in range(5):
            drawn = np.repeat(v, weights[:, b])
            assert got[b].n == len(drawn) and got[b].quantile == pytest.approx(np.median(drawn))
    draws = quantiles.bootstrap(df.dropna(), "id", {"mean": lambda w: F.sum(w * F.col("v")) / F.sum(w)}, 5)
    assert [r["mean"] for r in draws.orderBy("replicate").collect()] == pytest.approx([np.repeat(v, weights[:, b]).mean() for b in range(5)])
    report = quantiles.bootstrap_report(draws, df.dropna().agg(F.avg("v").alias("mean")), "mean").first()
    assert report.corrected == pytest.approx(2 * report.observed - report.mean) and report.basic_low <= report.basic_high and report.normal_low < report.observed < report.normal_high


def test_kernel_components_of_new_rows(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(60, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    fit = project.KernelComponents(df, ["a", "b"], x.tolist(), 0.5, 2)
    again = np.array([[r.k1, r.k2] for r in fit.scores(df).orderBy("id").collect()])
    k = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(2))
    j = np.eye(60) - 1 / 60
    value, vector = np.linalg.eigh(j @ k @ j)
    want = vector[:, ::-1][:, :2] * np.sqrt(value[::-1][:2])
    assert np.allclose(np.abs(again), np.abs(want), atol=1e-6)
    new = spark.createDataFrame([(0, *map(float, x[0])), (1, 0.3, -0.2)], "id long, a double, b double")
    got = np.array([[r.k1, r.k2] for r in fit.scores(new).orderBy("id").collect()])
    cross = np.exp(-0.5 * (([0.3, -0.2] - x) ** 2).sum(1))
    centred = cross - cross.mean() - k.mean(0) + k.mean()
    assert np.allclose(got[0], again[0]) and np.allclose(np.abs(got[1]), np.abs(centred @ (vector[:, ::-1][:, :2] / np.sqrt(value[::-1][:2]))), atol=1e-6)
    points = df.select(F.col("id").alias("key"), F.array("a", "b").alias("v"))
    table = spaces.pairs(points, "key", "v", 0.5).select("i", "j", "rbf")
    same = spaces.centred_new(spaces.cross_pairs(points, points, "key", "v", 0.5).select("i", "j", "rbf"), table, "rbf").withColumnRenamed("rbf", "n")
    assert same.join(spaces.centred(table, "rbf"), ["i", "j"]).agg(F.max(F.abs(F.col("n") - F.col("rbf")))).first()[0] < 1e-12


def test_components_turned_back(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 3)) + 5
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    full = project.Centred(df, ["a", "b", "c"], 3)
    assert df.agg(F.max(full.loss())).first()[0] < 1e-18
    two = project.Centred(df, ["a", "b", "c"], 2)
    assert df.agg(F.avg(two.loss())).first()[0] == pytest.approx(two.total - two.variance.sum())


@pytest.fixture(scope="module")
def steps(spark):
    rng = np.random.default_rng(14)
    x = rng.integers(0, 20, (300, 2))
    y = np.where(x[:, 0] > 9, 3.0, 0.0) + np.where((x[:, 0] > 9) & (x[:, 1] > 4), 2.0, 0.0) + 0.3 * rng.normal(size=300)
    rows = [(i, i % 3, float(a), float(b), float(v), 1 if v > 2 else -1) for i, ((a, b), v) in enumerate(zip(x, y))] + [(300, 0, None, 1.0, 9.0, 1)]
    return spark.createDataFrame(rows, "id long, fold int, a double, b double, y double, s int").cache()


def test_trees_and_boosting_by_folds(steps):
    cuts = {c: trees.midpoints(steps, c, 25) for c in ("a", "b")}
    depth = tuning.tree_depth_cv(steps, cuts, "y", "fold", 3)
    data, want = steps.dropna(), []
    for f in range(3):
        tree = trees.grow(data.filter(F.col("fold") != f), cuts, "y", 1)
        want.append(data.filter(F.col("fold") == f).agg(F.avg(F.pow(F.col("y") - tree.predict(), F.lit(2)))).first()[0])
    assert depth[1][1] == pytest.approx(np.mean(want)) and depth[2][1] < 0.2 < depth[1][1] < depth[0][1]
    rounds = tuning.boosting_cv(steps, {"a": cuts["a"]}, "y", "fold", 5, 0.5, every=2)
    assert len(rounds) == 6 and all(b[1] < a[1] for a, b in zip(rounds[:4], rounds[1:4])) and rounds[0][1] == pytest.approx(depth[0][1])
    signs = tuning.adaboost_cv(steps, cuts, "s", "fold", 2)
    assert [r[0] for r in signs] == [1.0, 2.0] and signs[0][1] < 0.1


def test_margins_by_folds(spark, steps):
    df = steps.withColumns({"u": F.col("a") / 10 - 1, "v": F.col("b") / 10 - 1})
    rows = tuning.margin_cv(df, ["u", "v"], "s", "fold", [0.01, 10.0], rate=0.1, steps=60)
    assert rows[1][1] < 0.12 and rows[1][1] <= rows[0][1]
    line = df.withColumn("t", 2 * F.col("u") - F.col("v") + 1)
    rows = tuning.margin_cv(line, ["u", "v"], "t", "fold", [0.01, 100.0], 0.05, rate=0.02, steps=80)
    assert rows[1][1] < 0.3 * rows[0][1]
    got, x, y, f = tuning.margin_cv(df, ["u", "v"], "s", "fold", [1.0], rate=0.1, steps=5), *(np.array(df.dropna().select(c).collect(), float) for c in (["u", "v"], ["s"], ["fold"]))
    errors = []
    for k in range(3):
        a, b, w = x[f[:, 0] != k], y[f[:, 0] != k, 0], np.zeros(3)
        for t in range(5):
            hit = b * (a @ w[:2] + w[2]) < 1
            step = 0.1 / (1 + 1e-4 * t)
            w = w + step * np.array([*((b * hit) @ a / len(a) - w[:2]), (b * hit).sum() / len(a)])
        errors.append((np.where(x[f[:, 0] == k] @ w[:2] + w[2] >= 0, 1, -1) != y[f[:, 0] == k, 0]).mean())
    assert got[0][1] == pytest.approx(np.mean(errors))


def test_shrunken_centroids_by_folds(spark):
    rng = np.random.default_rng(15)
    label = rng.integers(0, 3, 150)
    x = rng.normal(size=(150, 6))
    x[:, 0] += 3 * label
    df = spark.createDataFrame([(int(i % 5), int(k), [float(v) for v in r]) for i, (k, r) in enumerate(zip(label, x))] + [(0, 1, None), (1, None, [0.0] * 6), (1, 1, [0.0])], "fold int, l int, v array<double>")
    rows = tuning.shrunken_cv(df, "l", "v", "fold", [0.0, 2.0, 100.0])
    assert rows[0][1] == 150 and rows[0][2] < 30 and rows[1][3] < rows[0][3] == 6 and rows[2][3] == 0
    assert tuning.shrunken_cv(df, "l", "v", "fold", [0.0], offset=False)[0][2] < 30
    assert tuning.shrunken_cv(df.filter("false"), "l", "v", "fold", [1.0]) == [(1.0, 0, 0, 0.0)]


def test_bases_by_folds(waves):
    df = waves.withColumn("fold", F.pmod("id", F.lit(3)))
    made = {float(k): splines.bspline(F.col("u"), np.linspace(-1, 1, k + 2)[1:-1].tolist(), -1.0, 1.0, 1) for k in (0, 5)}
    rows = tuning.basis_cv(df, made, "eta", "fold", 1e-6)
    assert rows[1][1] < rows[0][1]
    rows = tuning.logistic_basis_cv(df, made, "y", "fold")
    assert [r[0] for r in rows] == [0.0, 5.0] and 1.0 < rows[1][1] < rows[0][1] < 1.4


def test_importance_of_adaptive_splines(steps):
    model, _ = adaptive.adaptive_splines(steps, ["a", "b"], "y", 7, 2, 9)
    found = adaptive.spline_importance(steps, model, ["a", "b"], "y")
    assert found["a"][1] > found["b"][1] >= 0 and found["a"][0] >= 1
    assert adaptive.described((("a", 2.5, 1), ("b", 1.0, -1))) == "max(0, a - 2.5) * max(0, 1 - b)" and adaptive.described(()) == "1"
    rows = adaptive.spline_degree_cv(steps, ["a", "b"], "y", "fold", (1, 2), most=5, knots=5)
    assert [r[0] for r in rows] == [1, 2] and all(r[1] < 2 for r in rows)


def test_lags_and_levels_across_blocks(spark, monkeypatch):
    rng = np.random.default_rng(16)
    v = np.convolve(rng.normal(size=330), np.ones(12), "valid")
    gaps = [t for t in range(len(v)) if t not in (40, 41, 200)]
    df = spark.createDataFrame([(c, int(t), float(v[t] + c)) for c in (0, 1) for t in gaps] + [(0, 500, None)], "chain long, step long, value double")
    monkeypatch.setattr(chains, "BLOCK", 50)
    got = {(r.chain, r.lag): r.rho for r in chains.autocorrelations(df, 30).collect()}
    dense = np.zeros(len(v))
    dense[gaps] = v[gaps] - v[gaps].mean()
    for c in (0, 1):
        for k in range(31):
            assert got[c, k] == pytest.approx(dense[k:] @ dense[: len(v) - k] / (dense @ dense), abs=1e-9)
    series = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v[:300])], "i long, value double")
    levels = {r.level: (r.energy, r.n) for r in signals.haar_energies(series, "i", "value", 3).collect()}
    padded = np.concatenate([v[:300], np.zeros(212)])
    assert set(levels) == set(range(1, 10))
    for k in range(1, 10):
        w = (padded.reshape(-1, 2, 2 ** (k - 1)).sum(2) @ [1, -1]) / 2 ** (k / 2)
        assert levels[k][0] == pytest.approx(w @ w) and levels[k][1] == -(-300 // 2**k)


def test_additive_folds_of_equal_rows(spark, monkeypatch):
    """Equal quantities and discounts of a fold are one row of the basis, which was evaluated for every line item."""
    odd = [(None, 1.0, 1.0, 0), (1.0, None, 2.0, 1), (1.0, 1.0, None, 2), (float("nan"), 1.0, 1.0, 0), (1.0, 2.0, float("nan"), 1), (2.0, 2.0, 1.0, None)]
    rows = [(float(i % 7), float(i % 4), float(i * i % 11), i % 3) for i in range(500)]
    df = spark.createDataFrame(rows + odd, "a double, b double, y double, f int")
    groups = [splines.bspline(F.col("a"), [3.0], 0.0, 6.0, 2), [F.col("b")]]
    want = additive.additive_cv(df, groups, "y", F.col("f"), [0.1, 10.0])
    assert np.allclose(additive.additive_cv(df, groups, "y", F.col("f"), [0.1, 10.0], same=["a", "b"]), want, rtol=1e-9)
    met, wide = [], additive._wide
    monkeypatch.setattr(additive, "_wide", lambda data, *more: (met.append(data.count()), wide(data, *more))[1])
    assert deep.gam_cv(spark, "/root/testdata/sf0.001").count() == 4
    assert len(met) == 1 and met[0] <= 50 * 11 * 5


def test_flexible_classes_of_equal_rows(spark, monkeypatch):
    """The same step of ``flexible_classes``."""
    met, plain = [], flexible.FlexibleDiscriminant
    monkeypatch.setattr(flexible, "FlexibleDiscriminant", lambda data, *more, **named: (met.append((data, more)), plain(data, *more, **named))[1])
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    got = {(r[0], r[1]): r[2] for r in deep.flexible_classes(spark, "/root/testdata/sf0.001").collect()}
    data, (basis, label, *more) = met[0]
    assert data.count() <= 50 * 11 * 3 and sum(got.values()) == lines.count()
    every = lines.select((F.col("l_quantity").cast("double") / 25 - 1).alias("u"), (F.col("l_discount").cast("double") * 20 - 1).alias("v"), label)
    want = every.groupBy(label, plain(every, basis, label, *more).predict().alias("p")).count().collect()
    assert got == {(r[0], r[1]): r[2] for r in want}
