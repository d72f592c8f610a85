"""Intervals, logistic odds, cross-validated paths, spline bases, bootstrap fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenstat.operators import inference, resample, splines, validate
from lumenstat.operators.linear import LeastSquares
from lumenstat.plans.common import rounded, table

LAMBDAS = [0.0, 100.0, 10_000.0, 1_000_000.0]
KNOTS, LOW, HIGH = [15.0, 35.0], 0.0, 51.0
REPLICATES = 6


def _parts(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").cast("double").alias("y"))


def ols_intervals(spark, d):
    df = _parts(spark, d)
    fit = LeastSquares(df, ["x"], "y")
    return rounded(inference.with_intervals(df.select("p_partkey", "x"), fit).drop("x"), 4)


def coefficient_intervals(spark, d):
    fit = LeastSquares(_parts(spark, d), ["x"], "y")
    rows = [(t, e, low, high) for t, e, _, _, _, low, high in inference.coefficient_tests(fit)]
    return rounded(spark.createDataFrame(rows, "term string, estimate double, low double, high double"), 4)


def logistic_odds(spark, d):
    df = table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"), F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0).alias("x"))
    fit = inference.Logistic(df, ["x"], "y")
    _, _, mcfadden = fit.likelihood_ratio()
    rows = [(t, b, s, z, o, low, high, fit.deviance / fit.n, fit.null_deviance() / fit.n, mcfadden) for t, b, s, z, _, o, low, high in fit.wald()]
    return rounded(spark.createDataFrame(rows, "term string, estimate double, std_error double, z double, odds_ratio double, low double, high double, deviance_n double, null_deviance_n double, mcfadden double"))


def _ridge_rows(spark, d):
    df = _parts(spark, d).withColumn("fold", F.pmod("p_partkey", F.lit(5)).cast("int"))
    return validate.path_cv(df, ["x"], "y", "fold", LAMBDAS, validate.ridge, scale=False)


def ridge_cv(spark, d):
    return rounded(spark.createDataFrame(_ridge_rows(spark, d), "lambda double, mse double, se double"), 2)


def lambda_choice(spark, d):
    rows = _ridge_rows(spark, d)
    return spark.createDataFrame([(validate.best_setting(rows), validate.one_se_setting(rows, simplest_first=False))], "least double, one_se double")


def polynomial_cv(spark, d):
    df = _parts(spark, d).select("y", (F.col("x") / 50).alias("a"), F.pow(F.col("x") / 50, F.lit(2)).alias("b"), F.pmod("p_partkey", F.lit(5)).cast("int").alias("fold"))
    rows = validate.path_cv(df, ["a", "b"], "y", "fold", [0.0, 1.0, 2.0], validate.subset_of_first, scale=False)
    return rounded(spark.createDataFrame([(int(s), m) for s, m, _ in rows], "degree long, mse double"), 2)


def learner_cv(spark, d):
    """The general form: a fit and a prediction function, a job a fold."""
    df = _parts(spark, d).withColumn("fold", F.pmod("p_partkey", F.lit(4)).cast("int"))
    rows = validate.k_fold(df, "fold", lambda train: LeastSquares(train, ["x"], "y"), lambda fit: fit.predict(), lambda p: F.abs(F.col("y") - p))
    return rounded(spark.createDataFrame(rows, "fold long, n long, mae double"), 4)


def bspline_basis(spark, d):
    cols = splines.bspline(F.col("x"), KNOTS, LOW, HIGH)
    return rounded(_parts(spark, d).select("p_partkey", *[c.alias(f"b{i}") for i, c in enumerate(cols)]), 8)


def tensor_basis(spark, d):
    a = splines.bspline(F.col("x"), [25.0], LOW, HIGH, 1)
    b = splines.bspline(F.col("y") / 1000, [1.5], 0.0, 3.0, 2)
    return rounded(_parts(spark, d).select("p_partkey", *[c.alias(f"t{i}") for i, c in enumerate(splines.tensor_product(a, b))]), 8)


def spline_residual_check(spark, d):
    """A linear spline fit by products: residuals have mean 0 in each basis column, and hat values add up to the number of columns."""
    df = _parts(spark, d)
    basis = splines.bspline(F.col("x"), [25.0], LOW, HIGH, 1)
    fit = splines.PenalizedFit(df, basis, "y", lam=0.0)
    e = F.col("y") - fit.predict()
    got = df.agg(*[F.sum(e * b).alias(f"r{i}") for i, b in enumerate(basis)], F.sum(fit.leverage()).alias("df"), F.count("*").alias("n"))
    small = [F.when(F.abs(f"r{i}") < 1e-3 * F.col("n"), 0.0).otherwise(1.0).alias(f"r{i}") for i in range(len(basis))]
    return got.select(*small, F.round("df", 4).alias("df"))


def bootstrap_fits(spark, d):
    return rounded(resample.bootstrap_moments(_parts(spark, d), "p_partkey", "x", "y", REPLICATES), 5)


def bootstrap_intervals(spark, d):
    return rounded(resample.bootstrap_summary(resample.bootstrap_moments(_parts(spark, d), "p_partkey", "x", "y", REPLICATES), "slope"), 5)


def residual_bootstrap(spark, d):
    return rounded(resample.residual_bootstrap(_parts(spark, d), "p_partkey", "x", "y", REPLICATES), 5)


QUERIES = {f.__name__: f for f in (ols_intervals, coefficient_intervals, logistic_odds, ridge_cv, lambda_choice, polynomial_cv, learner_cv, bspline_basis, tensor_basis, spline_residual_check, bootstrap_fits, bootstrap_intervals, residual_bootstrap)}

_X = "part_ AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, CAST(p_retailprice AS DOUBLE) AS y FROM part)"
# quantile of Student's t by its expansion about the normal one
_T = """q AS (SELECT 1.959963984540054::DOUBLE AS z, n - 2 AS v FROM m), t AS (SELECT z + (z**3+z)/(4*v) + (5*z**5+16*z**3+3*z)/(96*v**2) + (3*z**7+19*z**5+17*z**3-15*z)/(384*v**3) AS t FROM q)"""
_FIT = f"""WITH {_X}, m AS (SELECT count(*)::DOUBLE AS n, avg(x) AS mx, var_pop(x) * count(*) AS sxx, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0 FROM part_),
 s AS (SELECT sum((y - b0 - b1 * x) ** 2) / (max(n) - 2) AS s2 FROM part_, m), {_T}"""


def _spline_sql(x: str, interior: list[float], low: float, high: float, degree: int) -> list[str]:
    """The recursion of the basis as SQL text."""
    t = [low] * (degree + 1) + interior + [high] * (degree + 1)
    last = max(i for i in range(len(t) - 1) if t[i] < t[i + 1])

    def piece(i: int, k: int) -> str:
        if k == 0:
            return f"(CASE WHEN {x} >= {t[i]}::DOUBLE AND {x} {'<=' if i == last else '<'} {t[i + 1]}::DOUBLE THEN 1::DOUBLE ELSE 0 END)" if t[i] < t[i + 1] else "0::DOUBLE"
        terms = []
        if t[i + k] > t[i]:
            terms.append(f"(({x}) - {t[i]}::DOUBLE) / {t[i + k] - t[i]}::DOUBLE * {piece(i, k - 1)}")
        if t[i + k + 1] > t[i + 1]:
            terms.append(f"({t[i + k + 1]}::DOUBLE - ({x})) / {t[i + k + 1] - t[i + 1]}::DOUBLE * {piece(i + 1, k - 1)}")
        return "(" + " + ".join(terms) + ")" if terms else "0::DOUBLE"

    return [piece(i, degree) for i in range(len(t) - 1 - degree)]


_CUBIC = ", ".join(f"round({c}, 8) AS b{i}" for i, c in enumerate(_spline_sql("x", KNOTS, LOW, HIGH, 3)))
_TENSOR = ", ".join(f"round({c}, 8) AS t{i}" for i, c in enumerate(f"{a} * {b}" for a in _spline_sql("x", [25.0], LOW, HIGH, 1) for b in _spline_sql("(y / 1000)", [1.5], 0.0, 3.0, 2)))
# moments without each of five folds, and of the fold itself
_FOLDS = f"""WITH {_X}, p AS (SELECT *, p_partkey % 5 AS fold, x / 50 AS a, x / 50 * x / 50 AS b FROM part_), f AS (SELECT DISTINCT fold AS g FROM p),
 tr AS (SELECT g, count(*)::DOUBLE AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS sxx, covar_pop(x, y) * count(*) AS sxy, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS vaa, var_pop(b) AS vbb, covar_pop(a, b) AS vab, covar_pop(a, y) AS vay, covar_pop(b, y) AS vby FROM p, f WHERE fold <> g GROUP BY g)"""
_RIDGE = _FOLDS + f""", l AS (SELECT unnest([{", ".join(map(str, LAMBDAS))}])::DOUBLE AS lam),
 e AS (SELECT lam, g, avg((y - my - sxy / (sxx + lam) * (x - mx)) ** 2) AS mse FROM p, tr, l WHERE fold = g GROUP BY lam, g),
 c AS (SELECT lam, avg(mse) AS mse, stddev_samp(mse) / sqrt(count(*)) AS se FROM e GROUP BY lam)"""
_STEPS = ", ".join(map(str, resample.WIDE_STEPS))
_BOOT = f"""WITH {_X}, r AS (SELECT unnest(range({REPLICATES})) AS r), h AS (SELECT r, x, y, CAST('0x' || substr(md5(p_partkey || '|' || r), 1, 8) AS BIGINT) AS h FROM part_, r),
 w AS (SELECT r, x, y, len(list_filter([{_STEPS}], lambda s: h >= s))::DOUBLE AS w FROM h),
 s AS (SELECT r, sum(w) AS n, avg(CASE WHEN w > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS u, sum(w*x)/sum(w) AS ma, sum(w*y)/sum(w) AS mb, sum(w*x*x)/sum(w) AS aa, sum(w*x*y)/sum(w) AS ab, sum(w*y*y)/sum(w) AS bb FROM w GROUP BY r),
 b AS (SELECT r AS replicate, CAST(n AS BIGINT) AS n, u AS unique_share, mb AS mean, (ab-ma*mb)/sqrt((aa-ma*ma)*(bb-mb*mb)) AS correlation, (ab-ma*mb)/(aa-ma*ma) AS slope, mb-(ab-ma*mb)/(aa-ma*ma)*ma AS intercept FROM s)"""

ORACLES = {
    "ols_intervals": _FIT + """, h AS (SELECT p_partkey, b0 + b1 * x AS f, 1 / n + (x - mx) ** 2 / sxx AS h FROM part_, m)
      SELECT p_partkey, round(f, 4) AS fit, round(f - t * sqrt(s2 * h), 4) AS mean_low, round(f + t * sqrt(s2 * h), 4) AS mean_high, round(f - t * sqrt(s2 * (1 + h)), 4) AS pred_low, round(f + t * sqrt(s2 * (1 + h)), 4) AS pred_high FROM h, s, t""",
    "coefficient_intervals": _FIT + """, c AS (SELECT '(intercept)' AS term, b0 AS b, sqrt(s2 * (1 / n + mx * mx / sxx)) AS se FROM m, s UNION ALL SELECT 'x', b1, sqrt(s2 / sxx) FROM m, s)
      SELECT term, round(b, 4) AS estimate, round(b - t * se, 4) AS low, round(b + t * se, 4) AS high FROM c, t""",
    "logistic_odds": """WITH i AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS x FROM lineitem),
      c AS (SELECT count(*) FILTER (x = 1 AND y = 1)::DOUBLE AS a, count(*) FILTER (x = 1 AND y = 0)::DOUBLE AS b, count(*) FILTER (x = 0 AND y = 1)::DOUBLE AS c, count(*) FILTER (x = 0 AND y = 0)::DOUBLE AS d FROM i),
      v AS (SELECT *, a + b + c + d AS n, -2 * (a * ln(a / (a + b)) + b * ln(b / (a + b)) + c * ln(c / (c + d)) + d * ln(d / (c + d))) AS dev, -2 * ((a + c) * ln((a + c) / (a + b + c + d)) + (b + d) * ln((b + d) / (a + b + c + d))) AS nul FROM c),
      t AS (SELECT '(intercept)' AS term, ln(c / d) AS e, sqrt(1 / c + 1 / d) AS s, n, dev, nul FROM v UNION ALL SELECT 'x', ln(a * d / (b * c)), sqrt(1 / a + 1 / b + 1 / c + 1 / d), n, dev, nul FROM v)
      SELECT term, round(e, 6) AS estimate, round(s, 6) AS std_error, round(e / s, 6) AS z, round(exp(e), 6) AS odds_ratio, round(exp(e - 1.959963984540054 * s), 6) AS low, round(exp(e + 1.959963984540054 * s), 6) AS high, round(dev / n, 6) AS deviance_n, round(nul / n, 6) AS null_deviance_n, round(1 - dev / nul, 6) AS mcfadden FROM t""",
    "ridge_cv": _RIDGE + " SELECT lam AS lambda, round(mse, 2) AS mse, round(se, 2) AS se FROM c",
    "lambda_choice": _RIDGE + " SELECT (SELECT lam FROM c ORDER BY mse, lam LIMIT 1) AS least, (SELECT max(lam) FROM c WHERE mse <= (SELECT mse + se FROM c ORDER BY mse, lam LIMIT 1)) AS one_se",
    "polynomial_cv": _FOLDS + """, k AS (SELECT *, vaa * vbb - vab * vab AS det FROM tr),
      e AS (SELECT g, avg((y - my) ** 2) AS e0, avg((y - my - vay / vaa * (a - ma)) ** 2) AS e1, avg((y - my - (vbb * vay - vab * vby) / det * (a - ma) - (vaa * vby - vab * vay) / det * (b - mb)) ** 2) AS e2 FROM p, k WHERE fold = g GROUP BY g)
      SELECT 0::BIGINT AS degree, round(avg(e0), 2) AS mse FROM e UNION ALL SELECT 1, round(avg(e1), 2) FROM e UNION ALL SELECT 2, round(avg(e2), 2) FROM e""",
    "learner_cv": f"""WITH {_X}, p AS (SELECT *, p_partkey % 4 AS fold FROM part_), f AS (SELECT DISTINCT fold AS g FROM p), m AS (SELECT g, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM p, f WHERE fold <> g GROUP BY g)
      SELECT fold, count(*) AS n, round(avg(abs(y - a - b * x)), 4) AS mae FROM p, m WHERE fold = g GROUP BY fold""",
    "bspline_basis": f"WITH {_X} SELECT p_partkey, {_CUBIC} FROM part_",
    "tensor_basis": f"WITH {_X} SELECT p_partkey, {_TENSOR} FROM part_",
    "spline_residual_check": "SELECT 0.0::DOUBLE AS r0, 0.0::DOUBLE AS r1, 0.0::DOUBLE AS r2, 3.0::DOUBLE AS df",
    "bootstrap_fits": _BOOT + " SELECT replicate, n, round(unique_share, 5) AS unique_share, round(mean, 5) AS mean, round(correlation, 5) AS correlation, round(slope, 5) AS slope, round(intercept, 5) AS intercept FROM b",
    "bootstrap_intervals": _BOOT + " SELECT round(avg(slope), 5) AS mean, round(stddev_samp(slope), 5) AS se, round(quantile_cont(slope, 0.025), 5) AS low, round(quantile_cont(slope, 0.975), 5) AS high FROM b",
    "residual_bootstrap": f"""WITH {_X}, r AS (SELECT unnest(range({REPLICATES})) AS r), m AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS mx, var_pop(x) * count(*) AS sxx FROM part_),
      h AS (SELECT r, (x - mx) * (y - a - b * x) * CASE WHEN CAST('0x' || substr(md5(p_partkey || '|' || (1000 + r)), 1, 8) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS g FROM part_, r, m)
      SELECT r AS replicate, round(max(b) + sum(g) / max(sxx), 5) AS slope FROM h, m GROUP BY r""",
}
