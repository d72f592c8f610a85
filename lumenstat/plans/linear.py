"""Summaries and linear models on lineitem, part and orders."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lumenstat.functions import soft_threshold
from lumenstat.operators.linear import LeastSquares, coordinate_descent, gram, matrix
from lumenstat.operators.quantiles import exact_quantiles
from lumenstat.plans.common import r6, rounded, table

Y, X = "l_extendedprice", ["l_quantity", "l_discount"]
LAMBDAS = (0.0, 1.0, 10.0, 100.0, 1000.0)


def _items(spark, d):
    return table(spark, d, "lineitem").select(*X, "l_tax", Y, "l_returnflag", "l_orderkey")


def ols_simple(spark, d):
    return rounded(_items(spark, d).agg(F.regr_slope(Y, "l_quantity").alias("slope"), F.regr_intercept(Y, "l_quantity").alias("intercept"), F.regr_r2(Y, "l_quantity").alias("r2")), 4)


def ols_multi(spark, d):
    fit = LeastSquares(_items(spark, d), X, Y)
    return rounded(fit.table(spark), 4)


def ols_fit_stats(spark, d):
    f = LeastSquares(_items(spark, d), X, Y)
    k = len(X)
    r2 = 1 - f.rss / f.tss
    row = (int(f.n), f.rss / f.n, f.tss / f.n, r2, 1 - (1 - r2) * (f.n - 1) / f.df_resid, (f.tss - f.rss) / k / f.sigma2)
    return rounded(spark.createDataFrame([tuple(map(float, row[1:])) + (row[0],)], "rss_n double, tss_n double, r2 double, adj_r2 double, f_value double, n long").select("n", "rss_n", "tss_n", "r2", "adj_r2", "f_value"), 4)


def ols_leverage(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    fit = LeastSquares(parts, ["p_size"], "p_retailprice")
    h, e = fit.leverage(), F.col("p_retailprice") - fit.predict()
    return parts.select("p_partkey", r6(h).alias("leverage"), F.round(e, 4).alias("residual"), F.round(e / F.sqrt(F.lit(fit.sigma2) * (1 - h)), 4).alias("studentized"))


def loocv_ols(spark, d):
    parts = table(spark, d, "part").select(F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    fit = LeastSquares(parts, ["p_size"], "p_retailprice")
    e = (F.col("p_retailprice") - fit.predict()) / (1 - fit.leverage())
    return parts.agg(F.round(F.avg(e * e), 3).alias("loocv_mse"), F.count("*").alias("n"))


def best_subset_all(spark, d):
    """Every subset of the predictors, from the mean alone to all of them; best: the least error of its size."""
    names = [*X, "l_tax"]
    full, rows = matrix(gram(_items(spark, d), names, Y).first(), 5), []
    for mask in range(1 << len(names)):
        ix = [0, *[i + 1 for i in range(len(names)) if mask >> i & 1]]
        b = np.linalg.solve(full[np.ix_(ix, ix)], full[ix, 4])
        rows.append((",".join(names[i - 1] for i in ix[1:]), len(ix) - 1, float((full[4, 4] - b @ full[ix, 4]) / full[0, 0])))
    least = {k: min(r[2] for r in rows if r[1] == k) for k in range(len(names) + 1)}
    return rounded(spark.createDataFrame([(*r, r[2] == least[r[1]]) for r in rows], "model string, size int, mse double, best boolean"), 2)


def best_subset(spark, d):
    return best_subset_all(spark, d).drop("best")


def ridge_path(spark, d):
    df = _items(spark, d)
    m, rows = matrix(gram(df, X, Y).first(), 4), []
    mean = m[0, 1:] / m[0, 0]
    c = m[1:, 1:] - m[0, 0] * np.outer(mean, mean)
    for lam in LAMBDAS:
        b = np.linalg.solve(c[:2, :2] + lam * np.eye(2), c[:2, 2])
        h = np.trace(np.linalg.solve(c[:2, :2] + lam * np.eye(2), c[:2, :2]))
        rows.append((lam, float(b[0]), float(b[1]), float(h)))
    return rounded(spark.createDataFrame(rows, "lambda double, b_quantity double, b_discount double, df double"), 4)


def standardize(spark, d):
    df = table(spark, d, "part")
    s = df.agg(F.avg("p_retailprice").alias("m"), F.stddev_samp("p_retailprice").alias("s"))
    return df.crossJoin(F.broadcast(s)).select("p_partkey", r6((F.col("p_retailprice") - F.col("m")) / F.when(F.col("s") < 1e-12, 1.0).otherwise(F.col("s"))).alias("z"))


def lasso_univariate(spark, d):
    df = table(spark, d, "part").select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    s = df.agg((F.covar_pop("x", "y") / F.stddev_pop("x")).alias("score"))
    grid = spark.createDataFrame([(float(x),) for x in (0, 1, 5, 20, 1000)], "lambda double")
    return grid.crossJoin(F.broadcast(s)).select("lambda", F.round(soft_threshold(F.col("score"), F.col("lambda")), 6).alias("beta"))


def lambda_max(spark, d):
    df = _items(spark, d)
    return df.agg(F.round(F.greatest(*[F.abs(F.covar_pop(x, Y) / F.stddev_pop(x)) for x in [*X, "l_tax"]]), 6).alias("lambda_max"))


def elastic_net(spark, d):
    m = matrix(gram(_items(spark, d), [*X, "l_tax"], Y).first(), 5)
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    c = m[1:, 1:] - n * np.outer(mean, mean)
    sd = np.sqrt(np.diag(c)[:3] / n)
    xtx, xty, rows, b = c[:3, :3] / np.outer(sd, sd), c[:3, 3] / sd, [], None
    for lam in (200.0, 100.0, 50.0, 10.0, 1.0):
        b = coordinate_descent(xtx, xty, n, lam, 0.5, b)
        rows += [(lam, name, float(x)) for name, x in zip([*X, "l_tax"], b / sd, strict=True)]
    return rounded(spark.createDataFrame(rows, "lambda double, term string, beta double"), 5)


def group_summary(spark, d):
    q, items = F.col("l_extendedprice"), _items(spark, d)
    by = items.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg(q).alias("mean"), F.stddev_samp(q).alias("sd"), F.min(q).alias("low"), F.max(q).alias("high"))
    cuts = exact_quantiles(items.select(F.col("l_returnflag").alias("_flag"), q), "l_extendedprice", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["_flag"])
    both = by.join(cuts, F.col("l_returnflag").eqNullSafe(F.col("_flag")))
    return rounded(both.select("l_returnflag", "n", "mean", "sd", "q1", "median", "q3", "low", "high"), 4)


def correlations(spark, d):
    cols = [*X, "l_tax", Y]
    row = _items(spark, d).agg(*[F.corr(a, b).alias(f"{a}|{b}") for i, a in enumerate(cols) for b in cols[i + 1 :]])
    return row.unpivot([], row.columns, "pair", "r").select(F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), r6("r").alias("r"))


def covariance_pca_share(spark, d):
    cols = ["l_quantity", "l_extendedprice"]
    v = _items(spark, d).agg(*[F.var_samp(c).alias(c) for c in cols], F.corr(*cols).alias("r")).select("r")
    e = F.col("r")
    return v.select(F.round(1 + F.abs(e), 8).alias("first_variance"), F.round(1 - F.abs(e), 8).alias("second_variance"), F.round((1 + F.abs(e)) / 2, 8).alias("first_share"))


_M = """WITH m AS (SELECT count(*)::DOUBLE n, sum(l_quantity) a, sum(l_discount) b, sum(l_extendedprice) y, sum(l_quantity*l_quantity) aa, sum(l_quantity*l_discount) ab,
 sum(l_discount*l_discount) bb, sum(l_quantity*l_extendedprice) ay, sum(l_discount*l_extendedprice) byy, sum(l_extendedprice*l_extendedprice) yy FROM lineitem),
 c AS (SELECT n, a/n ma, b/n mb, y/n my, aa-a*a/n saa, ab-a*b/n sab, bb-b*b/n sbb, ay-a*y/n say, byy-b*y/n sby, yy-y*y/n syy FROM m),
 f AS (SELECT *, saa*sbb-sab*sab det FROM c), g AS (SELECT *, (sbb*say-sab*sby)/det b1, (saa*sby-sab*say)/det b2 FROM f),
 r AS (SELECT *, my-b1*ma-b2*mb b0, syy-b1*say-b2*sby rss FROM g), s AS (SELECT *, rss/(n-3) s2 FROM r)"""

_P = """WITH m AS (SELECT count(*)::DOUBLE n, avg(p_size) mx, avg(p_retailprice) my, sum((p_size-(SELECT avg(p_size) FROM part))*(p_size-(SELECT avg(p_size) FROM part))) sxx,
 regr_slope(p_retailprice, p_size) b1, regr_intercept(p_retailprice, p_size) b0 FROM part),
 e AS (SELECT p_partkey, 1/n + (p_size-mx)*(p_size-mx)/sxx h, p_retailprice-b0-b1*p_size e, n FROM part, m), s AS (SELECT sum(e*e)/(max(n)-2) s2 FROM e)"""


def _subset_sql() -> str:
    """Mean squared error of every subset from the correlations: r' C^-1 r is the explained share."""
    names = [*X, "l_tax"]
    c = ", ".join(f"corr({a},{b}) AS r{i}{j}" for i, a in enumerate(names) for j, b in enumerate(names) if i < j) + ", " + ", ".join(f"corr({a},{Y}) AS y{i}" for i, a in enumerate(names))
    rows = ["SELECT '' AS model, 0 AS size, v AS mse FROM c"] + [f"SELECT '{a}', 1, v*(1-y{i}*y{i}) FROM c" for i, a in enumerate(names)]
    rows += [f"SELECT '{names[i]},{names[j]}', 2, v*(1-(y{i}*y{i}+y{j}*y{j}-2*y{i}*y{j}*r{i}{j})/(1-r{i}{j}*r{i}{j})) FROM c" for i in range(3) for j in range(i + 1, 3)]
    top = "y0*y0*(1-r12*r12)+y1*y1*(1-r02*r02)+y2*y2*(1-r01*r01)+2*(y0*y1*(r02*r12-r01)+y0*y2*(r01*r12-r02)+y1*y2*(r01*r02-r12))"
    rows.append(f"SELECT '{','.join(names)}', 3, v*(1-({top})/(1+2*r01*r02*r12-r01*r01-r02*r02-r12*r12)) FROM c")
    return f"WITH c AS (SELECT var_pop({Y}) AS v, {c} FROM lineitem), s AS (" + " UNION ALL ".join(rows) + ")"


_LEVELS = ", ".join(f"({x})" for x in LAMBDAS)
QUERIES = {f.__name__: f for f in (ols_simple, ols_multi, ols_fit_stats, ols_leverage, loocv_ols, best_subset, best_subset_all, ridge_path, standardize, lasso_univariate, lambda_max, elastic_net, group_summary, correlations, covariance_pca_share)}
ORACLES = {
    "ols_simple": "SELECT round(regr_slope(l_extendedprice,l_quantity),4) AS slope, round(regr_intercept(l_extendedprice,l_quantity),4) AS intercept, round(regr_r2(l_extendedprice,l_quantity),4) AS r2 FROM lineitem",
    "ols_multi": _M + """, t AS (SELECT '(intercept)' AS term, b0 AS estimate, sqrt(s2*(1/n + (ma*ma*sbb-2*ma*mb*sab+mb*mb*saa)/det)) AS std_error FROM s UNION ALL
      SELECT 'l_quantity', b1, sqrt(s2*sbb/det) FROM s UNION ALL SELECT 'l_discount', b2, sqrt(s2*saa/det) FROM s)
      SELECT term, round(estimate,4) AS estimate, round(std_error,4) AS std_error, round(estimate/std_error,4) AS t_value FROM t""",
    "ols_fit_stats": _M + " SELECT n::BIGINT AS n, round(rss/n,4) AS rss_n, round(syy/n,4) AS tss_n, round(1-rss/syy,4) AS r2, round(1-(rss/(n-3))/(syy/(n-1)),4) AS adj_r2, round((syy-rss)/2/s2,4) AS f_value FROM s",
    "ols_leverage": _P + " SELECT p_partkey, round(h,6) AS leverage, round(e,4) AS residual, round(e/sqrt(s2*(1-h)),4) AS studentized FROM e, s",
    "loocv_ols": _P + " SELECT round(avg(power(e/(1-h),2)),3) AS loocv_mse, count(*) AS n FROM e",
    "best_subset": _subset_sql() + " SELECT model, size, round(mse, 2) AS mse FROM s",
    "best_subset_all": _subset_sql() + " SELECT model, size, round(mse, 2) AS mse, mse = min(mse) OVER (PARTITION BY size) AS best FROM s",
    "ridge_path": _M + f""", l AS (SELECT x::DOUBLE AS lam FROM (VALUES {_LEVELS}) v(x)), q AS (SELECT *, (saa+lam)*(sbb+lam)-sab*sab AS dd FROM s, l)
      SELECT lam AS lambda, round(((sbb+lam)*say-sab*sby)/dd,4) AS b_quantity, round(((saa+lam)*sby-sab*say)/dd,4) AS b_discount, round(((sbb+lam)*saa-2*sab*sab+(saa+lam)*sbb)/dd,4) AS df FROM q""",
    "standardize": "SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 6) AS z FROM part",
    "lasso_univariate": """WITH s AS (SELECT covar_pop(p_retailprice, p_size)/stddev_pop(p_size) AS sc FROM part)
      SELECT x::DOUBLE AS lambda, round(sign(sc)*greatest(abs(sc)-x,0),6) AS beta FROM s, (VALUES (0),(1),(5),(20),(1000)) v(x)""",
    "lambda_max": "SELECT round(greatest(abs(covar_pop(l_extendedprice,l_quantity)/stddev_pop(l_quantity)),abs(covar_pop(l_extendedprice,l_discount)/stddev_pop(l_discount)),abs(covar_pop(l_extendedprice,l_tax)/stddev_pop(l_tax))),6) AS lambda_max FROM lineitem",
    "group_summary": """SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice),4) AS mean, round(stddev_samp(l_extendedprice),4) AS sd, round(quantile_cont(l_extendedprice,0.25),4) AS q1,
      round(quantile_cont(l_extendedprice,0.5),4) AS median, round(quantile_cont(l_extendedprice,0.75),4) AS q3, round(min(l_extendedprice),4) AS low, round(max(l_extendedprice),4) AS high FROM lineitem GROUP BY 1""",
    "correlations": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a},{b}),6) AS r FROM lineitem" for i, a in enumerate([*X, "l_tax", Y]) for b in [*X, "l_tax", Y][i + 1 :]),
    "covariance_pca_share": "SELECT round(1+abs(r),8) AS first_variance, round(1-abs(r),8) AS second_variance, round((1+abs(r))/2,8) AS first_share FROM (SELECT corr(l_quantity,l_extendedprice) r FROM lineitem)",
}
