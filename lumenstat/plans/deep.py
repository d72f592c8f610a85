"""Support paths, additive logits, experts, flexible discriminants, box growth, bootstrap of any statistic, projections, new rows in kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lumenstat.operators import additive, boxes, experts, flexible, posterior, project, pursuit, quantiles, spaces, splines, supportpath, trees, tuning
from lumenstat.operators.resample import WIDE_STEPS
from lumenstat.plans import points
from lumenstat.plans.common import rounded, table

COSTS, GAMMA = [0.002, 0.005, 0.01, 0.02, 0.05], 0.2
BOX = {"a": (10.0, 40.0), "b": (0.4, 1.2)}
REPLICATES = 6
DIRECTION = [0.6, 0.64, 0.48]


def _graded(spark, d):
    """Parts by size and a remainder of the key, in coarse steps, against a sum that a fifth of them exceed by chance."""
    k = F.pmod("p_partkey", F.lit(17))
    over = F.col("p_size") + k + F.when(F.col("p_partkey") % 5 == 0, 12).otherwise(0) > 36
    return table(spark, d, "part").select("p_partkey", (F.round(F.col("p_size") / 5.0, 0) / 2).alias("a"), (F.round(k / 4.0, 0) / 2).alias("b"), F.when(over, 1.0).otherwise(-1.0).alias("y"))


def svc_path(spark, d):
    """Every knot of the cost path of a radial classifier."""
    out = supportpath.support_path(_graded(spark, d), ["a", "b"], "y", COSTS[0], COSTS[-1], GAMMA)
    return rounded(out.drop("coefficients"), 6)


def svc_path_cv(spark, d):
    """Rows wrong and mean loss by cost, each fold scored on the path of the others."""
    df = _graded(spark, d).withColumn("fold", F.pmod("p_partkey", F.lit(5)).cast("int"))
    by = supportpath.support_path_cv(df, ["a", "b"], "y", "fold", COSTS, GAMMA)
    return rounded(by.groupBy("cost").agg(F.sum("n").alias("n"), F.sum("wrong").alias("wrong"), (F.sum("hinge") / F.sum("n")).alias("mean_hinge")))


def svc_points(spark, d):
    """The distinct weighted points that the path follows."""
    return supportpath.weighted_points(_graded(spark, d), ["a", "b"], "y").withColumn("n", F.col("n").cast("long"))


def _returned(spark, d):
    """Quantities and discounts take few values: equal rows are one, ``n`` says of how many."""
    x = F.col("l_quantity").cast("double") / 25 - 1
    return table(spark, d, "lineitem").select(x.alias("u"), (F.col("l_discount").cast("double") * 20 - 1).alias("v"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y")).groupBy("u", "v", "y").agg(F.count("*").alias("n"))


def logistic_gam(spark, d):
    """Four Newton steps of an additive logit with a term for each column: coefficients and the deviance a row before each step."""
    fit = additive.LogisticAdditive(_returned(spark, d), [[F.col("u")], [F.col("v")]], "y", 0.0, steps=4, tol=0.0, count="n")
    rows = [(fit.mean, float(fit.beta[0][0]), float(fit.beta[1][0]), *(p / fit.n for p in fit.path[:3]))]
    return rounded(spark.createDataFrame(rows, "mean double, b_u double, b_v double, deviance_0 double, deviance_1 double, deviance_2 double"), 6)


def _smooths(u, v):
    return [splines.bspline(u, [-0.5, 0.0, 0.5], -1.0, 1.0, 3), splines.bspline(v, [0.0], -1.0, 1.0, 3)]


def logistic_gam_path(spark, d):
    """Deviance by step of an additive logit with two penalised splines."""
    fit = additive.LogisticAdditive(_returned(spark, d), _smooths(F.col("u"), F.col("v")), "y", 10.0, count="n")
    return rounded(spark.createDataFrame([(i, float(p / fit.n), float(fit.null_deviance / fit.n)) for i, p in enumerate(fit.path)], "step long, deviance_n double, null_n double"))


def weighted_gam(spark, d):
    """Weighted additive fit with a term for each column: the closed solution of two weighted columns."""
    df = table(spark, d, "lineitem").select((F.col("l_quantity").cast("double") / 25 - 1).alias("u"), (F.col("l_discount").cast("double") * 20 - 1).alias("v"), (F.col("l_extendedprice").cast("double") / 10_000).alias("y"), (1 + F.col("l_tax").cast("double") * 10).alias("w"))
    fit = additive.WeightedAdditive(df, [[F.col("u")], [F.col("v")]], F.col("y"), F.col("w"), 0.0)
    return rounded(spark.createDataFrame([(fit.intercept, fit.mean, float(fit.beta[0][0]), float(fit.beta[1][0]), float(fit.rss / fit.total))], "weighted_mean double, mean double, b_u double, b_v double, mse double"))


def gam_cv(spark, d):
    """Error of the additive fit by penalty over five folds."""
    df = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity").cast("double") / 25 - 1).alias("u"), (F.col("l_discount").cast("double") * 20 - 1).alias("v"), (F.col("l_extendedprice").cast("double") / 10_000).alias("y"))
    rows = additive.additive_cv(df, _smooths(F.col("u"), F.col("v")), "y", F.pmod("l_orderkey", F.lit(5)).cast("int"), [0.1, 1.0, 10.0, 100.0], same=["u", "v"])
    return rounded(spark.createDataFrame(rows, "penalty double, mse double, se double"), 5)


def _bent(spark, d):
    """Parts whose response follows the key's remainder where they are large, and falls with their size where they are small."""
    a, b = F.col("p_size") / 10.0, F.pmod("p_partkey", F.lit(17)) / 5.0
    own = F.pmod(F.col("p_retailprice").cast("double"), F.lit(100.0)) / 200
    return table(spark, d, "part").select(a.alias("a"), b.alias("b"), (F.when(F.col("p_size") > 25, 1.5 * b).otherwise(4 - a) + own).alias("y"))


def expert_tree(spark, d):
    """Four experts under three gates: log likelihood a row by step, and at the end the mean split of the predictive variance."""
    df = _bent(spark, d)
    fit = experts.ExpertTree(df, ["a", "b"], "y", 2, 12)
    within, between = fit.variances()
    last = df.agg(F.avg(within).alias("w"), F.avg(between).alias("b"), F.avg(F.pow(F.col("y") - fit.predict(), F.lit(2))).alias("e")).first()
    return rounded(spark.createDataFrame([(i, p / fit.n, last["w"], last["b"], last["e"]) for i, p in enumerate(fit.path)], "step long, likelihood_n double, within double, between double, mse double"), 5)


def flexible_direction(spark, d):
    """Two classes on a linear basis: squared correlation of the score with its fit, and the direction (greatest entry 1)."""
    df = table(spark, d, "orders").select((F.col("o_totalprice") / 100_000).cast("double").alias("a"), F.pmod("o_custkey", F.lit(100)).cast("double").alias("b"), F.when(F.col("o_orderstatus") == "F", "F").otherwise("O").alias("s"))
    fit = flexible.FlexibleDiscriminant(df, [F.col("a"), F.col("b")], "s")
    b = fit.beta[1:, 0] / fit.beta[1 + np.abs(fit.beta[1:, 0]).argmax(), 0]
    return rounded(spark.createDataFrame([(float(fit.correlation[0]), float(b[0]), float(b[1]))], "correlation double, a double, b double"), 8)


def flexible_classes(spark, d):
    """Return flags told apart by splines of quantity and discount: rows by class and prediction."""
    df = table(spark, d, "lineitem").select((F.col("l_quantity").cast("double") / 25 - 1).alias("u"), (F.col("l_discount").cast("double") * 20 - 1).alias("v"), "l_returnflag").groupBy("u", "v", "l_returnflag").agg(F.count("*").alias("n"))
    basis = [b for g in _smooths(F.col("u"), F.col("v")) for b in g[1:]]
    fit = flexible.FlexibleDiscriminant(df, basis, "l_returnflag", 1.0, additive.block_penalty([len(g) - 1 for g in _smooths(F.col("u"), F.col("v"))]), times="n")
    return df.groupBy("l_returnflag", fit.predict().alias("predicted")).agg(F.sum("n").alias("n"))


def network_posterior(spark, d):
    """Four chains over the weights of a small network: acceptance, R-hat, coverage and the split of the predictive variance."""
    df = _bent(spark, d)
    fit = posterior.NetworkPosterior(df, ["a", "b"], "y", 3, 4, 60, 30)
    return rounded(fit.report(df).withColumns({"accepted": F.lit(float(fit.accepted.mean())), "median_rhat": F.lit(float(np.median(fit.rhat())))}), 4)


def _centred_items(spark, d):
    cols = {"a": F.col("l_quantity").cast("double"), "b": F.col("l_extendedprice").cast("double") / 1000, "c": F.col("l_discount").cast("double") * 100}
    df = table(spark, d, "lineitem").select(*[c.alias(n) for n, c in cols.items()])
    s = df.agg(*[f(n).alias(f"{k}{n}") for n in cols for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return df.select(*[((F.col(n) - s[f"m{n}"]) / s[f"s{n}"]).alias(f"z{n}") for n in cols])


def projection_gradient(spark, d):
    """Index of a fixed direction of standardised columns and its gradient there, for each index."""
    z, rows = ["za", "zb", "zc"], []
    df = _centred_items(spark, d)
    for name in ("kurtosis", "negentropy", "skewness"):
        ((value, g),) = pursuit.index_and_gradient(df, z, [np.array(DIRECTION)], name)
        rows.append((name, float(value), *map(float, g)))
    return rounded(spark.createDataFrame(rows, "index string, value double, ga double, gb double, gc double"), 5)


def projection_search(spark, d):
    """Two directions at right angles by the gradient of the negentropy index."""
    df = table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("a"), (F.col("l_extendedprice").cast("double") / 1000).alias("b"), (F.col("l_discount").cast("double") * 100).alias("c"))
    fit = pursuit.ProjectionSearch(df, ["a", "b", "c"], count=2, starts=3, steps=15)
    return rounded(spark.createDataFrame([(i, float(v), *map(float, w)) for i, (v, w) in enumerate(zip(fit.values, fit.directions, strict=True))], "place long, value double, a double, b double, c double"), 4)


def _boxed(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), ((F.col("p_size") + F.col("p_partkey") % 17) / 40.0).alias("b"), F.when(F.col("p_size") + F.col("p_partkey") % 17 > 34, 1.0).otherwise(-1.0).alias("y"))


def prim_first_paste(spark, d):
    """A box grown on each of its sides by a tenth of its rows."""
    rows = boxes.paste_sides(_boxed(spark, d), ["a", "b"], "y", BOX, 0.1)
    return rounded(spark.createDataFrame(rows, "variable string, side string, cut double, n long, mean double"))


def prim_cover(spark, d):
    """Two bumps, peeled on four rows of five, chosen and measured on the fifth, pasted, and taken out in turn."""
    df = _boxed(spark, d)
    found = boxes.cover(df.filter("p_partkey % 5 <> 0"), df.filter("p_partkey % 5 = 0"), ["a", "b"], "y", 2, 0.1, 0.1)
    return rounded(spark.createDataFrame([(i, *map(float, b["a"]), *map(float, b["b"]), s, m) for i, (b, s, m) in enumerate(found)], "bump long, a_low double, a_high double, b_low double, b_high double, support double, mean double"))


def box_overlap(spark, d):
    return rounded(boxes.overlap(_boxed(spark, d), BOX, F.col("y") > 0))


def bootstrap_medians(spark, d):
    df = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("y"))
    return rounded(quantiles.bootstrap_quantiles(df, "p_partkey", "y", 0.5, REPLICATES))


def bootstrap_any(spark, d):
    """A ratio of sums, a share and a weighted deviation by type, under the row weights of each replicate."""
    df = table(spark, d, "part").select("p_partkey", "p_type", F.col("p_retailprice").cast("double").alias("y"), F.col("p_size").cast("double").alias("x"))
    stats = {
        "ratio": lambda w: F.sum(w * F.col("y")) / F.sum(w * F.col("x")),
        "large": lambda w: F.sum(F.when(F.col("x") > 25, w).otherwise(0)) / F.sum(w),
        "deviation": lambda w: F.sqrt(F.sum(w * F.col("x") * F.col("x")) / F.sum(w) - F.pow(F.sum(w * F.col("x")) / F.sum(w), F.lit(2))),
    }
    return rounded(quantiles.bootstrap(df, "p_partkey", stats, REPLICATES, ["p_type"]), 5)


def price_quantiles(spark, d):
    """Exact deciles of the price by return flag and line status, each group cut into ranges."""
    df = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_extendedprice").cast("double").alias("y"))
    return rounded(quantiles.exact_quantiles(df, "y", {f"q{k}": k / 10 for k in (1, 3, 5, 7, 9)}, ["l_returnflag", "l_linestatus"], 2_000), 4)


def kernel_new_centred(spark, d):
    """Radial kernel of suppliers' nations with customers' nations, centred as the latter's own table."""
    own, new = points._nations(spark, d), _supplied(spark, d)
    cross = spaces.cross_pairs(new, own, "key", "v", points.GAMMA)
    return rounded(spaces.centred_new(cross.select("i", "j", "rbf"), spaces.pairs(own, "key", "v", points.GAMMA).select("i", "j", "rbf"), "rbf"))


def kernel_new_classes(spark, d):
    """Region of each nation's suppliers by the average similarity to, and the three nearest of, customers' nations."""
    own = points._nations(spark, d)
    cross, labels = spaces.cross_pairs(_supplied(spark, d), own, "key", "v", points.GAMMA), own.select("key", "label")
    a = spaces.average_similarity(cross, labels, "rbf").withColumnRenamed("predicted", "by_similarity")
    return rounded(a.join(spaces.nearest_by_distance(cross, labels, "sq_dist", 3).withColumnRenamed("predicted", "by_nearest"), "i"))


def _supplied(spark, d):
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg((F.avg(F.col("s_acctbal").cast("double")) / 1000).alias("x"), F.coalesce(F.stddev_pop(F.col("s_acctbal").cast("double")) / 1000, F.lit(0.0)).alias("y"))
    return s.select(F.col("s_nationkey").cast("long").alias("key"), F.array(F.round("x", 9), F.round("y", 9)).alias("v"))


def kernel_new_scores(spark, d):
    """First two kernel components fitted on the parts of even key, for all parts."""
    df = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 10.0).alias("a"), (F.col("p_retailprice").cast("double") / 500).alias("b"))
    fit = project.KernelComponents(df.filter("p_partkey % 2 = 0"), ["a", "b"], [[i, j] for i in (0.5, 2.0, 3.5, 5.0) for j in (2.0, 3.0, 4.0)], 0.5, 2)
    return rounded(fit.scores(df).select("p_partkey", F.abs("k1").alias("k1"), F.abs("k2").alias("k2")), 5)


def component_rebuilt(spark, d):
    """Mean squared distance of parts from their first component's line, in standard columns: one less the share of the first component."""
    df = table(spark, d, "part").select(F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").cast("double").alias("b"))
    s = df.agg(F.avg("a").alias("ma"), F.stddev_pop("a").alias("sa"), F.avg("b").alias("mb"), F.stddev_pop("b").alias("sb")).first()
    z = df.select(((F.col("a") - s["ma"]) / s["sa"]).alias("a"), ((F.col("b") - s["mb"]) / s["sb"]).alias("b"))
    fit = project.Centred(z, ["a", "b"], 1)
    return rounded(z.agg(F.avg(fit.loss()).alias("lost"), F.var_pop(fit.scores()[0]).alias("kept")), 6)


def _cuts(df, x):
    return {c: trees.midpoints(df, c, 20) for c in x}


def _sized(spark, d):
    return table(spark, d, "part").select(F.pmod("p_partkey", F.lit(5)).cast("int").alias("fold"), F.col("p_size").cast("double").alias("a"), F.pmod("p_partkey", F.lit(17)).cast("double").alias("b"), (F.col("p_retailprice").cast("double") / 10).alias("y"), F.when(F.col("p_size") + F.col("p_partkey") % 17 > 34, 1).otherwise(-1).alias("s"))


def tree_depth_cv(spark, d):
    df = _sized(spark, d)
    return rounded(spark.createDataFrame(tuning.tree_depth_cv(df, _cuts(df, ["a", "b"]), "s", "fold", 3), "depth double, mse double, se double"), 5)


def boosting_cv(spark, d):
    df = _sized(spark, d)
    return rounded(spark.createDataFrame(tuning.boosting_cv(df, _cuts(df, ["a"]), "s", "fold", 4), "round double, mse double, se double"), 5)


def adaboost_cv(spark, d):
    df = _sized(spark, d)
    return rounded(spark.createDataFrame(tuning.adaboost_cv(df, _cuts(df, ["a", "b"]), "s", "fold", 3), "round double, error double, se double"), 5)


def svc_cv(spark, d):
    df = _sized(spark, d).withColumns({"a": F.col("a") / 25 - 1, "b": F.col("b") / 8 - 1})
    return rounded(spark.createDataFrame(tuning.margin_cv(df, ["a", "b"], "s", "fold", [0.1, 1.0, 10.0], rate=0.1, steps=30), "cost double, error double, se double"), 4)


def svr_cv(spark, d):
    df = _sized(spark, d).withColumns({"a": F.col("a") / 25 - 1, "b": F.col("b") / 8 - 1})
    return rounded(spark.createDataFrame(tuning.margin_cv(df, ["a", "b"], "y", "fold", [0.1, 1.0, 10.0], 0.5, rate=0.1, steps=30), "cost double, loss double, se double"), 4)


THRESHOLDS = [0.0, 0.5, 1.0, 2.0]


def nsc_cv(spark, d):
    """Rows wrong by shrinkage over five folds of the embeddings."""
    df = table(spark, d, "embeddings").withColumn("fold", F.pmod("vec_id", F.lit(5)).cast("int"))
    rows = tuning.shrunken_cv(df, "label", "embedding", "fold", THRESHOLDS)
    return rounded(spark.createDataFrame(rows, "threshold double, n long, wrong long, active double"))


QUERIES = {f.__name__: f for f in (
    tree_depth_cv, boosting_cv, adaboost_cv, svc_cv, svr_cv, nsc_cv,
    svc_path, svc_path_cv, svc_points, logistic_gam, logistic_gam_path, weighted_gam, gam_cv, expert_tree, flexible_direction, flexible_classes, network_posterior, projection_gradient, projection_search,
    prim_first_paste, prim_cover, box_overlap, bootstrap_medians, bootstrap_any, price_quantiles, kernel_new_centred, kernel_new_classes, kernel_new_scores, component_rebuilt)}

_RET = "r AS (SELECT CAST(l_quantity AS DOUBLE) / 25 - 1 AS u, CAST(l_discount AS DOUBLE) * 20 - 1 AS v, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END AS y FROM lineitem)"
_PART = "p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, (p_size + p_partkey % 17) / 40.0::DOUBLE AS b, CASE WHEN p_size + p_partkey % 17 > 34 THEN 1.0::DOUBLE ELSE -1.0 END AS y FROM part)"
_DRAWN = f"""h AS (SELECT part.*, r, CAST('0x' || substr(md5(p_partkey || '|' || r), 1, 8) AS BIGINT) AS h FROM part, range({REPLICATES}) t(r)),
 w AS (SELECT *, list_sum(list_transform([{', '.join(map(str, WIDE_STEPS))}], lambda s: CASE WHEN h >= s THEN 1 ELSE 0 END)) AS w FROM h)"""


def _newton_sql(steps: int) -> str:
    """Weighted least squares on the working response, solved by Cramer's rule, a step a table."""
    sql = f"WITH {_RET}, t0 AS (SELECT ln(avg(y) / (1 - avg(y))) AS m, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM r)"
    for k in range(steps):
        sql += f""", e{k} AS (SELECT u, v, y, m + a * u + b * v AS e FROM r, t{k}), q{k} AS (SELECT *, 1 / (1 + exp(-e)) AS p FROM e{k}),
         z{k} AS (SELECT *, greatest(p * (1 - p), 1e-6) AS w, e + (y - p) / greatest(p * (1 - p), 1e-6) AS z FROM q{k}),
         s{k} AS (SELECT sum(w) AS n, sum(w*u)/sum(w) AS mu, sum(w*v)/sum(w) AS mv, sum(w*z)/sum(w) AS mz, 2*sum(ln(1+exp(e)) - y*e)/count(*) AS dev FROM z{k}),
         c{k} AS (SELECT sum(w*(u-mu)**2) AS uu, sum(w*(u-mu)*(v-mv)) AS uv, sum(w*(v-mv)**2) AS vv, sum(w*(u-mu)*(z-mz)) AS uz, sum(w*(v-mv)*(z-mz)) AS vz FROM z{k}, s{k}),
         t{k + 1} AS (SELECT mz - (vv*uz-uv*vz)/(uu*vv-uv*uv)*mu - (uu*vz-uv*uz)/(uu*vv-uv*uv)*mv AS m, (vv*uz-uv*vz)/(uu*vv-uv*uv) AS a, (uu*vz-uv*uz)/(uu*vv-uv*uv) AS b FROM c{k}, s{k})"""
    return sql + f" SELECT round(m, 6) AS mean, round(a, 6) AS b_u, round(b, 6) AS b_v, round(s0.dev, 6) AS deviance_0, round(s1.dev, 6) AS deviance_1, round(s2.dev, 6) AS deviance_2 FROM t{steps}, s0, s1, s2"


def _gradient_sql() -> str:
    w = DIRECTION
    sql = f"""WITH x AS (SELECT CAST(l_quantity AS DOUBLE) AS a, CAST(l_extendedprice AS DOUBLE) / 1000 AS b, CAST(l_discount AS DOUBLE) * 100 AS c FROM lineitem),
     m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(c) AS mc, stddev_pop(c) AS sc FROM x),
     z AS (SELECT (a-ma)/sa AS za, (b-mb)/sb AS zb, (c-mc)/sc AS zc FROM x, m), p AS (SELECT *, {w[0]}*za + {w[1]}*zb + {w[2]}*zc AS p FROM z)"""
    forms = {"kurtosis": ("p**4", "4*p**3", "abs(m - 3)", "sign(m - 3)"), "skewness": ("p**3", "3*p*p", "abs(m)", "sign(m)"), "negentropy": ("ln((exp(p)+exp(-p))/2)", "(exp(p)-exp(-p))/(exp(p)+exp(-p))", "(m - 0.3745672075)**2", "2*(m - 0.3745672075)")}
    one = "SELECT '{n}' AS index, round({v}, 5) AS value, round({o}*ga, 5) AS ga, round({o}*gb, 5) AS gb, round({o}*gc, 5) AS gc FROM (SELECT avg({g}) AS m, avg({s}*za) AS ga, avg({s}*zb) AS gb, avg({s}*zc) AS gc FROM p)"
    return sql + " " + " UNION ALL ".join(one.format(n=n, g=g, s=s, v=v, o=o) for n, (g, s, v, o) in forms.items())


def _paste_sql() -> str:
    lo_a, hi_a, lo_b, hi_b = *BOX["a"], *BOX["b"]
    in_a, in_b = f"a BETWEEN {lo_a} AND {hi_a}", f"b BETWEEN {lo_b} AND {hi_b}"
    sides = [("a", "low", f"{in_b} AND a < {lo_a}", "-a"), ("a", "high", f"{in_b} AND a > {hi_a}", "a"), ("b", "low", f"{in_a} AND b < {lo_b}", "-b"), ("b", "high", f"{in_a} AND b > {hi_b}", "b")]
    rows = " UNION ALL ".join(f"SELECT '{v}' AS variable, '{s}' AS side, {at} AS place, y FROM p WHERE {where}" for v, s, where, at in sides)
    return f"""WITH {_PART}, i AS (SELECT count(*) AS n, sum(y) AS s, CAST(ceil(0.1 * count(*)) AS BIGINT) AS need FROM p WHERE {in_a} AND {in_b}), o AS ({rows}),
      k AS (SELECT *, row_number() OVER (PARTITION BY variable, side ORDER BY place) AS rk, count(*) OVER (PARTITION BY variable, side) AS all_ FROM o),
      c AS (SELECT variable, side, max(place) AS cut FROM k, i WHERE rk = least(need, all_) GROUP BY 1, 2)
      SELECT variable, side, round(CASE WHEN side = 'low' THEN -cut ELSE cut END, 6) AS cut, i.n + count(*) AS n, round((i.s + sum(o.y)) / (i.n + count(*)), 6) AS mean FROM o JOIN c USING (variable, side), i WHERE o.place <= cut GROUP BY variable, side, cut, i.n, i.s"""


_SUPPLIED = """u AS (SELECT CAST(s_nationkey AS BIGINT) AS key, round(avg(CAST(s_acctbal AS DOUBLE)) / 1000, 9) AS x, round(stddev_pop(CAST(s_acctbal AS DOUBLE)) / 1000, 9) AS y FROM supplier GROUP BY 1),
 cr AS (SELECT u.key AS i, v.key AS j, v.label, (u.x-v.x)**2 + (u.y-v.y)**2 AS d, exp(-0.5*((u.x-v.x)**2 + (u.y-v.y)**2)) AS k FROM u, v)"""

ORACLES = {
    "svc_points": "SELECT round(p_size / 5.0, 0)::DOUBLE / 2 AS a, round((p_partkey % 17) / 4.0, 0)::DOUBLE / 2 AS b, CASE WHEN p_size + p_partkey % 17 + CASE WHEN p_partkey % 5 = 0 THEN 12 ELSE 0 END > 36 THEN 1.0::DOUBLE ELSE -1.0 END AS y, count(*) AS n FROM part GROUP BY 1, 2, 3",
    "logistic_gam": _newton_sql(4),
    "weighted_gam": """WITH x AS (SELECT CAST(l_quantity AS DOUBLE) / 25 - 1 AS u, CAST(l_discount AS DOUBLE) * 20 - 1 AS v, CAST(l_extendedprice AS DOUBLE) / 10000 AS y, 1 + CAST(l_tax AS DOUBLE) * 10 AS w FROM lineitem),
      s AS (SELECT sum(w) AS n, sum(w*u)/sum(w) AS mu, sum(w*v)/sum(w) AS mv, sum(w*y)/sum(w) AS my FROM x),
      c AS (SELECT sum(w*(u-mu)**2) AS uu, sum(w*(u-mu)*(v-mv)) AS uv, sum(w*(v-mv)**2) AS vv, sum(w*(u-mu)*(y-my)) AS uy, sum(w*(v-mv)*(y-my)) AS vy, sum(w*(y-my)**2) AS yy FROM x, s),
      b AS (SELECT *, (vv*uy-uv*vy)/(uu*vv-uv*uv) AS bu, (uu*vy-uv*uy)/(uu*vv-uv*uv) AS bv FROM c, s)
      SELECT round(my, 6) AS weighted_mean, round(my - bu*mu - bv*mv, 6) AS mean, round(bu, 6) AS b_u, round(bv, 6) AS b_v, round((yy - bu*uy - bv*vy)/n, 6) AS mse FROM b""",
    "flexible_direction": """WITH x AS (SELECT CAST(o_totalprice / 100000 AS DOUBLE) AS a, CAST(o_custkey % 100 AS DOUBLE) AS b, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END AS y FROM orders),
      m AS (SELECT var_pop(a) AS aa, covar_pop(a, b) AS ab, var_pop(b) AS bb, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, var_pop(y) AS yy FROM x),
      r AS (SELECT *, (bb*ay - ab*by_)/(aa*bb - ab*ab) AS u, (aa*by_ - ab*ay)/(aa*bb - ab*ab) AS v FROM m), s AS (SELECT *, CASE WHEN abs(u) >= abs(v) THEN u ELSE v END AS top FROM r)
      SELECT round((u*ay + v*by_)/yy, 8) AS correlation, round(u/top, 8) AS a, round(v/top, 8) AS b FROM s""",
    "projection_gradient": _gradient_sql(),
    "prim_first_paste": _paste_sql(),
    "box_overlap": f"WITH {_PART}, i AS (SELECT a BETWEEN 10 AND 40 AND b BETWEEN 0.4 AND 1.2 AS i, y > 0 AS t FROM p) SELECT round(count(*) FILTER (i AND t) / count(*) FILTER (i), 6) AS precision, round(count(*) FILTER (i AND t) / count(*) FILTER (t), 6) AS recall, round(count(*) FILTER (i AND t) / count(*) FILTER (i OR t), 6) AS jaccard FROM i",
    "bootstrap_medians": f"WITH {_DRAWN}, x AS (SELECT r, CAST(p_retailprice AS DOUBLE) AS y, unnest(range(CAST(w AS BIGINT))) AS c FROM w) SELECT r AS replicate, count(*) AS n, round(quantile_cont(y, 0.5), 6) AS quantile FROM x GROUP BY 1",
    "bootstrap_any": f"""WITH {_DRAWN}, x AS (SELECT r, p_type, CAST(p_retailprice AS DOUBLE) AS y, CAST(p_size AS DOUBLE) AS x, unnest(range(CAST(w AS BIGINT))) AS c FROM w)
      SELECT p_type, r AS replicate, round(sum(y)/sum(x), 5) AS ratio, round(count(*) FILTER (x > 25)/count(*), 5) AS large, round(stddev_pop(x), 5) AS deviation FROM x GROUP BY 1, 2""",
    "price_quantiles": "SELECT l_returnflag, l_linestatus, " + ", ".join(f"round(quantile_cont(CAST(l_extendedprice AS DOUBLE), {k / 10}), 4) AS q{k}" for k in (1, 3, 5, 7, 9)) + " FROM lineitem GROUP BY 1, 2",
    "kernel_new_centred": points._PAIRS + ", " + _SUPPLIED + """, rm AS (SELECT i, avg(k) AS r FROM cr GROUP BY 1), cm AS (SELECT j, avg(rbf) AS c FROM p GROUP BY 1), mm AS (SELECT avg(rbf) AS m FROM p)
      SELECT cr.i, cr.j, round(k - r - c + m, 6) AS rbf FROM cr JOIN rm USING (i) JOIN cm USING (j), mm""",
    "kernel_new_classes": points._PAIRS + ", " + _SUPPLIED + """, sm AS (SELECT i, label, avg(k) AS s FROM cr GROUP BY 1, 2), a AS (SELECT i, label AS by_similarity, s AS similarity FROM sm QUALIFY row_number() OVER (PARTITION BY i ORDER BY round(-s, 9), label) = 1),
      nn AS (SELECT i, label FROM cr QUALIFY row_number() OVER (PARTITION BY i ORDER BY round(d, 9), j) <= 3), vt AS (SELECT i, label, count(*) AS c FROM nn GROUP BY 1, 2),
      b AS (SELECT i, label AS by_nearest, c / sum(c) OVER (PARTITION BY i) AS share FROM vt QUALIFY row_number() OVER (PARTITION BY i ORDER BY c DESC, label) = 1)
      SELECT i, by_similarity, round(similarity, 6) AS similarity, by_nearest, round(share, 6) AS share FROM a JOIN b USING (i)""",
    "nsc_cv": f"""WITH e AS (SELECT vec_id, label, CAST(vec_id % 5 AS INT) AS f, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS i FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
      fs AS (SELECT DISTINCT f AS o FROM e), c AS (SELECT o, label, i, count(*)::DOUBLE AS n, avg(x) AS m, var_pop(x) * count(*) AS ss FROM e JOIN fs ON f <> o GROUP BY 1, 2, 3),
      p AS (SELECT o, i, sum(n * m) / sum(n) AS mid, sum(n) AS total, sqrt(sum(ss) / (sum(n) - count(*))) AS s FROM c GROUP BY 1, 2), s0 AS (SELECT o, median(s) AS s0 FROM p GROUP BY 1),
      d AS (SELECT o, label, i, n, total, mid, s + s0 AS w, sqrt(1 / n - 1 / total) * (s + s0) AS sc, (m - mid) / (sqrt(1 / n - 1 / total) * (s + s0)) AS d FROM c JOIN p USING (o, i) JOIN s0 USING (o)),
      k AS (SELECT *, mid + sc * sign(d) * greatest(abs(d) - t, 0) AS centre FROM d, (SELECT unnest({THRESHOLDS})::DOUBLE AS t)),
      g AS (SELECT e.vec_id, any_value(e.label) AS own, k.label, t, round(sum((x - centre) ** 2 / (w * w)) - 2 * ln(any_value(n) / any_value(total)), 9) AS far FROM e JOIN k ON e.f = k.o AND e.i = k.i GROUP BY e.vec_id, k.label, t),
      b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY vec_id, t ORDER BY far, label) = 1),
      a AS (SELECT t, avg(c) AS active FROM (SELECT t, o, count(DISTINCT i) FILTER (abs(d) > t) AS c FROM k GROUP BY 1, 2) GROUP BY 1)
      SELECT t AS threshold, count(*) AS n, count(*) FILTER (own <> label) AS wrong, round(any_value(active), 6) AS active FROM b JOIN a USING (t) GROUP BY 1""",
    "component_rebuilt": "SELECT round(1 - abs(corr(p_size, p_retailprice)), 6) AS lost, round(1 + abs(corr(p_size, p_retailprice)), 6) AS kept FROM part",
}
