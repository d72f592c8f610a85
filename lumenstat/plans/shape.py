"""Margins, boxes, components, chain diagnostics, itemset borders, graph tables and cluster scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenstat.operators import baskets, boxes, chains, cluster, graph, margin, quantiles, reduce
from lumenstat.plans import learn
from lumenstat.plans.common import rounded, table

V = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
BOX = {"a": (10.0, 40.0), "b": (0.4, 1.2)}
CHAINS, LAGS = 4, 50


def _parts(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_type", "p_brand", (F.col("p_size") / 50.0).alias("s"), F.col("p_size").cast("double").alias("a"), ((F.col("p_size") + F.col("p_partkey") % 17) / 40.0).alias("b"), F.when(F.col("p_size") + F.col("p_partkey") % 17 > 34, 1.0).otherwise(-1.0).alias("y"))


def svc_two_steps(spark, d):
    w, b, path = margin.svc(_parts(spark, d), ["s", "b"], "y", 0.01, 0.1, 2)
    return rounded(spark.createDataFrame([(float(w[0]), float(w[1]), float(b), float(path[1]))], "w_size double, w_price double, b double, objective double"), 6)


def box_stats(spark, d):
    return rounded(boxes.box_statistics(_parts(spark, d), "y", BOX), 6)


def prim_trajectory(spark, d):
    path = boxes.peel(_parts(spark, d), ["a", "b"], "y", 0.1, 0.3)
    return rounded(spark.createDataFrame([(k, *p) for k, p in enumerate(path)], "step int, variable string, side string, cut double, support double, mean double"), 6)


def _items(spark, d):
    return table(spark, d, "lineitem").select(*V).withColumn("l_extendedprice", F.col("l_extendedprice") / 10000)


def covariance_matrix(spark, d):
    _, _, cov = reduce.covariance(_items(spark, d), V)
    out = spark.createDataFrame([(V[i], V[j], float(cov[i, j])) for i in range(4) for j in range(i, 4)], "x string, y string, cov double")
    return out.withColumn("cov", F.round("cov", 4) + 0.0)  # no negative zero


def principal_components(spark, d):
    c = reduce.Components(_items(spark, d), V)
    return rounded(spark.createDataFrame([(k, float(c.variance[k]), float(c.share[k]), *map(float, c.axes[:, k])) for k in range(4)], "component int, variance double, share double, " + ", ".join(f"{v} double" for v in V)), 6)


def component_regression(spark, d):
    """On all components, which gives least squares back."""
    b0, b = reduce.component_regression(_parts(spark, d), ["a"], "b", 1)
    return rounded(spark.createDataFrame([(float(b0), float(b[0]))], "intercept double, slope double"), 8)


def _intervals(draws):
    """Mean and exact quantiles of each chain, whatever its length."""
    means = draws.groupBy("chain").agg(F.avg("value").alias("mean"))
    return means.join(quantiles.exact_quantiles(draws, "value", {"low": 0.025, "median": 0.5, "high": 0.975}, ["chain"]), "chain")


def _all_draws(spark, d):
    return table(spark, d, "events").select((F.col("event_id") % CHAINS).alias("chain"), F.floor(F.col("event_id") / CHAINS).alias("step"), "value")


def chain_rhat_all(spark, d):
    return rounded(chains.rhat(_all_draws(spark, d)), 6)


def chain_autocorrelation_all(spark, d):
    return rounded(chains.autocorrelations(_all_draws(spark, d), LAGS).select("chain", F.col("lag").cast("int").alias("lag"), "rho"), 6)


def chain_effective_size_all(spark, d):
    return rounded(chains.effective_size(_all_draws(spark, d)), 4)


def credible_interval_all(spark, d):
    return rounded(_intervals(_all_draws(spark, d)), 6)


def _found(spark, d):
    return baskets.supports(learn._baskets(spark, d), 3, 0.1)


def closed_itemsets(spark, d):
    return rounded(baskets.closed(_found(spark, d)))


def maximal_itemsets(spark, d):
    return rounded(baskets.maximal(_found(spark, d)))


def graph_degrees_all(spark, d):
    return graph.degrees(*learn.graph_all(spark, d))


def graph_transition_all(spark, d):
    return rounded(graph.transition(learn.graph_all(spark, d)[1]))


def cluster_sums(spark, d):
    return rounded(cluster.sums_of_squares(_parts(spark, d), "p_type", ["a", "b"]), 4)


def cluster_rand(spark, d):
    return rounded(cluster.rand_index(_parts(spark, d), "p_type", "p_brand"), 6)


def metropolis_normal(spark, d):
    draws = chains.metropolis(spark, lambda x: -0.5 * x * x, 4, 2000, 2.4, burn=200)
    return rounded(draws.groupBy("chain").agg(F.avg("value").alias("mean"), F.stddev("value").alias("sd"), F.avg(F.col("accepted").cast("double")).alias("accepted")), 6)


_P = "WITH p AS (SELECT p_partkey, p_type, p_brand, p_size/50.0::DOUBLE AS s, p_size::DOUBLE AS a, (p_size+p_partkey%17)::DOUBLE/40 AS b, CASE WHEN p_size+p_partkey%17>34 THEN 1.0::DOUBLE ELSE -1.0 END AS y FROM part)"
_N = "WITH e AS (SELECT DISTINCT 2*l_partkey AS src, 2*l_suppkey+1 AS dst FROM lineitem WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL), n AS (SELECT 2*p_partkey AS id FROM part UNION SELECT 2*s_suppkey+1 FROM supplier UNION SELECT src FROM e UNION SELECT dst FROM e)"
_I = learn.ORACLES["itemsets"]
_UP = "WITH f AS (" + _I + "), g AS (SELECT *, string_split(itemset, ',') AS items FROM f) SELECT itemset, size, n, support FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.size>a.size AND list_has_all(b.items, a.items){})"


def _svc_sql() -> str:
    sql = _P + ", t0 AS (SELECT 0.0::DOUBLE AS u, 0.0::DOUBLE AS v, 0.0::DOUBLE AS c)"
    for k, step in enumerate(("0.1", f"{0.1 / (1 + 1e-4)!r}::DOUBLE")):
        sql += f", m{k} AS (SELECT *, y*(u*s+v*b+c) AS m FROM p, t{k}), g{k} AS (SELECT any_value(u) AS u, any_value(v) AS v, any_value(c) AS c, sum(CASE WHEN m<1 THEN y*s ELSE 0 END) AS gu, sum(CASE WHEN m<1 THEN y*b ELSE 0 END) AS gv, sum(CASE WHEN m<1 THEN y ELSE 0 END) AS gc, sum(greatest(1-m,0)) AS loss FROM m{k})"
        sql += f", t{k + 1} AS (SELECT u-{step}*(u-0.01*gu) AS u, v-{step}*(v-0.01*gv) AS v, c+{step}*0.01*gc AS c, 0.5*(u*u+v*v)+0.01*loss AS obj FROM g{k})"
    return sql + " SELECT round(u,6) AS w_size, round(v,6) AS w_price, round(c,6) AS b, round(obj,6) AS objective FROM t2"


_DA = f"WITH x AS (SELECT event_id%{CHAINS} AS chain, event_id//{CHAINS} AS step, value FROM events)"
_AA = _DA + f", c AS (SELECT chain, step, value-avg(value) OVER (PARTITION BY chain) AS c FROM x), v AS (SELECT chain, sum(c*c) AS v FROM c GROUP BY 1), l AS (SELECT chain, step-lag AS step, c, lag FROM c, range({LAGS + 1}) t(lag)) SELECT a.chain, a.lag::INT AS lag, round(sum(a.c*b.c)/any_value(v),6) AS rho FROM l a JOIN c b ON a.chain=b.chain AND a.step=b.step JOIN v ON v.chain=a.chain GROUP BY 1, 2"
QUERIES = {f.__name__: f for f in (svc_two_steps, box_stats, prim_trajectory, covariance_matrix, principal_components, component_regression, chain_rhat_all, chain_autocorrelation_all, chain_effective_size_all, credible_interval_all, closed_itemsets, maximal_itemsets, graph_degrees_all, graph_transition_all, cluster_sums, cluster_rand, metropolis_normal)}
ORACLES = {
    "svc_two_steps": _svc_sql(),
    "box_stats": _P + ", i AS (SELECT CASE WHEN a BETWEEN 10 AND 40 AND b BETWEEN 0.4 AND 1.2 THEN y END AS z FROM p) SELECT count(z) AS n, round(count(z)/count(*),6) AS support, round(avg(z),6) AS mean, round(quantile_cont(z,0.5),6) AS median FROM i",
    "covariance_matrix": " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, round(covar_samp({x},{y}),4)+0.0 AS cov FROM (SELECT * REPLACE (l_extendedprice/10000 AS l_extendedprice) FROM lineitem)" for i, x in enumerate(V) for y in V[i:]),
    "component_regression": _P + " SELECT round(regr_intercept(b,a),8) AS intercept, round(regr_slope(b,a),8) AS slope FROM p",
    "chain_rhat_all": _DA + ", m AS (SELECT chain, avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM x GROUP BY 1) SELECT round(sqrt(((max(n)-1)/max(n)*avg(v)+var_samp(m))/avg(v)),6) AS rhat FROM m",
    "chain_autocorrelation_all": _AA,
    "credible_interval_all": _DA + " SELECT chain, round(avg(value),6) AS mean, round(quantile_cont(value,0.025),6) AS low, round(quantile_cont(value,0.5),6) AS median, round(quantile_cont(value,0.975),6) AS high FROM x GROUP BY 1",
    "closed_itemsets": _UP.format(" AND b.n=a.n"),
    "maximal_itemsets": _UP.format(""),
    "graph_degrees_all": _N + ", o AS (SELECT src, count(*) AS o FROM e GROUP BY 1), i AS (SELECT dst, count(*) AS i FROM e GROUP BY 1) SELECT id, coalesce(o,0) AS out_degree, coalesce(i,0) AS in_degree, o IS NULL AS dangling FROM n LEFT JOIN o ON src=id LEFT JOIN i ON dst=id",
    "graph_transition_all": _N + " SELECT src, dst, round(1.0/count(*) OVER (PARTITION BY src),6)::DOUBLE AS probability FROM e",
    "cluster_sums": _P + ", g AS (SELECT p_type, var_pop(a)*count(*)+var_pop(b)*count(*) AS w FROM p GROUP BY 1), t AS (SELECT var_pop(a)*count(*)+var_pop(b)*count(*) AS t FROM p), s AS (SELECT sum(w) AS w FROM g) SELECT round(t,4) AS total, round(w,4) AS within, round(t-w,4) AS between FROM t, s",
    "cluster_rand": _P + ", c AS (SELECT sum(n*(n-1)/2) AS c FROM (SELECT count(*) AS n FROM p GROUP BY p_type, p_brand)), x AS (SELECT sum(n*(n-1)/2) AS x FROM (SELECT count(*) AS n FROM p GROUP BY p_type)), y AS (SELECT sum(n*(n-1)/2) AS y FROM (SELECT count(*) AS n FROM p GROUP BY p_brand)), t AS (SELECT count(*)*(count(*)-1)/2 AS t FROM p) SELECT round((t+2*c-x-y)/t,6) AS rand, round((c-x*y/t)/((x+y)/2-x*y/t),6) AS adjusted FROM c, x, y, t",
}
#: The first names of these queries, which read whole tables too.
for _name in ("chain_rhat", "chain_autocorrelation", "chain_effective_size", "credible_interval", "graph_degrees", "graph_transition"):
    QUERIES[_name] = QUERIES[f"{_name}_all"]
    if f"{_name}_all" in ORACLES:
        ORACLES[_name] = ORACLES[f"{_name}_all"]
