"""Neighbours, clusters, itemsets and PageRank."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenstat.operators import baskets, cluster, graph
from lumenstat.plans.common import rounded, table

START = [[10.0, 1400.0], [40.0, 1400.0]]


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def class_centroids(spark, d):
    return rounded(cluster.centroids(_vectors(spark, d), "label", "v"), 6).select("label", F.col("i").cast("long").alias("i"), "mean", "var", "n")


def knn_vote(spark, d):
    """Share of the five nearest neighbours that bear the query's own label, for ids divisible by 50."""
    v = _vectors(spark, d)
    near = cluster.neighbours(v.filter("vec_id % 50 = 0").select("vec_id", "v"), v, 5, "vec_id", "v")
    own = v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    return near.join(own, "query_id").groupBy("query_id").agg(F.round(F.avg(F.when(F.col("label") == F.col("own"), 1.0).otherwise(0.0)), 6).alias("own_share"), F.round(F.avg("dist"), 6).alias("mean_dist"))


def kmeans_step(spark, d):
    df = table(spark, d, "part").select(F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    centres, _ = cluster.kmeans(df, ["a", "b"], START, 1)
    return rounded(spark.createDataFrame([(i, *c) for i, c in enumerate(centres)], "cluster int, a double, b double"), 4)


def _baskets(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_type")
    return table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("txn"), F.col("p_type").alias("item")).distinct()


def itemsets(spark, d):
    return rounded(baskets.supports(_baskets(spark, d), 3, 0.1))


def rules(spark, d):
    return rounded(baskets.pair_rules(_baskets(spark, d), 0.1))


def graph_all(spark, d):
    """nodes (id), edges (src, dst): every part and supplier is a node (2 part key, 2 supplier key + 1), every lineitem links its part to its supplier."""
    items = table(spark, d, "lineitem").select((2 * F.col("l_partkey")).alias("src"), (2 * F.col("l_suppkey") + 1).alias("dst")).dropna().distinct()
    nodes = table(spark, d, "part").select((2 * F.col("p_partkey")).alias("id")).union(table(spark, d, "supplier").select(2 * F.col("s_suppkey") + 1))
    return nodes.union(items.select("src")).union(items.select("dst")).distinct(), items


def pagerank_parts(spark, d):
    """Two steps from even ranks over the whole graph."""
    return rounded(graph.pagerank(*graph_all(spark, d), 2), 8)


def pagerank_all(spark, d):
    """Of the whole graph, to an L1 change below 1e-12, 10,000 steps at most."""
    return rounded(graph.pagerank(*graph_all(spark, d), 10_000, tol=1e-12), 12)


_B = "WITH b AS (SELECT DISTINCT l_orderkey AS txn, p_type AS item FROM lineitem JOIN part ON l_partkey = p_partkey), t AS (SELECT count(DISTINCT txn) AS t FROM b), s AS (SELECT item, count(*) AS n FROM b GROUP BY 1)"
_V = "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_STEP = "{to} AS (SELECT id, raw / sum(raw) OVER () AS r FROM (SELECT n.id, 0.15/(SELECT count(*) FROM n) + 0.85*(coalesce(g.got,0) + (SELECT coalesce(sum(r),0) FROM {fr} WHERE id NOT IN (SELECT src FROM dg))/(SELECT count(*) FROM n)) AS raw FROM n LEFT JOIN (SELECT dst, sum(r/deg) AS got FROM e JOIN dg USING (src) JOIN {fr} ON {fr}.id = e.src GROUP BY dst) g ON g.dst = n.id))"
QUERIES = {f.__name__: f for f in (class_centroids, knn_vote, kmeans_step, itemsets, rules, pagerank_parts, pagerank_all)}
ORACLES = {
    "class_centroids": _V + ", u AS (SELECT label, unnest(v) AS x, generate_subscripts(v,1)-1 AS i FROM v) SELECT label, i::BIGINT AS i, round(avg(x),6) AS mean, round(var_samp(x),6) AS var, count(*) AS n FROM u GROUP BY ALL",
    "knn_vote": _V + ", p AS (SELECT q.vec_id AS query_id, q.label AS own, v.label, list_distance(q.v, v.v) AS dist, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, v.v), v.vec_id) AS rk FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id) SELECT query_id, round(avg(CASE WHEN label = own THEN 1.0 ELSE 0.0 END)::DOUBLE,6) AS own_share, round(avg(dist),6) AS mean_dist FROM p WHERE rk <= 5 GROUP BY 1",
    "kmeans_step": "SELECT CASE WHEN power(p_size-10,2)+power(p_retailprice-1400,2) <= power(p_size-40,2)+power(p_retailprice-1400,2) THEN 0 ELSE 1 END::INT AS cluster, round(avg(p_size),4) AS a, round(avg(p_retailprice),4) AS b FROM part GROUP BY 1",
    "itemsets": _B + """, p AS (SELECT a.item AS x, b.item AS y, NULL AS z, count(*) AS n FROM b a JOIN b USING (txn) WHERE a.item < b.item GROUP BY 1, 2),
      q AS (SELECT a.item AS x, b.item AS y, c.item AS z, count(*) AS n FROM b a JOIN b USING (txn) JOIN b c USING (txn) WHERE a.item < b.item AND b.item < c.item GROUP BY 1, 2, 3),
      r AS (SELECT item AS itemset, 1 AS size, n FROM s UNION ALL SELECT x||','||y, 2, n FROM p UNION ALL SELECT x||','||y||','||z, 3, n FROM q)
      SELECT itemset, size, n, round(n/t,6) AS support FROM r, t WHERE n >= 0.1*t""",
    "rules": _B + """, p AS (SELECT a.item AS lhs, c.item AS rhs, count(*) AS n FROM b a JOIN b c USING (txn) WHERE a.item <> c.item GROUP BY 1, 2),
      m AS (SELECT lhs, rhs, p.n::DOUBLE AS n, l.n::DOUBLE AS nl, r.n::DOUBLE AS nr, t::DOUBLE AS t FROM p JOIN s l ON l.item = lhs JOIN s r ON r.item = rhs, t WHERE p.n >= 0.1*t)
      SELECT lhs, rhs, round(n/t,6) AS support, round(n/nl,6) AS confidence, round(n/nl/(nr/t),6) AS lift, round(n/t-nl/t*nr/t,6) AS leverage, round(CASE WHEN n = nl THEN 'inf'::DOUBLE ELSE (1-nr/t)/(1-n/nl) END,6) AS conviction,
      round(n/(nl+nr-n),6) AS jaccard, round(n/sqrt(nl*nr),6) AS cosine, round((n/nl+n/nr)/2,6) AS kulczynski FROM m""",
    "pagerank_parts": "WITH e AS (SELECT DISTINCT 2*l_partkey AS src, 2*l_suppkey+1 AS dst FROM lineitem WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL), dg AS (SELECT src, count(*) AS deg FROM e GROUP BY 1), n AS (SELECT 2*p_partkey AS id FROM part UNION SELECT 2*s_suppkey+1 FROM supplier UNION SELECT src FROM e UNION SELECT dst FROM e), r0 AS (SELECT id, 1.0::DOUBLE/(SELECT count(*) FROM n) AS r FROM n), "
    + _STEP.format(fr="r0", to="r1") + ", " + _STEP.format(fr="r1", to="r2") + " SELECT id, round(r,8) AS rank FROM r2",
}
