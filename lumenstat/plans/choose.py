"""Tube loss, strata, runs along a curve, dependence on a feature, silhouettes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lumenstat.operators import cluster, margin, order
from lumenstat.plans.common import rounded, table

GRID = [10.0, 20.0, 30.0, 40.0]


def _items(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").cast("double").alias("q"), F.col("l_discount").cast("double").alias("disc"), F.col("l_tax").cast("double").alias("tax"))


def svr_objective(spark, d):
    return rounded(margin.svr_objective(_items(spark, d), ["q"], "y", np.array([1.4]), 0.25, 2.0, 1.5), 2)


def stratified_folds(spark, d):
    df = order.stratified_folds(table(spark, d, "labels").select("doc_id", F.col("quality").alias("y")), "y", "doc_id", 5)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("fold").cast("long").alias("fold"))


def _monthly(spark, d):
    month = F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy-MM")
    return table(spark, d, "lineitem").groupBy(month.alias("month")).agg(F.round(F.avg(F.col("l_quantity").cast("double")), 6).alias("v"))


def curve_segments(spark, d):
    return order.segments(_monthly(spark, d), "month", "v", 1.0).select("month", "v", F.col("segment").cast("long").alias("segment"))


def curve_variation(spark, d):
    return rounded(order.total_variation(_monthly(spark, d), "month", "v"), 4)


def active_intervals(spark, d):
    return order.active_intervals(_monthly(spark, d), "month", F.col("v") > 25.5).toDF("first_month", "last_month", "n")


def partial_dependence(spark, d):
    model = F.when(F.col("q") <= 24, F.when(F.col("disc") <= 0.05, 10.0).otherwise(20.0)).otherwise(30 + F.col("tax"))
    return rounded(order.partial_dependence(_items(spark, d), "q", GRID, model))


def silhouette_means(spark, d):
    df = table(spark, d, "part").select(F.floor(F.col("p_size") / 20).cast("long").alias("cluster"), F.col("p_size").cast("double").alias("s"), (F.col("p_retailprice") / 100).cast("double").alias("r"))
    s = cluster.silhouettes(df, "cluster", ["s", "r"])
    return rounded(s.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("silhouette").alias("mean")), 5)


QUERIES = {f.__name__: f for f in (svr_objective, stratified_folds, curve_segments, curve_variation, active_intervals, partial_dependence, silhouette_means)}

_MONTHLY = "m AS (SELECT strftime(CAST(l_shipdate AS TIMESTAMP), '%Y-%m') AS month, round(avg(CAST(l_quantity AS DOUBLE)), 6) AS v FROM lineitem GROUP BY 1)"

ORACLES = {
    "svr_objective": "SELECT round(0.98 + 2.0 * sum(greatest(abs(l_extendedprice / 1000 - 1.4 * l_quantity - 0.25) - 1.5, 0.0)), 2) AS objective FROM lineitem",
    "stratified_folds": "SELECT doc_id, (row_number() OVER (PARTITION BY quality ORDER BY doc_id % 4099, doc_id) - 1) % 5 AS fold FROM labels",
    "curve_segments": f"WITH {_MONTHLY}, s AS (SELECT month, v, CASE WHEN abs(v - lag(v) OVER (ORDER BY month)) > 1.0 THEN 1 ELSE 0 END AS j FROM m) SELECT month, v, CAST(1 + sum(j) OVER (ORDER BY month) AS BIGINT) AS segment FROM s",
    "curve_variation": f"WITH {_MONTHLY}, s AS (SELECT abs(v - lag(v) OVER (ORDER BY month)) AS a FROM m) SELECT round(coalesce(sum(a), 0), 4) AS total_variation, count(*) FILTER (a > 1e-3) AS jumps FROM s",
    "active_intervals": f"WITH {_MONTHLY}, s AS (SELECT month, v > 25.5 AS a, sum(CASE WHEN v > 25.5 THEN 0 ELSE 1 END) OVER (ORDER BY month) AS k FROM m) SELECT min(month) AS first_month, max(month) AS last_month, count(*) AS n FROM s WHERE a GROUP BY k",
    "partial_dependence": "SELECT value, round(avg(CASE WHEN value <= 24 THEN CASE WHEN l_discount <= 0.05 THEN 10.0 ELSE 20.0 END ELSE 30 + l_tax END), 6) AS mean FROM lineitem, (SELECT unnest([10.0, 20.0, 30.0, 40.0])::DOUBLE AS value) GROUP BY value",
    # squared distances to a cluster from its moments: |x|^2 - 2 x.m + q
    "silhouette_means": """
        WITH p AS (SELECT CAST(floor(p_size / 20) AS BIGINT) AS cluster, CAST(p_size AS DOUBLE) AS s, CAST(p_retailprice / 100 AS DOUBLE) AS r, p_partkey AS id FROM part),
        c AS (SELECT cluster AS k, count(*) AS n, avg(s) AS ms, avg(r) AS mr, avg(s * s + r * r) AS q FROM p GROUP BY 1),
        d AS (SELECT id, cluster, k, n, (s * s + r * r - 2 * (s * ms + r * mr) + q) AS dist FROM p, c),
        e AS (SELECT id, cluster, max(CASE WHEN k = cluster AND n > 1 THEN dist * n / (n - 1) END) AS a, min(CASE WHEN k <> cluster THEN dist END) AS b FROM d GROUP BY id, cluster)
        SELECT cluster, count(*) AS n, round(avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) <= 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS mean FROM e GROUP BY cluster""",
}
