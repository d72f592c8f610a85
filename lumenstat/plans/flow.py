"""Generated tables, time windows and penalised splines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenstat.operators.smooth import AdditiveSplines
from lumenstat.plans.common import rounded, table
from lumenstat.sources import scans
from lumenstat.streaming.windows import window_moments


def event_windows(spark, d):
    return rounded(window_moments(table(spark, d, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd")), 6)


def grid_source(spark, d):
    return scans.grid(spark, a=[0, 0.5, 1], b=[1, 2], c=[-1, 0, 1, 2])


def bit_vectors(spark, d):
    return scans.bit_vectors(spark, 6)


def generated_moments(spark, d):
    k = F.col("id")
    a, b = scans.multivariate_normal(k, [1.0, -1.0], [[2.0, 0.5], [0.5, 1.0]], 7)
    df = spark.range(20000).select(a.alias("a"), b.alias("b"), scans.exponential(k, 2.0, 8).alias("e"), scans.gamma(k, 3, 1.0, 9).alias("g"), scans.bernoulli(k, 0.3, 10).alias("z"))
    return rounded(df.agg(F.avg("a").alias("a"), F.avg("b").alias("b"), F.covar_samp("a", "b").alias("ab"), F.avg("e").alias("e"), F.avg("g").alias("g"), F.avg("z").alias("z")))


def spline_gcv(spark, d):
    """Error by penalty of a one-variable spline."""
    df = table(spark, d, "part").select("p_size", ((F.col("p_size") - 20) * (F.col("p_size") - 20) / 100.0 + F.col("p_partkey") % 17).alias("y"))
    fits = [(lam, AdditiveSplines(df, {"p_size": [10.0, 20.0, 30.0, 40.0]}, "y", lam)) for lam in (0.0, 100.0, 10000.0, 1e6)]
    return rounded(spark.createDataFrame([(lam, f.df, f.rss, f.gcv) for lam, f in fits], "penalty double, df double, rss double, gcv double"), 4)


QUERIES = {f.__name__: f for f in (event_windows, grid_source, bit_vectors, generated_moments, spline_gcv)}
ORACLES = {
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS start, event_type, count(*) AS n, round(avg(value),6) AS mean, round(stddev_pop(value),6) AS sd FROM events GROUP BY 1, 2",
    "grid_source": "SELECT a::DOUBLE AS a, b::DOUBLE AS b, c::DOUBLE AS c FROM (SELECT unnest([0,0.5,1]) AS a), (SELECT unnest([1,2]) AS b), (SELECT unnest([-1,0,1,2]) AS c)",
    "bit_vectors": "SELECT range AS id, " + ", ".join(f"((range>>{k})&1)::INT AS b{k}" for k in range(6)) + " FROM range(64)",
}
