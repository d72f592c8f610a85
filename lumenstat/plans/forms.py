"""Wavelet levels, local fits with structured distance, variables of a given tree, energies of a two-layer net of units."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lumenstat.operators import ensembles, local, signals
from lumenstat.operators.trees import Tree
from lumenstat.plans.common import rounded, table

LEVELS = 3
GRID = [5.0, 15.0, 25.0, 35.0, 45.0]
TREE = {1: ("x", 25.0), 2: ("z", 0.04), 3: ("x", 40.0)}
W, A, B = np.array([[0.5, -1.0], [1.5, 0.25], [-0.75, 1.0]]), np.array([0.2, -0.4, 0.1]), np.array([-0.3, 0.6])


def _series(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("place"), F.col("s_acctbal").cast("double").alias("value"))


def haar_levels(spark, d):
    t = signals.haar_levels(_series(spark, d), "place", "value", LEVELS)
    return rounded(t.select(F.col("level").cast("long").alias("level"), "k", "detail"), 4)


def haar_denoised(spark, d):
    t = signals.thresholded(signals.haar_levels(_series(spark, d), "place", "value", 2), 1500.0, soft=True, of=[1])
    return rounded(signals.haar_rebuilt(t, 2), 4)


def haar_nonzero(spark, d):
    t = signals.thresholded(signals.haar_levels(_series(spark, d), "place", "value", LEVELS), 3000.0, soft=False)
    return signals.nonzero_details(signals.without_fine_levels(t, 1)).select(F.col("level").cast("long").alias("level"), "nonzero", "n")


def local_fit(spark, d):
    df = table(spark, d, "part").select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").cast("double").alias("y"))
    rows = local.local_polynomial(df, ["x"], "y", [[g] for g in GRID], 9.0, 1, "tricube", ridge=0.0)
    return rounded(spark.createDataFrame([(GRID[i], f, w) for i, f, w in rows], "point double, fit double, weight double"), 4)


def structured_distances(spark, d):
    x = [F.col("p_size") / 10.0, F.col("p_retailprice").cast("double") / 500]
    dist = local.structured_distance(x, [F.lit(2.0), F.lit(3.0)], np.array([[2.0, 0.5], [0.5, 1.0]]))
    return table(spark, d, "part").select("p_partkey", F.round(dist, 6).alias("distance"))


def split_importance(spark, d):
    df = table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), F.col("l_discount").cast("double").alias("z"), (F.col("l_extendedprice") / 1000).cast("double").alias("y"))
    got = ensembles.importance(df, [Tree(dict(TREE))], ["x", "z"], "y")
    n = df.count()
    return rounded(spark.createDataFrame([(k, v / n) for k, v in got.items()], "term string, fall double"))


def unit_energies(spark, d):
    v = [F.when(F.col("p_size") % k == 0, 1.0).otherwise(0.0) for k in (2, 3, 5)]
    h = [F.when(F.col("p_partkey") % k == 0, 1.0).otherwise(0.0) for k in (2, 3)]
    return rounded(table(spark, d, "part").select("p_partkey", local.boltzmann_energy(v, h, W, A, B).alias("energy"), local.boltzmann_free_energy(v, W, A, B).alias("free_energy")))


QUERIES = {f.__name__: f for f in (haar_levels, haar_denoised, haar_nonzero, local_fit, structured_distances, split_importance, unit_energies)}

_S = "s AS (SELECT CAST(s_suppkey AS BIGINT) AS i, CAST(s_acctbal AS DOUBLE) AS v FROM supplier)"
_DETAILS = f"""WITH {_S}, w AS (SELECT level, i // (1::BIGINT << level) AS k, sum(CASE WHEN (i // (1::BIGINT << (level - 1))) % 2 = 0 THEN v ELSE -v END) / sqrt((1::BIGINT << level)::DOUBLE) AS d FROM s, range(1, {LEVELS + 1}) t(level) GROUP BY 1, 2)"""
_BITS = "b AS (SELECT p_partkey, " + ", ".join(f"CASE WHEN p_size % {k} = 0 THEN 1.0::DOUBLE ELSE 0 END AS v{i}" for i, k in enumerate((2, 3, 5))) + ", " + ", ".join(f"CASE WHEN p_partkey % {k} = 0 THEN 1.0::DOUBLE ELSE 0 END AS h{i}" for i, k in enumerate((2, 3))) + " FROM part)"
_ENERGY = "-(" + " + ".join([f"({A[i]}::DOUBLE) * v{i}" for i in range(3)] + [f"({B[j]}::DOUBLE) * h{j}" for j in range(2)] + [f"({W[i, j]}::DOUBLE) * v{i} * h{j}" for i in range(3) for j in range(2)]) + ")"
_FREE = "-(" + " + ".join(f"({A[i]}::DOUBLE) * v{i}" for i in range(3)) + ")" + "".join(f" - ln(1 + exp({B[j]}::DOUBLE + " + " + ".join(f"({W[i, j]}::DOUBLE) * v{i}" for i in range(3)) + "))" for j in range(2))

ORACLES = {
    "haar_levels": _DETAILS + f""" SELECT level, k, round(d, 4) AS detail FROM w UNION ALL SELECT 0, i // {1 << LEVELS}, round(sum(v) / sqrt({1 << LEVELS}::DOUBLE), 4) FROM s GROUP BY 2""",
    "haar_denoised": f"""WITH {_S}, a AS (SELECT i // 2 AS k, sum(v) / 2 AS m, sum(CASE WHEN i % 2 = 0 THEN v ELSE -v END) / sqrt(2.0::DOUBLE) AS d FROM s GROUP BY 1)
      SELECT i AS place, round(m + CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END * sign(d) * greatest(abs(d) - 1500, 0) / sqrt(2.0::DOUBLE), 4) AS value FROM s JOIN a ON k = i // 2""",
    "haar_nonzero": _DETAILS + " SELECT level, count(*) FILTER (level > 1 AND abs(d) > 3000) AS nonzero, count(*) AS n FROM w GROUP BY 1",
    "local_fit": f"""WITH g AS (SELECT unnest([{", ".join(map(str, GRID))}])::DOUBLE AS point), r AS (SELECT point, p_size - point AS x, CAST(p_retailprice AS DOUBLE) AS y, (1 - (abs(p_size - point) / 9) ** 3) ** 3 AS w FROM part, g WHERE abs(p_size - point) < 9),
      m AS (SELECT point, sum(w) AS w, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * x * x) / sum(w) AS xx, sum(w * x * y) / sum(w) AS xy FROM r GROUP BY 1)
      SELECT point, round(my - (xy - mx * my) / (xx - mx * mx) * mx, 4) AS fit, round(w, 4) AS weight FROM m""",
    "structured_distances": "WITH d AS (SELECT p_partkey, p_size / 10 - 2 AS a, CAST(p_retailprice AS DOUBLE) / 500 - 3 AS b FROM part) SELECT p_partkey, round(sqrt(2 * a * a + a * b + b * b), 6) AS distance FROM d",
    "split_importance": """WITH r AS (SELECT l_quantity AS x, CASE WHEN l_quantity <= 25 THEN CASE WHEN l_discount <= 0.04 THEN 4 ELSE 5 END ELSE CASE WHEN l_quantity <= 40 THEN 6 ELSE 7 END END AS leaf, CAST(l_extendedprice / 1000 AS DOUBLE) AS y FROM lineitem),
      c AS (SELECT leaf, count(*)::DOUBLE AS n, sum(y) AS s FROM r GROUP BY 1), q AS (SELECT s * s / n AS q, * FROM c), u AS (SELECT leaf // 2 AS up, sum(n) AS n, sum(s) AS s, sum(s) ** 2 / sum(n) AS q, sum(q) AS below FROM q GROUP BY 1), t AS (SELECT sum(n) AS n, sum(s) ** 2 / sum(n) AS q, sum(q) AS below FROM u)
      SELECT 'x' AS term, round((t.below - t.q + u.below - u.q) / t.n, 6) AS fall FROM t, u WHERE up = 3 UNION ALL SELECT 'z', round((u.below - u.q) / t.n, 6) FROM t, u WHERE up = 2""",
    "unit_energies": f"WITH {_BITS} SELECT p_partkey, round({_ENERGY}, 6) AS energy, round({_FREE}, 6) AS free_energy FROM b",
}
