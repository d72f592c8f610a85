"""Neighbour predictions, medoids, mixtures of several variables, kernels and maps of groups, wavelet shrinkage, projections, rules between sets."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from lumenstat.operators import baskets, gaussian, graph, nearby, separate, signals, spaces
from lumenstat.plans.common import rounded, table

WEIGHTS, MEANS = [0.4, 0.6], [[1.5, 2.5], [3.5, 3.0]]
COVS = [[[1.0, 0.2], [0.2, 0.25]], [[1.5, -0.1], [-0.1, 0.2]]]
GAMMA = 0.5
DIRECTIONS = [[1.0, 0.0, 0.0], [1.0, 1.0, 0.0], [1.0, -2.0, 0.5]]


def _near(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"), F.col("label").cast("long").alias("label"))
    return nearby.nearest_rows(v.filter("vec_id % 50 = 0"), v, 5, "vec_id", "v", carry=["vec_id", "label"])


def knn_class(spark, d):
    near = _near(spark, d)
    a, b = nearby.knn_classify(near, "label").toDF("query_id", "by_votes", "vote_share"), nearby.knn_classify(near, "label", weighted=True).toDF("query_id", "by_distance", "weight_share")
    return rounded(a.join(b, "query_id"))


def knn_mean(spark, d):
    near = _near(spark, d)
    return rounded(nearby.knn_regress(near, "label").toDF("query_id", "mean").join(nearby.knn_regress(near, "label", weighted=True).toDF("query_id", "weighted_mean"), "query_id"))


def _sizes(spark, d):
    """Distinct (size, price in hundreds) by container, with how often each occurs."""
    x = F.array(F.col("p_size").cast("double"), F.floor(F.col("p_retailprice") / 100).cast("double"))
    return table(spark, d, "part").groupBy(F.pmod("p_size", F.lit(5)).cast("long").alias("label"), x.alias("v")).agg(F.count("*").alias("n"))


def medoid_of_each(spark, d):
    got = nearby.medoids(_sizes(spark, d), "label", "v", "n", "manhattan")
    return rounded(got.select("label", F.col("v")[0].alias("size"), F.col("v")[1].alias("hundreds"), "cost"), 4)


def _mixture():
    return gaussian.Mixture(["a", "b"], np.array(WEIGHTS), np.array(MEANS), np.array(COVS))


def _ab(spark, d):
    return table(spark, d, "part").select("p_partkey", (F.col("p_size") / 10).alias("a"), (F.col("p_retailprice") / 500).cast("double").alias("b"))


def gmm_criteria(spark, d):
    return rounded(_mixture().criteria(_ab(spark, d)), 4)


def gmm_clusters(spark, d):
    out = _mixture().with_clusters(_ab(spark, d))
    return rounded(out.select("p_partkey", F.col("cluster").cast("long").alias("cluster"), "confidence", "entropy", "normalised_entropy"))


def gmm_step(spark, d):
    m = _mixture()
    m.step(_ab(spark, d), least=0.0)
    rows = [(k, float(m.weights[k]), *map(float, m.means[k]), float(m.covariances[k][0, 0]), float(m.covariances[k][0, 1]), float(m.covariances[k][1, 1])) for k in range(2)]
    return rounded(spark.createDataFrame(rows, "component long, weight double, mean_a double, mean_b double, aa double, ab double, bb double"))


def _nations(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey").agg((F.avg(F.col("c_acctbal").cast("double")) / 1000).alias("x"), (F.stddev_pop(F.col("c_acctbal").cast("double")) / 1000).alias("y"))
    n = table(spark, d, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"))
    return n.select(F.col("n_nationkey").cast("long").alias("key"), F.array(F.round("x", 9), F.round("y", 9)).alias("v"), F.col("n_regionkey").cast("long").alias("label"))


def _pairs(spark, d):
    return spaces.pairs(_nations(spark, d), "key", "v", GAMMA)


def kernel_pairs(spark, d):
    return rounded(_pairs(spark, d))


def kernel_centred(spark, d):
    p = _pairs(spark, d)
    back = spaces.squared_distance_to_gram(p.select("i", "j", "sq_dist")).withColumnRenamed("sq_dist", "from_distance")
    out = spaces.centred(p.select("i", "j", "dot"), "dot").join(back, ["i", "j"]).join(spaces.gram_to_squared_distance(p.select("i", "j", "rbf"), "rbf").withColumnRenamed("sq_dist", "rbf_distance"), ["i", "j"])
    return rounded(out)


def kernel_classes(spark, d):
    return rounded(spaces.kernel_nearest_centroid(_pairs(spark, d), _nations(spark, d).select("key", "label"), "rbf").select("i", "predicted", "sq_dist"))


def _maps(spark, d):
    """Distances in the plane, and along the first coordinate alone."""
    n = _nations(spark, d)
    line = n.select("key", F.array(F.col("v")[0]).alias("v"))
    a, b = spaces.pairs(n, "key", "v").select("i", "j", F.sqrt("sq_dist").alias("full")), spaces.pairs(line, "key", "v").select("i", "j", F.col("manhattan").alias("line"))
    return a.join(b, ["i", "j"])


def map_stress(spark, d):
    return rounded(spaces.stress(_maps(spark, d), "full", "line"))


def map_neighbourhoods(spark, d):
    return rounded(spaces.neighbourhood_kept(_maps(spark, d), "full", "line", 5))


def neighbour_graph(spark, d):
    return spaces.knn_graph(_maps(spark, d), "full", 3)


def graph_laplacians(spark, d):
    return rounded(spaces.laplacian(_pairs(spark, d).select("i", "j", "rbf"), "rbf"))


def cut_between_regions(spark, d):
    return rounded(spaces.normalised_cut(_pairs(spark, d).select("i", "j", "rbf"), "rbf", _nations(spark, d).select("key", "label")))


def _series(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("place"), F.col("s_acctbal").cast("double").alias("value"))


def haar_shrunk(spark, d):
    level = signals.haar_pairs(_series(spark, d), "place", "value")
    t = signals.universal_threshold(signals.noise_level(level), _series(spark, d).count()) / 4
    soft, hard = (signals.haar_inverse(signals.shrunk(level, t, s)).withColumnRenamed("value", n) for s, n in ((True, "soft"), (False, "hard")))
    return rounded(soft.join(hard, "place"), 4)


def haar_round_trip(spark, d):
    """Inverse after forward: the series itself."""
    return rounded(signals.haar_inverse(signals.haar_pairs(_series(spark, d), "place", "value")), 4)


def projection_indices(spark, d):
    df = table(spark, d, "lineitem").select((F.col("l_quantity") / 15).cast("double").alias("a"), (F.col("l_extendedprice") / 20000).cast("double").alias("b"), (F.col("l_discount") * 30).cast("double").alias("c"))
    return rounded(signals.projection_indices(df, ["a", "b", "c"], DIRECTIONS), 5)


def activations(spark, d):
    z = (F.col("p_size") - 25) / 4.0
    cols = [c for n, (f, g) in signals.ACTIVATIONS.items() for c in (f(z).alias(n), g(z).alias(f"{n}_slope"))]
    return rounded(table(spark, d, "part").select("p_partkey", *cols, signals.log_cosh(z).alias("log_cosh")), 8)


def normal_posterior(spark, d):
    return rounded(signals.normal_posterior(table(spark, d, "part").select(F.col("p_retailprice").cast("double").alias("x")), "x", 1000.0, 400.0, 250_000.0))


def class_scatter(spark, d):
    df = table(spark, d, "lineitem").select((F.col("l_quantity") / 10).cast("double").alias("a"), (F.col("l_discount") * 10).cast("double").alias("b"), "l_returnflag")
    _, _, n, within, between = separate.class_scatter(df, ["a", "b"], "l_returnflag")
    total = float(n.sum())
    rows = [(name, float(m[0, 0]) / total, float(m[0, 1]) / total, float(m[1, 1]) / total) for name, m in (("within", within), ("between", between))]
    return rounded(spark.createDataFrame(rows, "part string, aa double, ab double, bb double"), 8)


def fisher_direction(spark, d):
    df = table(spark, d, "orders").select(F.col("o_totalprice").cast("double").alias("y"), (F.col("o_totalprice") / 100_000).cast("double").alias("a"), F.pmod("o_custkey", F.lit(100)).cast("double").alias("b"), F.when(F.col("o_orderstatus") == "F", "F").otherwise("O").alias("s"))
    _, _, n, within, between = separate.class_scatter(df, ["a", "b"], "s")
    values, a = separate.fisher_directions(within, between)
    size = np.abs(a[:, 0]).max()
    return rounded(spark.createDataFrame([(float(values[0]), float(a[0, 0] / size), float(a[1, 0] / size))], "ratio double, a double, b double"), 8)


def screened_columns(spark, d):
    df = table(spark, d, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice")])
    return rounded(separate.screened(df, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"))


def _baskets(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_type")
    return table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("txn"), F.col("p_type").alias("item")).distinct()


def rules_between_sets(spark, d):
    return rounded(baskets.with_improvement(baskets.set_rules(baskets.supports(_baskets(spark, d), 3, 0.05), 0.3)))


def rules_on_new_baskets(spark, d):
    items = _baskets(spark, d)
    learned = baskets.set_rules(baskets.supports(items.filter("txn % 2 = 0"), 2, 0.1), 0.3)
    return rounded(baskets.evaluated(learned.select("lhs", "rhs"), items.filter("txn % 2 = 1")))


def _trade(spark, d):
    """Nations as nodes; an edge from a customer's nation to each nation whose suppliers it has bought from."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").cast("long").alias("src"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("dst"))
    edges = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("src", "dst").distinct()
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id")), edges


def google_matrix(spark, d):
    return rounded(graph.google_matrix(*_trade(spark, d)), 8)


def rank_contributions(spark, d):
    nodes, edges = _trade(spark, d)
    return rounded(graph.contributions(edges, nodes.withColumn("rank", F.lit(1.0) / 25)), 8)


QUERIES = {f.__name__: f for f in (
    knn_class, knn_mean, medoid_of_each, gmm_criteria, gmm_clusters, gmm_step, kernel_pairs, kernel_centred, kernel_classes, map_stress, map_neighbourhoods, neighbour_graph, graph_laplacians, cut_between_regions,
    haar_shrunk, haar_round_trip, projection_indices, activations, normal_posterior, class_scatter, fisher_direction, screened_columns, rules_between_sets, rules_on_new_baskets, google_matrix, rank_contributions)}

_NEAR = """WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(e.label AS BIGINT) AS label, sqrt(list_sum(list_transform(list_zip(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS dist
  FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id),
 n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) <= 5)"""


def _log_density(k: int) -> str:
    (p, q), (_, r) = COVS[k]
    det = p * r - q * q
    a, b = f"(a - {MEANS[k][0]})", f"(b - {MEANS[k][1]})"
    return f"(-0.5 * ({r / det!r} * {a} * {a} - {2 * q / det!r} * {a} * {b} + {p / det!r} * {b} * {b}) - {0.5 * math.log(det) + math.log(2 * math.pi)!r} + {math.log(WEIGHTS[k])!r})"


_MIX = f"""WITH x AS (SELECT p_partkey, p_size / 10 AS a, CAST(p_retailprice AS DOUBLE) / 500 AS b FROM part), g AS (SELECT *, {_log_density(0)} AS l0, {_log_density(1)} AS l1 FROM x),
 r AS (SELECT *, greatest(l0, l1) + ln(exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))) AS ll FROM g), s AS (SELECT *, exp(l0 - ll) AS r0, exp(l1 - ll) AS r1 FROM r)"""
_NATIONS = """WITH c AS (SELECT c_nationkey, avg(CAST(c_acctbal AS DOUBLE)) / 1000 AS x, stddev_pop(CAST(c_acctbal AS DOUBLE)) / 1000 AS y FROM customer GROUP BY 1),
 v AS (SELECT CAST(n_nationkey AS BIGINT) AS key, round(x, 9) AS x, round(y, 9) AS y, CAST(n_regionkey AS BIGINT) AS label FROM nation JOIN c ON n_nationkey = c_nationkey)"""
_PAIRS = _NATIONS + f""", p AS (SELECT a.key AS i, b.key AS j, a.label AS li, b.label AS lj, a.x * b.x + a.y * b.y AS dot, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS sq_dist, abs(a.x - b.x) + abs(a.y - b.y) AS manhattan, abs(a.x - b.x) AS line,
  (a.x * b.x + a.y * b.y + 1) ** 2 AS poly, exp(-{GAMMA} * ((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS rbf FROM v a, v b)"""
_RANKS = _PAIRS + """, k AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY round(sqrt(sq_dist), 9), j) AS ra, row_number() OVER (PARTITION BY i ORDER BY round(line, 9), j) AS rb FROM p WHERE i <> j)"""
_HAAR = """WITH s AS (SELECT CAST(s_suppkey AS BIGINT) AS place, CAST(s_acctbal AS DOUBLE) AS v FROM supplier),
 l AS (SELECT place // 2 AS k, (sum(v)) / sqrt(2) AS m, sum(CASE WHEN place % 2 = 0 THEN v ELSE -v END) / sqrt(2) AS d FROM s GROUP BY 1),
 t AS (SELECT median(abs(d)) / 0.6745 * sqrt(2 * ln((SELECT count(*) FROM s))) / 4 AS t FROM l)"""
_SETS = """b AS (SELECT DISTINCT l_orderkey AS txn, p_type AS item FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {where}), n AS (SELECT count(DISTINCT txn)::DOUBLE AS total FROM b),
 f1 AS (SELECT [item] AS s, count(*) AS n FROM b, n GROUP BY item, total HAVING count(*) >= {least} * total),
 f2 AS (SELECT [x.item, y.item] AS s, count(*) AS n FROM b x JOIN b y ON x.txn = y.txn AND x.item < y.item, n GROUP BY x.item, y.item, total HAVING count(*) >= {least} * total),
 f3 AS (SELECT [x.item, y.item, z.item] AS s, count(*) AS n FROM b x JOIN b y ON x.txn = y.txn AND x.item < y.item JOIN b z ON x.txn = z.txn AND y.item < z.item, n GROUP BY x.item, y.item, z.item, total HAVING count(*) >= {least} * total),
 f AS (SELECT * FROM f1 UNION ALL SELECT * FROM f2 {three})"""
_RULES = """ru AS (SELECT l.s AS l, list_filter(w.s, lambda x: NOT list_contains(l.s, x)) AS r, w.n, l.n AS nl FROM f w JOIN f l ON len(l.s) < len(w.s) AND list_has_all(w.s, l.s)),
 rr AS (SELECT l, r, ru.n, ru.n / total AS support, ru.n / ru.nl AS confidence, ru.n / ru.nl / (f.n / total) AS lift, ru.n / total - ru.nl / total * (f.n / total) AS leverage, CASE WHEN ru.n = ru.nl THEN 'Infinity'::DOUBLE ELSE (1 - f.n / total) / (1 - ru.n / ru.nl) END AS conviction
  FROM ru JOIN f ON f.s = ru.r, n WHERE ru.n / ru.nl >= 0.3)"""
_TRADE = """WITH e AS (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
 g AS (SELECT src, count(*) AS deg FROM e GROUP BY 1)"""
_ACT = "z AS (SELECT p_partkey, (p_size - 25) / 4.0::DOUBLE AS z FROM part)"

ORACLES = {
    "knn_class": _NEAR + """, v AS (SELECT query_id, label, count(*)::DOUBLE AS c, sum(1 / (dist + 1e-8)) AS w FROM n GROUP BY 1, 2),
      a AS (SELECT query_id, label AS by_votes, c / sum(c) OVER (PARTITION BY query_id) AS vote_share FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, label) = 1),
      b AS (SELECT query_id, label AS by_distance, w / sum(w) OVER (PARTITION BY query_id) AS weight_share FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(w, 9) DESC, label) = 1)
      SELECT query_id, by_votes, round(vote_share, 6) AS vote_share, by_distance, round(weight_share, 6) AS weight_share FROM a JOIN b USING (query_id)""",
    "knn_mean": _NEAR + " SELECT query_id, round(avg(label), 6) AS mean, round(sum(label / (dist + 1e-8)) / sum(1 / (dist + 1e-8)), 6) AS weighted_mean FROM n GROUP BY 1",
    "medoid_of_each": """WITH s AS (SELECT CAST(p_size % 5 AS BIGINT) AS label, CAST(p_size AS DOUBLE) AS a, floor(CAST(p_retailprice AS DOUBLE) / 100) AS b, count(*) AS n FROM part GROUP BY 1, 2, 3),
      c AS (SELECT x.label, x.a, x.b, sum(y.n * (abs(x.a - y.a) + abs(x.b - y.b))) AS cost FROM s x JOIN s y ON x.label = y.label GROUP BY 1, 2, 3)
      SELECT label, a AS size, b AS hundreds, round(cost, 4) AS cost FROM c QUALIFY row_number() OVER (PARTITION BY label ORDER BY cost, a, b) = 1""",
    "gmm_criteria": _MIX + " SELECT count(*) AS n, round(sum(ll), 4) AS log_likelihood, 11::BIGINT AS parameters, round(-2 * sum(ll) + 22, 4) AS aic, round(-2 * sum(ll) + 11 * ln(count(*)), 4) AS bic FROM s",
    "gmm_clusters": _MIX + """ SELECT p_partkey, CASE WHEN r0 >= r1 THEN 0::BIGINT ELSE 1 END AS cluster, round(greatest(r0, r1), 6) AS confidence,
      round(-(CASE WHEN r0 > 0 THEN r0 * ln(r0) ELSE 0 END + CASE WHEN r1 > 0 THEN r1 * ln(r1) ELSE 0 END), 6) AS entropy, round(-(CASE WHEN r0 > 0 THEN r0 * ln(r0) ELSE 0 END + CASE WHEN r1 > 0 THEN r1 * ln(r1) ELSE 0 END) / ln(2), 6) AS normalised_entropy FROM s""",
    "gmm_step": _MIX + ", u AS (SELECT 0::BIGINT AS component, r0 AS r, a, b FROM s UNION ALL SELECT 1, r1, a, b FROM s), m AS (SELECT component, sum(r) AS w, sum(r * a) / sum(r) AS ma, sum(r * b) / sum(r) AS mb FROM u GROUP BY 1)"
      " SELECT component, round(max(w) / (SELECT count(*) FROM s), 6) AS weight, round(max(ma), 6) AS mean_a, round(max(mb), 6) AS mean_b, round(sum(r * (a - ma) ** 2) / max(w), 6) AS aa, round(sum(r * (a - ma) * (b - mb)) / max(w), 6) AS ab, round(sum(r * (b - mb) ** 2) / max(w), 6) AS bb FROM u JOIN m USING (component) GROUP BY 1",
    "kernel_pairs": _PAIRS + " SELECT i, j, round(dot, 6) AS dot, round(sq_dist, 6) AS sq_dist, round(manhattan, 6) AS manhattan, round(poly, 6) AS poly, round(rbf, 6) AS rbf FROM p",
    "kernel_centred": _PAIRS + """, m AS (SELECT avg(x) AS mx, avg(y) AS my FROM v), z AS (SELECT key, x - mx AS x, y - my AS y FROM v, m)
      SELECT p.i, p.j, round(a.x * b.x + a.y * b.y, 6) AS dot, round(a.x * b.x + a.y * b.y, 6) AS from_distance, round(2 - 2 * rbf, 6) AS rbf_distance FROM p JOIN z a ON p.i = a.key JOIN z b ON p.j = b.key""",
    "kernel_classes": _PAIRS + """, t AS (SELECT i, lj AS label, avg(rbf) AS m FROM p GROUP BY 1, 2), cs AS (SELECT lj AS label, avg(rbf) AS cc FROM p WHERE li = lj GROUP BY 1), d AS (SELECT i, label, 1 - 2 * m + cc AS d FROM t JOIN cs USING (label))
      SELECT i, label AS predicted, round(d, 6) AS sq_dist FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY round(d, 9), label) = 1""",
    "map_stress": _PAIRS + " SELECT round(sum((sqrt(sq_dist) - line) ** 2), 6) AS raw, round(sqrt(sum((sqrt(sq_dist) - line) ** 2) / sum(sq_dist)), 6) AS normalised, round(corr(sqrt(sq_dist), line), 6) AS correlation FROM p WHERE i < j",
    "map_neighbourhoods": _RANKS + """, ks AS (SELECT count(DISTINCT i)::DOUBLE AS n, count(*) FILTER (ra <= 5 AND rb <= 5) AS o, coalesce(sum(ra - 5) FILTER (rb <= 5 AND ra > 5), 0) AS x, coalesce(sum(rb - 5) FILTER (ra <= 5 AND rb > 5), 0) AS y FROM k)
      SELECT round(o / (n * 5), 6) AS overlap, round(1 - 2 / (n * 5 * (2 * n - 16)) * x, 6) AS trustworthiness, round(1 - 2 / (n * 5 * (2 * n - 16)) * y, 6) AS continuity FROM ks""",
    "neighbour_graph": _RANKS + " SELECT i, j FROM k WHERE ra <= 3 UNION SELECT j, i FROM k WHERE ra <= 3",
    "graph_laplacians": _PAIRS + """, w AS (SELECT i, j, CASE WHEN i = j THEN 0 ELSE rbf END AS w FROM p), g AS (SELECT i AS key, sum(w) AS d FROM w GROUP BY 1)
      SELECT w.i, w.j, round(CASE WHEN w.i = w.j THEN a.d ELSE 0 END - w, 6) AS plain, round(CASE WHEN w.i = w.j THEN 1 ELSE 0 END - w / a.d, 6) AS walk, round(CASE WHEN w.i = w.j THEN 1 ELSE 0 END - w / sqrt(a.d * b.d), 6) AS symmetric FROM w JOIN g a ON w.i = a.key JOIN g b ON w.j = b.key""",
    "cut_between_regions": _PAIRS + ", ct AS (SELECT li, sum(rbf) FILTER (li <> lj) AS c, sum(rbf) AS v FROM p WHERE i <> j GROUP BY 1) SELECT round(sum(c) / 2, 6) AS cut, round(sum(c / v), 6) AS normalised FROM ct",
    "haar_shrunk": _HAAR + """, z AS (SELECT k, m, sign(d) * greatest(abs(d) - t, 0) AS s, CASE WHEN abs(d) > t THEN d ELSE 0 END AS h FROM l, t)
      SELECT place, round((m + CASE WHEN place % 2 = 0 THEN s ELSE -s END) / sqrt(2), 4) AS soft, round((m + CASE WHEN place % 2 = 0 THEN h ELSE -h END) / sqrt(2), 4) AS hard FROM s s0 JOIN z ON place // 2 = k""",
    "haar_round_trip": "SELECT CAST(s_suppkey AS BIGINT) AS place, round(CAST(s_acctbal AS DOUBLE), 4) AS value FROM supplier",
    "projection_indices": "WITH x AS (SELECT CAST(l_quantity / 15 AS DOUBLE) AS a, CAST(l_extendedprice / 20000 AS DOUBLE) AS b, CAST(l_discount * 30 AS DOUBLE) AS c FROM lineitem), p AS ("
      + " UNION ALL ".join(f"SELECT {i}::BIGINT AS direction, ({d[0]} * a + {d[1]} * b + {d[2]} * c) / sqrt({sum(v * v for v in d)}::DOUBLE) AS v FROM x" for i, d in enumerate(DIRECTIONS))
      + """), m AS (SELECT direction, avg(v) AS m, stddev_pop(v) AS s FROM p GROUP BY 1), z AS (SELECT direction, (v - m) / s AS z FROM p JOIN m USING (direction))
      SELECT direction, round(avg(z ** 3), 5) AS skewness, round(avg(z ** 4) - 3, 5) AS kurtosis, round((avg(ln((exp(z) + exp(-z)) / 2)) - 0.3745672075) ** 2, 5) AS negentropy, round(avg(CASE WHEN abs(z) > 2 THEN 1.0 ELSE 0.0 END)::DOUBLE, 5) AS tails FROM z GROUP BY 1""",
    "activations": f"""WITH {_ACT}, e AS (SELECT *, 1 / (1 + exp(-z)) AS g, (exp(z) - exp(-z)) / (exp(z) + exp(-z)) AS h FROM z)
      SELECT p_partkey, round(h, 8) AS tanh, round(1 - h * h, 8) AS tanh_slope, round(greatest(z, 0), 8) AS relu, CASE WHEN z > 0 THEN 1.0::DOUBLE ELSE 0 END AS relu_slope, round(g, 8) AS sigmoid, round(g * (1 - g), 8) AS sigmoid_slope,
      round(ln(1 + exp(z)), 8) AS softplus, round(g, 8) AS softplus_slope, round(ln((exp(z) + exp(-z)) / 2), 8) AS log_cosh FROM e""",
    "normal_posterior": """WITH s AS (SELECT count(*) AS n, avg(CAST(p_retailprice AS DOUBLE)) AS m FROM part), p AS (SELECT *, 1 / 400.0::DOUBLE + n / 250000.0::DOUBLE AS q FROM s)
      SELECT n, round((1000 / 400.0::DOUBLE + n * m / 250000.0::DOUBLE) / q, 6) AS mean, round(1 / q, 6) AS variance, round(1 / q + 250000, 6) AS predictive_variance FROM p""",
    "class_scatter": """WITH x AS (SELECT CAST(l_quantity / 10 AS DOUBLE) AS a, CAST(l_discount * 10 AS DOUBLE) AS b, l_returnflag AS g FROM lineitem), m AS (SELECT g, count(*)::DOUBLE AS n, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS aa, covar_pop(a, b) AS ab, var_pop(b) AS bb FROM x GROUP BY 1),
      t AS (SELECT sum(n) AS n, sum(n * ma) / sum(n) AS ma, sum(n * mb) / sum(n) AS mb FROM m)
      SELECT 'within' AS part, round(sum(m.n * aa) / max(t.n), 8) AS aa, round(sum(m.n * ab) / max(t.n), 8) AS ab, round(sum(m.n * bb) / max(t.n), 8) AS bb FROM m, t
      UNION ALL SELECT 'between', round(sum(m.n * (m.ma - t.ma) ** 2) / max(t.n), 8), round(sum(m.n * (m.ma - t.ma) * (m.mb - t.mb)) / max(t.n), 8), round(sum(m.n * (m.mb - t.mb) ** 2) / max(t.n), 8) FROM m, t""",
    "fisher_direction": """WITH x AS (SELECT CAST(o_totalprice / 100000 AS DOUBLE) AS a, CAST(o_custkey % 100 AS DOUBLE) AS b, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'O' END AS g FROM orders),
      m AS (SELECT g, count(*)::DOUBLE AS n, avg(a) AS ma, avg(b) AS mb, var_pop(a) * count(*) AS aa, covar_pop(a, b) * count(*) AS ab, var_pop(b) * count(*) AS bb FROM x GROUP BY 1),
      w AS (SELECT sum(aa) AS aa, sum(ab) AS ab, sum(bb) AS bb, max(ma) FILTER (g = 'F') - max(ma) FILTER (g = 'O') AS da, max(mb) FILTER (g = 'F') - max(mb) FILTER (g = 'O') AS db, max(n) FILTER (g = 'F') * max(n) FILTER (g = 'O') / sum(n) AS h FROM m),
      r AS (SELECT (bb * da - ab * db) / (aa * bb - ab * ab) AS u, (aa * db - ab * da) / (aa * bb - ab * ab) AS v, da, db, h FROM w),
      s AS (SELECT *, CASE WHEN abs(u) >= abs(v) THEN u ELSE v END AS top FROM r) SELECT round(h * (u * da + v * db), 8) AS ratio, round(u / top, 8) AS a, round(v / top, 8) AS b FROM s""",
    "screened_columns": " UNION ALL ".join(f"SELECT '{c}' AS term, round(abs(corr({c}, l_extendedprice)), 6) AS score FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")),
    "rules_between_sets": "WITH " + _SETS.format(where="true", least=0.05, three="UNION ALL SELECT * FROM f3") + ", " + _RULES + """,
      best AS (SELECT a.l, a.r, max(c.confidence) AS best FROM rr a JOIN rr c ON a.r = c.r AND len(c.l) < len(a.l) AND list_has_all(a.l, c.l) GROUP BY 1, 2)
      SELECT array_to_string(rr.l, ',') AS lhs, array_to_string(rr.r, ',') AS rhs, n, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift, round(leverage, 6) AS leverage, round(conviction, 6) AS conviction, round(confidence - coalesce(best, confidence / lift), 6) AS improvement
      FROM rr LEFT JOIN best ON rr.l = best.l AND rr.r = best.r""",
    "rules_on_new_baskets": "WITH " + _SETS.format(where="l_orderkey % 2 = 0", least=0.1, three="") + ", " + _RULES + """,
      o AS (SELECT l_orderkey AS txn, list_distinct(list(p_type)) AS items FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 2 = 1 GROUP BY 1)
      SELECT array_to_string(l, ',') AS lhs, array_to_string(r, ',') AS rhs, round(count(*) FILTER (list_has_all(items, l) AND list_has_all(items, r)) / count(*), 6) AS new_support,
      round(count(*) FILTER (list_has_all(items, l) AND list_has_all(items, r)) / nullif(count(*) FILTER (list_has_all(items, l)), 0), 6) AS new_confidence FROM rr, o GROUP BY l, r""",
    "google_matrix": _TRADE + """ SELECT CAST(a.n_nationkey AS BIGINT) AS src, CAST(b.n_nationkey AS BIGINT) AS dst, round(0.85 * CASE WHEN deg IS NULL THEN 1 / 25.0::DOUBLE ELSE (CASE WHEN e.dst IS NULL THEN 0 ELSE 1 END) / deg END + 0.15 / 25.0::DOUBLE, 8) AS probability
      FROM nation a CROSS JOIN nation b LEFT JOIN g ON g.src = a.n_nationkey LEFT JOIN e ON e.src = a.n_nationkey AND e.dst = b.n_nationkey""",
    "rank_contributions": _TRADE + " SELECT e.src, e.dst, round(0.85 / 25.0::DOUBLE / deg, 8) AS sent FROM e JOIN g USING (src)",
}
