"""Discriminants, shrunken centroids, logistic regression, trees, boosting, bootstrap and mixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenstat.operators import classify, resample, trees
from lumenstat.plans.common import rounded, table

X = ["a", "b"]
SHRINK = 1.0
REPLICATES = 20


def _parts(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_type", F.col("p_size").cast("double").alias("a"), ((F.col("p_size") + F.col("p_partkey") % 17) / 40.0).alias("b"))


def _scored(spark, d, kind):
    df = _parts(spark, d)
    m = classify.Moments(df, "p_type", X)
    scores = classify.discriminants(m, kind)
    return df.select("p_partkey", classify.first_best(m.labels, scores).alias("predicted"), F.round(F.greatest(*scores), 5).alias("score"), F.round(F.greatest(*classify.softmax(scores)), 5).alias("posterior"))


def lda_scores(spark, d):
    return _scored(spark, d, "linear")


def diagonal_lda_scores(spark, d):
    return _scored(spark, d, "diagonal")


def qda_scores(spark, d):
    return _scored(spark, d, "quadratic")


def _shrunken(spark, d):
    v = table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    return classify.shrunken(v, "label", "v", SHRINK)


def nsc_centroids(spark, d):
    return rounded(_shrunken(spark, d).select("label", F.col("i").cast("long").alias("i"), "mean", "d", "shrunk"), 6)


def nsc_predict(spark, d):
    """Nearest shrunken centroid; the model (class x component) is broadcast-size by construction and joined by component."""
    v = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    s = v.join(_shrunken(spark, d), "i").groupBy("vec_id", "label").agg(F.sum(F.pow((F.col("x") - F.col("shrunk")) / F.col("spread"), F.lit(2))).alias("dist"), F.first("n").alias("n"), F.first("total").alias("total"))
    s = s.withColumn("score", F.round(F.col("dist") - 2 * F.log(F.col("n") / F.col("total")), 5))
    return s.groupBy("vec_id").agg(F.min(F.struct("score", "label")).alias("m")).select("vec_id", F.col("m.label").alias("predicted"), "m.score")


def logistic_two_steps(spark, d):
    docs = table(spark, d, "documents").select("doc_id", (F.least("n_chars", F.lit(5000)) / 1000.0).alias("x"))
    b = classify.logistic(table(spark, d, "labels").join(docs, "doc_id"), ["x"], "quality", 2)
    return rounded(spark.createDataFrame([("(intercept)", float(b[0])), ("x", float(b[1]))], "term string, estimate double"), 5)


def stump_split(spark, d):
    df = _parts(spark, d)
    s = trees.best_splits(df, {"a": trees.midpoints(df, "a", 1000)}, "b", F.lit(1)).select("cut", F.col("nl").cast("long").alias("n_left"), (F.col("sl") / F.col("nl")).alias("left"), (F.col("sr") / F.col("nr")).alias("right"), "gain")
    return rounded(s, 6)


def tree_depth2(spark, d):
    df = _parts(spark, d)
    t = trees.grow(df, {"a": trees.midpoints(df, "a", 1000)}, "b", 2)
    return df.groupBy(t.node().cast("long").alias("node"), F.round(t.predict(), 6).alias("fit")).agg(F.count("*").alias("n"))


def adaboost_first_round(spark, d):
    df = _parts(spark, d).withColumn("y", F.when(F.col("b") > 0.85, 1).otherwise(-1))
    rows, _ = trees.adaboost(df, {"a": trees.midpoints(df, "a", 1000)}, "y", 1)
    return rounded(spark.createDataFrame([r[1:] for r in rows], "cut double, sign int, error double, vote double"), 6)


def boosted_error(spark, d):
    df = _parts(spark, d)
    fit = trees.boost(df, {"a": trees.midpoints(df, "a", 40)}, "b", 5, 0.5, 2)
    return df.agg(F.round(F.avg(F.pow(F.col("b") - fit, F.lit(2))), 8).alias("mse"), F.round(F.var_pop("b"), 8).alias("variance"))


def bootstrap_mean(spark, d):
    return rounded(resample.bootstrap_means(_parts(spark, d), "p_partkey", "b", REPLICATES), 8)


def bootstrap_interval(spark, d):
    m = resample.bootstrap_means(_parts(spark, d), "p_partkey", "b", REPLICATES)
    return rounded(m.agg(F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("se"), F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high")), 8)


def mixture_two_steps(spark, d):
    m, s, p, ll = resample.mixture(_parts(spark, d), "b", [0.5, 1.1], [0.2, 0.2], [0.5, 0.5], 2)
    return rounded(spark.createDataFrame([(k, float(m[k]), float(s[k]), float(p[k]), ll) for k in range(2)], "component int, mean double, sd double, weight double, loglik double"), 5)


_P = "WITH p AS (SELECT p_partkey, p_type, p_size::DOUBLE AS a, (p_size+p_partkey%17)::DOUBLE/40 AS b FROM part)"
_M = _P + ", m AS (SELECT p_type AS k, count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_pop(a)*count(*) AS saa, var_pop(b)*count(*) AS sbb, covar_pop(a,b)*count(*) AS sab FROM p GROUP BY 1), w AS (SELECT sum(saa)/(sum(n)-count(*)) AS aa, sum(sbb)/(sum(n)-count(*)) AS bb, sum(sab)/(sum(n)-count(*)) AS ab, sum(n) AS total FROM m)"


def _scores_sql(kind: str) -> str:
    aa, bb, ab = ("saa/(n-1)", "sbb/(n-1)", "sab/(n-1)") if kind == "quadratic" else ("w.aa", "w.bb", "0.0" if kind == "diagonal" else "w.ab")
    shift = "-0.5*ln(det)" if kind == "quadratic" else ""
    return _M + f""", v AS (SELECT k, n/total AS prior, ma, mb, {aa} AS vaa, {bb} AS vbb, {ab} AS vab, ({aa})*({bb})-power({ab},2) AS det FROM m, w),
      s AS (SELECT p_partkey, k, ln(prior){shift}-0.5*(vbb*power(a-ma,2)-2*vab*(a-ma)*(b-mb)+vaa*power(b-mb,2))/det AS s FROM p, v),
      t AS (SELECT p_partkey, k, s, row_number() OVER (PARTITION BY p_partkey ORDER BY s DESC, k) AS r, max(s) OVER (PARTITION BY p_partkey) AS top FROM s)
      SELECT p_partkey, max(k) FILTER (r=1) AS predicted, round(max(top),5) AS score, round(1/sum(exp(s-top)),5) AS posterior FROM t GROUP BY 1"""


_N = f"""WITH e AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding,1)-1 AS i FROM embeddings),
  c AS (SELECT label, i, count(*) AS n, avg(x) AS mean, var_pop(x)*count(*) AS ss FROM e GROUP BY 1, 2),
  f AS (SELECT i, sum(n*mean)/sum(n) AS al, sum(n)::DOUBLE AS total, sqrt(sum(ss)/(sum(n)-count(*))) AS s FROM c GROUP BY 1),
  g AS (SELECT label, i, n, total, mean, al, s+(SELECT quantile_cont(s,0.5) FROM f) AS spread, sqrt(1.0/n-1/total) AS mk FROM c JOIN f USING (i)),
  h AS (SELECT *, (mean-al)/(mk*spread) AS d FROM g), q AS (SELECT *, al+mk*spread*sign(d)*greatest(abs(d)-{SHRINK},0) AS shrunk FROM h)"""
_K = _P + ", v AS (SELECT a, count(*) AS n, sum({y}) AS s FROM p GROUP BY a), c AS (SELECT a, (a+lead(a) OVER w)/2 AS cut, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER () AS n, sum(s) OVER () AS s FROM v WINDOW w AS (ORDER BY a)), t AS (SELECT *, n-nl AS nr, s-sl AS sr FROM c WHERE cut IS NOT NULL)"
_COPIES = "+".join(f"(h>={s})::INT" for s in resample.STEPS)
_R = _P + f", h AS (SELECT r, b, ((p_partkey%10007)*(7919+31*r)+104729*r)%10007 AS h FROM p, range({REPLICATES}) t(r)), m AS (SELECT r AS replicate, sum(({_COPIES})*b)/sum({_COPIES}) AS mean FROM h GROUP BY 1)"


def _mixture_sql() -> str:
    sql = _P + ", t0 AS (SELECT 0.5::DOUBLE AS m0, 1.1::DOUBLE AS m1, 0.2::DOUBLE AS s0, 0.2::DOUBLE AS s1, 0.5::DOUBLE AS p0, 0.5::DOUBLE AS p1, 0.0::DOUBLE AS ll)"
    for k in range(2):
        dens = [f"p{c}/s{c}/sqrt(2*pi())*exp(-0.5*power((b-m{c})/s{c},2)) AS d{c}" for c in range(2)]
        sql += f", d{k} AS (SELECT b, {', '.join(dens)} FROM p, t{k}), r{k} AS (SELECT b, d0/(d0+d1) AS r0, d1/(d0+d1) AS r1, ln(d0+d1) AS l FROM d{k}), u{k} AS (SELECT sum(r0*b)/sum(r0) AS m0, sum(r1*b)/sum(r1) AS m1, sum(r0) AS w0, sum(r1) AS w1, count(*) AS n, sum(l) AS ll FROM r{k})"
        sql += f", t{k+1} AS (SELECT m0, m1, sqrt(sum(r0*power(b-m0,2))/any_value(w0)) AS s0, sqrt(sum(r1*power(b-m1,2))/any_value(w1)) AS s1, any_value(w0/n) AS p0, any_value(w1/n) AS p1, any_value(ll) AS ll FROM r{k}, u{k} GROUP BY m0, m1)"
    return sql + " SELECT 0::INT AS component, round(m0,5) AS mean, round(s0,5) AS sd, round(p0,5) AS weight, round(ll,5) AS loglik FROM t2 UNION ALL SELECT 1, round(m1,5), round(s1,5), round(p1,5), round(ll,5) FROM t2"


def _logistic_sql() -> str:
    sql = "WITH l AS (SELECT quality AS y, least(n_chars,5000)/1000.0::DOUBLE AS x FROM labels JOIN documents USING (doc_id)), t0 AS (SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1)"
    for k in range(2):
        sql += f", q{k} AS (SELECT x, y, b0, b1, 1/(1+exp(-(b0+b1*x))) AS p FROM l, t{k}), g{k} AS (SELECT any_value(b0) AS b0, any_value(b1) AS b1, sum(p*(1-p)) AS h, sum(p*(1-p)*x) AS hx, sum(p*(1-p)*x*x) AS hxx, sum(y-p) AS g, sum((y-p)*x) AS gx FROM q{k}), t{k+1} AS (SELECT b0+(hxx*g-hx*gx)/(h*hxx-hx*hx) AS b0, b1+(h*gx-hx*g)/(h*hxx-hx*hx) AS b1 FROM g{k})"
    return sql + " SELECT '(intercept)' AS term, round(b0,5) AS estimate FROM t2 UNION ALL SELECT 'x', round(b1,5) FROM t2"


_TREE = _P + """, v AS (SELECT a, count(*) AS n, sum(b) AS s FROM p GROUP BY a),
  c AS (SELECT (a+lead(a) OVER w)/2 AS cut, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER () AS n, sum(s) OVER () AS s FROM v WINDOW w AS (ORDER BY a)),
  r AS (SELECT cut FROM c WHERE nl>=5 AND n-nl>=5 AND cut IS NOT NULL ORDER BY round(sl*sl/nl+(s-sl)*(s-sl)/(n-nl)-s*s/n,9) DESC, cut LIMIT 1),
  v2 AS (SELECT CASE WHEN a<=cut THEN 2 ELSE 3 END AS node, a, n, s FROM v, r),
  k2 AS (SELECT a, lead(a) OVER (ORDER BY a) AS up FROM v), c2 AS (SELECT node, (a+up)/2 AS cut, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER q AS n, sum(s) OVER q AS s FROM v2 JOIN k2 USING (a) WINDOW w AS (PARTITION BY node ORDER BY a), q AS (PARTITION BY node)),
  r2 AS (SELECT node, cut, row_number() OVER (PARTITION BY node ORDER BY round(sl*sl/nl+(s-sl)*(s-sl)/(n-nl)-s*s/n,9) DESC, cut) AS k FROM c2 WHERE nl>=5 AND n-nl>=5 AND cut IS NOT NULL)
  SELECT (2*v2.node + (v2.a > r2.cut)::INT)::BIGINT AS node, round(sum(s)/sum(n),6) AS fit, sum(n)::BIGINT AS n FROM v2 JOIN r2 ON r2.node=v2.node AND k=1 GROUP BY 1"""
QUERIES = {f.__name__: f for f in (lda_scores, diagonal_lda_scores, qda_scores, nsc_centroids, nsc_predict, logistic_two_steps, stump_split, tree_depth2, adaboost_first_round, boosted_error, bootstrap_mean, bootstrap_interval, mixture_two_steps)}
ORACLES = {
    "lda_scores": _scores_sql("linear"),
    "diagonal_lda_scores": _scores_sql("diagonal"),
    "qda_scores": _scores_sql("quadratic"),
    "nsc_centroids": _N + " SELECT label, i::BIGINT AS i, round(mean,6) AS mean, round(d,6) AS d, round(shrunk,6) AS shrunk FROM q",
    "nsc_predict": _N + ", s AS (SELECT vec_id, q.label, round(sum(power((x-shrunk)/spread,2))-2*ln(any_value(q.n/total)),5) AS score FROM e JOIN q USING (i) GROUP BY 1, 2) SELECT vec_id, arg_min(label, (score, label)) AS predicted, min(score) AS score FROM s GROUP BY 1",
    "logistic_two_steps": _logistic_sql(),
    "stump_split": _K.format(y="b") + ", g AS (SELECT *, sl*sl/nl+sr*sr/nr-s*s/n AS gain FROM t WHERE nl>=5 AND nr>=5) SELECT cut, nl::BIGINT AS n_left, round(sl/nl,6) AS left, round(sr/nr,6) AS right, round(gain,6) AS gain FROM g ORDER BY round(g.gain,9) DESC, cut LIMIT 1",
    "tree_depth2": _TREE,
    "adaboost_first_round": _K.format(y="CASE WHEN b>0.85 THEN 1.0::DOUBLE ELSE -1.0 END") + ", e AS (SELECT cut, CASE WHEN sl>=sr THEN 1 ELSE -1 END AS sign, 0.5*(1-abs(sl-sr)/n) AS error FROM t ORDER BY abs(sl-sr) DESC, cut LIMIT 1) SELECT round(cut,6) AS cut, sign::INT AS sign, round(error,6) AS error, round(0.5*ln((1-error)/error),6) AS vote FROM e WHERE error < 0.5",
    "bootstrap_mean": _R + " SELECT replicate::INT AS replicate, round(mean,8) AS mean FROM m",
    "bootstrap_interval": _R + " SELECT round(avg(mean),8) AS mean, round(stddev_samp(mean),8) AS se, round(quantile_cont(mean,0.025),8) AS low, round(quantile_cont(mean,0.975),8) AS high FROM m",
    "mixture_two_steps": _mixture_sql(),
}
