"""Metrics, folds, bases, smoothing and signals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenstat.functions import bspline1, epanechnikov, fold, gaussian, hinge, huber, pinball, tricube, truncated_power
from lumenstat.operators import evaluate, order, signals
from lumenstat.operators.linear import gram
from lumenstat.plans.common import r6, rounded, table

CUTS = [round(0.1 * i, 1) for i in range(1, 10)]


def _labelled(spark, d):
    """Quality with a score from the length alone: a fixed logistic curve."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    p = 1 / (1 + F.exp(-(F.col("n_chars") - 1000) / 500.0))
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("y"), F.round(p, 3).alias("p"))


def confusion_rates(spark, d):
    df = _labelled(spark, d)
    return rounded(evaluate.rates(evaluate.confusion(df, F.col("y"), F.when(F.col("p") >= 0.5, 1).otherwise(0))))


def threshold_table(spark, d):
    cut = F.explode(F.array(*[F.lit(c) for c in CUTS])).alias("cut")
    df = _labelled(spark, d).select("y", "p", cut)
    hit = F.col("p") >= F.col("cut")
    return df.groupBy("cut").agg(F.count_if(hit & (F.col("y") == 1)).alias("tp"), F.count_if(hit & (F.col("y") == 0)).alias("fp"), F.count_if(~hit & (F.col("y") == 1)).alias("fn"), F.count_if(~hit & (F.col("y") == 0)).alias("tn"))


def roc_points(spark, d):
    by = _labelled(spark, d).groupBy("p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    w = Window.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    tot = by.agg(F.sum("pos").alias("tp"), F.sum("neg").alias("tn"))
    return rounded(by.select("p", F.sum("pos").over(w).alias("cp"), F.sum("neg").over(w).alias("cn")).crossJoin(F.broadcast(tot)).select(F.col("p").alias("threshold"), (F.col("cp") / F.col("tp")).alias("tpr"), (F.col("cn") / F.col("tn")).alias("fpr")))


def auc_rank(spark, d):
    return rounded(evaluate.auc(_labelled(spark, d), F.col("y"), F.col("p")))


def log_loss_brier(spark, d):
    y, p = F.col("y"), F.col("p")
    return rounded(_labelled(spark, d).agg(evaluate.log_loss(y, p).alias("log_loss"), F.avg((y - p) * (y - p)).alias("brier"), F.count("*").alias("n")))


def losses(spark, d):
    r = (F.col("p_retailprice") - 1400) / 100.0
    return rounded(table(spark, d, "part").agg(F.avg(r * r).alias("squared"), F.avg(F.abs(r)).alias("absolute"), F.avg(huber(r, 1.345)).alias("huber"), F.avg(pinball(r, 0.9)).alias("pinball")))


def kfold_linear_cv(spark, d):
    """Five folds by key arithmetic; the fit without a fold comes from total sums less the fold's."""
    df = table(spark, d, "part").select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), fold(F.col("p_partkey"), 5).alias("fold"))
    per = gram(df, ["x"], "y", by=["fold"])
    s = [c for c in per.columns if c != "fold"]
    tot = per.agg(*[F.sum(c).alias("t" + c) for c in s])
    n, x, y, xx, xy = ((F.col(f"ts_{k}") - F.col(f"s_{k}")) for k in ("0_0", "0_1", "0_2", "1_1", "1_2"))
    fits = per.crossJoin(F.broadcast(tot)).select("fold", ((xy - x * y / n) / (xx - x * x / n)).alias("b1"), (x / n).alias("mx"), (y / n).alias("my"))
    e = F.col("y") - (F.col("my") + F.col("b1") * (F.col("x") - F.col("mx")))
    return rounded(df.join(F.broadcast(fits), "fold").groupBy("fold").agg(F.avg(e * e).alias("mse"), F.count("*").alias("n")), 3)  # five rows


def cv_summary(spark, d):
    folds = kfold_linear_cv(spark, d)
    return rounded(folds.agg(F.avg("mse").alias("cv_mse"), (F.stddev_samp("mse") / F.sqrt(F.count("*"))).alias("se")), 2)


def poly_basis(spark, d):
    x = F.col("p_size") / 50.0
    return table(spark, d, "part").select("p_partkey", *[r6(F.pow(x, F.lit(k))).alias(f"x{k}") for k in range(1, 5)])


def spline_bases(spark, d):
    x = F.col("p_size").cast("double")
    cols = [r6(truncated_power(x, k)).alias(f"tp{k}") for k in (10, 25, 40)] + [r6(hinge(x, 25)).alias("hinge_r"), r6(hinge(x, 25, False)).alias("hinge_l")]
    return table(spark, d, "part").select("p_partkey", *cols, *[r6(b).alias(f"hat{i}") for i, b in enumerate(bspline1(x, [0, 10, 25, 40, 51]))])


def kernels(spark, d):
    u = (F.col("p_size") - 25) / 20.0
    return table(spark, d, "part").select("p_partkey", r6(epanechnikov(u)).alias("epanechnikov"), r6(tricube(u)).alias("tricube"), r6(gaussian(u)).alias("gaussian"))


def _grid(spark, d):
    """Rows aggregated to distinct x before they meet the grid: the join grows with the grid, not with the rows."""
    by = table(spark, d, "part").groupBy(F.col("p_size").cast("double").alias("x")).agg(F.sum("p_retailprice").alias("sy"), F.count("*").alias("n"))
    return by.select("x", "sy", "n", F.explode(F.array(*[F.lit(float(g)) for g in range(5, 50, 5)])).alias("x0"))


def local_constant(spark, d):
    k = epanechnikov((F.col("x") - F.col("x0")) / 8.0)
    return rounded(_grid(spark, d).groupBy("x0").agg((F.sum(k * F.col("sy")) / F.sum(k * F.col("n"))).alias("fit")), 4)


def local_linear(spark, d):
    g = _grid(spark, d).withColumn("k", epanechnikov((F.col("x") - F.col("x0")) / 8.0)).withColumn("u", F.col("x") - F.col("x0"))
    s = g.groupBy("x0").agg(F.sum(F.col("k") * F.col("n")).alias("a"), F.sum(F.expr("k*n*u")).alias("b"), F.sum(F.expr("k*n*u*u")).alias("c"), F.sum(F.expr("k*sy")).alias("y"), F.sum(F.expr("k*sy*u")).alias("z"))
    return rounded(s.select("x0", F.expr("(c*y - b*z) / (a*c - b*b)").alias("fit")), 4)


def _acf(s):
    m = s.agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"), F.count("*").alias("n"))
    c = s.crossJoin(F.broadcast(m)).select("i", (F.col("value") - F.col("m")).alias("c"), "v", "n")
    lags = c.select("i", "c", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("lag")).select((F.col("i") + F.col("lag")).alias("i"), F.col("c").alias("before"), "lag")
    return c.join(lags, "i").groupBy("lag").agg(r6(F.sum(F.col("c") * F.col("before")) / (F.first("v") * F.first("n"))).alias("acf"))


def _whole(spark, d):
    """All events in the order of their ids: event_id, value, i."""
    return order.placed(table(spark, d, "events").select("event_id", "value"), "event_id", "i")


def haar_level1_all(spark, d):
    """First Haar level of all events; an odd row at the end is paired with zero."""
    b, a = (F.coalesce(F.sum(F.when(F.col("i") % 2 == k, F.col("value"))), F.lit(0.0)) for k in (1, 0))
    s = _whole(spark, d).groupBy(F.floor(F.col("i") / 2).alias("k")).agg(b.alias("b"), a.alias("a"))
    return s.select("k", r6((F.col("a") + F.col("b")) / F.sqrt(F.lit(2.0))).alias("smooth"), r6((F.col("a") - F.col("b")) / F.sqrt(F.lit(2.0))).alias("detail"))


def haar_energy_all(spark, d):
    """Energy of every level of all events: no row is left out, and the energies and the squared sum over the padded length add up to the sum of squares."""
    return signals.haar_energies(_whole(spark, d), "i", "value").select("level", F.round("energy", 3).alias("energy"), "n")


def moving_average_all(spark, d):
    """Over all events: blocks of rows, each with two more at either side, so that windows do not meet in one task."""
    at = F.array_distinct(F.array(*[F.floor((F.col("i") + k) / 4096) for k in (-2, 0, 2)]))
    rows = _whole(spark, d).select("event_id", "value", "i", F.explode(at).alias("block"))
    w = Window.partitionBy("block").orderBy("i")
    out = rows.select("event_id", "i", "block", r6(F.avg("value").over(w.rowsBetween(-2, 2))).alias("ma5"), r6(F.col("value") - F.lag("value").over(w)).alias("diff"))
    return out.filter(F.floor(F.col("i") / 4096) == F.col("block")).select("event_id", "ma5", "diff")


def autocorrelation_all(spark, d):
    return _acf(_whole(spark, d))


_L = "WITH l AS (SELECT labels.doc_id, quality AS y, round(1/(1+exp(-(n_chars-1000)/500.0)),3) AS p FROM labels JOIN documents USING (doc_id))"
_C = _L + ", c AS (SELECT (count(*) FILTER (y=1 AND p>=0.5)) tp, (count(*) FILTER (y=0 AND p>=0.5)) fp, (count(*) FILTER (y=1 AND p<0.5)) fn, (count(*) FILTER (y=0 AND p<0.5)) tn FROM l)"
_W = "WITH s AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id)-1 AS i FROM events)"
_G = "WITH g AS (SELECT p_size::DOUBLE AS x, p_retailprice AS y, x0::DOUBLE AS x0 FROM part, range(5,50,5) t(x0)), k AS (SELECT x0, x-x0 AS u, y, CASE WHEN abs((x-x0)/8.0)<1 THEN 0.75*(1-power((x-x0)/8.0,2)) ELSE 0 END AS k FROM g)"
_F = """WITH p AS (SELECT p_size::DOUBLE x, p_retailprice y, ((p_partkey*7919+104729)%5)::INT fold FROM part),
 f AS (SELECT a.fold, regr_slope(b.y,b.x) b1, avg(b.x) mx, avg(b.y) my FROM (SELECT DISTINCT fold FROM p) a JOIN p b ON b.fold<>a.fold GROUP BY 1),
 e AS (SELECT p.fold, round(avg(power(y-my-b1*(x-mx),2)),3) mse, count(*) n FROM p JOIN f ON p.fold=f.fold GROUP BY 1)"""
QUERIES = {f.__name__: f for f in (confusion_rates, threshold_table, roc_points, auc_rank, log_loss_brier, losses, kfold_linear_cv, cv_summary, poly_basis, spline_bases, kernels, local_constant, local_linear, haar_level1_all, haar_energy_all, moving_average_all, autocorrelation_all)}
ORACLES = {
    "confusion_rates": _C + " SELECT tp, fp, fn, tn, round((tp+tn)/(tp+fp+fn+tn),6) AS accuracy, round(tp/(tp+fn),6) AS sensitivity, round(tn/(tn+fp),6) AS specificity, round(tp/(tp+fp),6) AS precision, round(2*tp/(2*tp+fp+fn),6) AS f1 FROM c",
    "threshold_table": _L + f" SELECT cut, count(*) FILTER (y=1 AND p>=cut) AS tp, count(*) FILTER (y=0 AND p>=cut) AS fp, count(*) FILTER (y=1 AND p<cut) AS fn, count(*) FILTER (y=0 AND p<cut) AS tn FROM l, (SELECT unnest({CUTS})::DOUBLE AS cut) GROUP BY cut",
    "roc_points": _L + ", b AS (SELECT p, sum(y) pos, sum(1-y) neg FROM l GROUP BY p) SELECT p AS threshold, round(sum(pos) OVER w / sum(pos) OVER (),6) AS tpr, round(sum(neg) OVER w / sum(neg) OVER (),6) AS fpr FROM b WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)",
    "auc_rank": _L + ", r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1)/2.0 AS rk FROM l) SELECT round((sum(rk) FILTER (y=1) - sum(y)*(sum(y)+1)/2.0)/(sum(y)*(count(*)-sum(y))),6)::DOUBLE AS auc FROM r",
    "log_loss_brier": _L + ", q AS (SELECT y, p, least(greatest(p,1e-15),1-1e-15) c FROM l) SELECT round(-avg(CASE WHEN y=1 THEN ln(c) ELSE ln(1-c) END),6) AS log_loss, round(avg((y-p)*(y-p)),6) AS brier, count(*) AS n FROM q",
    "losses": "WITH r AS (SELECT (p_retailprice-1400)/100.0 r FROM part) SELECT round(avg(r*r),6) AS squared, round(avg(abs(r)),6) AS absolute, round(avg(CASE WHEN abs(r)<=1.345 THEN 0.5*r*r ELSE 1.345*(abs(r)-0.5*1.345) END),6) AS huber, round(avg(CASE WHEN r>=0 THEN 0.9*r ELSE (0.9-1)*r END),6) AS pinball FROM r",
    "kfold_linear_cv": _F + " SELECT fold, mse, n FROM e",
    "cv_summary": _F + " SELECT round(avg(mse),2) AS cv_mse, round(stddev_samp(mse)/sqrt(count(*)),2) AS se FROM e",
    "poly_basis": "SELECT p_partkey, " + ", ".join(f"round(power(p_size/50.0,{k}),6) AS x{k}" for k in range(1, 5)) + " FROM part",
    "spline_bases": "SELECT p_partkey, " + ", ".join(f"round(power(greatest(p_size-{k}.0,0)::DOUBLE,3),6) AS tp{k}" for k in (10, 25, 40)) + ", greatest(p_size-25.0,0)::DOUBLE AS hinge_r, greatest(25.0-p_size,0)::DOUBLE AS hinge_l, " + ", ".join(
        f"round(greatest(0, least({f'(p_size-{k[i-1]})/{float(k[i]-k[i-1])}' if i else '1'}, {f'({k[i+1]}-p_size)/{float(k[i+1]-k[i])}' if i < 4 else '1'})),6)::DOUBLE AS hat{i}" for k in [[0, 10, 25, 40, 51]] for i in range(5)) + " FROM part",
    "kernels": "WITH u AS (SELECT p_partkey, (p_size-25)/20.0 u FROM part) SELECT p_partkey, round(CASE WHEN abs(u)<1 THEN 0.75*(1-u*u) ELSE 0 END,6)::DOUBLE AS epanechnikov, round(CASE WHEN abs(u)<1 THEN power(1-power(abs(u),3),3) ELSE 0 END,6)::DOUBLE AS tricube, round(exp(-0.5*u*u),6)::DOUBLE AS gaussian FROM u",
    "local_constant": _G + " SELECT x0, round(sum(k*y)/sum(k),4) AS fit FROM k GROUP BY x0",
    "local_linear": _G + " SELECT x0, round((sum(k*u*u)*sum(k*y)-sum(k*u)*sum(k*u*y))/(sum(k)*sum(k*u*u)-power(sum(k*u),2)),4) AS fit FROM k GROUP BY x0",
    "haar_level1_all": _W + " SELECT a.i//2 AS k, round((a.value+coalesce(b.value,0))/sqrt(2.0),6) AS smooth, round((a.value-coalesce(b.value,0))/sqrt(2.0),6) AS detail FROM s a LEFT JOIN s b ON b.i=a.i+1 WHERE a.i%2=0",
    "haar_energy_all": _W + ", w AS (SELECT level, i//(1::BIGINT<<level) AS k, sum(CASE WHEN (i//(1::BIGINT<<(level-1)))%2=0 THEN value ELSE -value END)/sqrt((1::BIGINT<<level)::DOUBLE) AS w FROM s, range(1,40) t(level) WHERE (1::BIGINT<<(level-1)) < (SELECT count(*) FROM s) GROUP BY 1,2) SELECT level::INT AS level, round(sum(w*w),3) AS energy, count(*) AS n FROM w GROUP BY 1",
    "moving_average_all": _W + " SELECT event_id, round(avg(value) OVER (ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING),6) AS ma5, round(value-lag(value) OVER (ORDER BY i),6) AS diff FROM s",
    "autocorrelation_all": _W + ", c AS (SELECT i, value-(SELECT avg(value) FROM s) AS c FROM s) SELECT l::INT AS lag, round(sum(a.c*b.c)/(SELECT sum(c*c) FROM c),6) AS acf FROM (SELECT i-l AS j, c, l FROM c, range(1,11) t(l)) a JOIN c b ON b.i=a.j GROUP BY l",
}
#: The first names of these queries, which read all events too.
for _name in ("haar_level1", "haar_energy", "moving_average", "autocorrelation"):
    QUERIES[_name], ORACLES[_name] = QUERIES[f"{_name}_all"], ORACLES[f"{_name}_all"]
