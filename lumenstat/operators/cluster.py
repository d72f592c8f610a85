"""Distances, centroids, k-means and nearest neighbours over array vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstat.operators.blocks import nearest_blocks


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, z: s + z)


def centroids(df: DataFrame, label: str, vec: str) -> DataFrame:
    """label, i, mean, var (n - 1), n: moments by component, aggregated before any join."""
    long = df.select(label, F.posexplode(vec).alias("i", "x"))
    return long.groupBy(label, "i").agg(F.avg("x").alias("mean"), F.var_samp("x").alias("var"), F.count("x").alias("n"))


def nearest_centre(df: DataFrame, vec: str, centres: list[list[float]]) -> Column:
    """Number of the nearest of a few literal centres, the first at ties."""
    dist = [squared_distance(F.col(vec), F.array(*[F.lit(float(x)) for x in c])) for c in centres]
    least = F.least(*dist) if len(dist) > 1 else dist[0]
    col = F.lit(len(dist) - 1)
    for k in reversed(range(len(dist) - 1)):
        col = F.when(dist[k] <= least, F.lit(k)).otherwise(col)
    return col.cast("int")


def kmeans(df: DataFrame, cols: list[str], start: list[list[float]], steps: int) -> tuple[list[list[float]], DataFrame]:
    """Lloyd steps: one job each, the model as literals; an empty cluster keeps its centre."""
    data = df.withColumn("vec", F.array(*[F.col(c).cast("double") for c in cols]))
    centres = [list(c) for c in start]
    for _ in range(steps):
        rows = data.withColumn("cluster", nearest_centre(data, "vec", centres)).groupBy("cluster").agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).collect()
        for r in rows:
            centres[r["cluster"]] = [float(r[f"m{i}"]) for i in range(len(cols))]
    return centres, data.withColumn("cluster", nearest_centre(data, "vec", centres)).drop("vec")


def neighbours(queries: DataFrame, data: DataFrame, k: int, id_col: str, vec: str) -> DataFrame:
    """Exact nearest rows of ``data`` by Euclidean distance for a stated set of queries, of any number; the lowest id wins ties."""
    carry = [c for c in data.columns if c != vec]
    return nearest_blocks(queries, data, k, id_col, vec, "euclidean", id_col, carry).select(*carry, "query_id", "dist", "rank")


def sums_of_squares(df: DataFrame, label: str, x: list[str]) -> DataFrame:
    """total, within and between clusters, from one grouped and one small aggregation of moments."""
    per = df.groupBy(label).agg(*[f(c).alias(f"{n}_{c}") for c in x for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))])
    within = sum((F.sum(F.col(f"n_{c}") * F.col(f"v_{c}")) for c in x), F.lit(0.0))
    between = sum((F.sum(F.col(f"n_{c}") * F.pow(F.col(f"m_{c}"), F.lit(2))) - F.pow(F.sum(F.col(f"n_{c}") * F.col(f"m_{c}")), F.lit(2)) / F.sum(f"n_{c}") for c in x), F.lit(0.0))
    return per.agg((within + between).alias("total"), within.alias("within"), between.alias("between"))


def rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    """rand, adjusted: from the contingency table, never from pairs of rows."""

    def pairs(*by: str) -> DataFrame:
        n = df.groupBy(*by).count()
        return n.agg(F.coalesce(F.sum(F.col("count") * (F.col("count") - 1) / 2), F.lit(0.0)).alias("p"))

    both, left, right, every = pairs(a, b).toDF("c"), pairs(a).toDF("x"), pairs(b).toDF("y"), pairs().toDF("t")
    row = both.crossJoin(left).crossJoin(right).crossJoin(every)  # one row each
    expected = F.col("x") * F.col("y") / F.col("t")
    return row.select(((F.col("t") + 2 * F.col("c") - F.col("x") - F.col("y")) / F.col("t")).alias("rand"), ((F.col("c") - expected) / ((F.col("x") + F.col("y")) / 2 - expected)).alias("adjusted"))


def silhouettes(df: DataFrame, label: str, cols: list[str]) -> DataFrame:
    """Adds a, b, silhouette with squared Euclidean distance: the mean distance to a cluster follows from its size, means and
    squares, so that no pair of rows is formed. A row alone in its cluster, or one cluster alone, has 0. Rows with nulls are left out.
    Clusters, as few as the clustering was asked for, become literals."""
    data = df.dropna(subset=[label, *cols])
    mid = data.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    z = [F.col(c) - float(mid[f"m{i}"] or 0.0) for i, c in enumerate(cols)]
    sq = sum((v * v for v in z[1:]), z[0] * z[0])
    known = data.groupBy(F.col(label).alias("l")).agg(F.count("*").cast("double").alias("n"), F.avg(sq).alias("q"), F.array(*[F.avg(v) for v in z]).alias("m")).collect()
    own = alone = F.lit(None).cast("double")
    others = []
    for r in known:
        dist = sq - 2 * sum((v * float(c) for v, c in zip(z, r["m"], strict=True)), F.lit(0.0)) + float(r["q"])
        mine = F.col(label) == F.lit(r["l"])
        own = F.when(mine, dist * r["n"] / (r["n"] - 1) if r["n"] > 1 else F.lit(0.0)).otherwise(own)
        alone = F.when(mine, F.lit(float(r["n"]))).otherwise(alone)
        others.append(F.when(~mine, dist))
    b = F.array_min(F.array(*others)) if others else F.lit(None).cast("double")
    out = data.withColumns({"a": own, "b": b, "_n": alone})
    top = F.greatest("a", "b")
    return out.withColumn("silhouette", F.when(F.col("b").isNull() | (F.col("_n") <= 1) | (top <= 0), 0.0).otherwise((F.col("b") - F.col("a")) / top)).drop("_n")
