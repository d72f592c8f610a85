"""Exact ranks without a global sort in one task, stratified folds, permutations, and runs along a curve."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4099  # a prime: ids with a regular step still spread


def ranked(df: DataFrame, key: str, out: str, by: list[str] | None = None, seed: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``out``: rank from 0 within ``by``, ordered by (key mod buckets, key), for a unique integer key; with a seed, by a hash of the key. Ranks within a bucket come from a
    window; buckets are placed by a running sum of their sizes, a table of groups times buckets rows, so a large group is no single task."""
    by = by or []
    at = F.col(key).cast("long") if seed is None else F.xxhash64(key, F.lit(seed))
    data = df.withColumn("_bucket", F.pmod(at, F.lit(buckets)))
    sizes = data.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.col("_bucket").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = [F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)]
    place = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(at, key)) - 1
    inner = data.withColumn("_in", place)
    joined = inner.join(starts, reduce(lambda a, b: a & b, same, F.col("_bucket") == F.col("_at")))
    return joined.select(*df.columns, (F.col("_start") + F.col("_in")).alias(out))


def placed(df: DataFrame, key: str, out: str, buckets: int = BUCKETS) -> DataFrame:
    """``out``: rank from 0 in the order of a unique integer key, exact at any size: buckets are equal ranges of the key from its least to its greatest value; a window ranks
    within a bucket, and buckets are placed by a running sum of their sizes."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    width = 1 if low is None else (high - low) // buckets + 1
    data = df.withColumn("_bucket", F.expr(f"(`{key}` - ({low or 0})) div {width}"))
    sizes = data.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    starts = sizes.select(F.col("_bucket"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = data.withColumn("_in", F.row_number().over(Window.partitionBy("_bucket").orderBy(key)) - 1)
    return inner.join(F.broadcast(starts), "_bucket").select(*df.columns, (F.col("_start") + F.col("_in")).alias(out))


def stratified_folds(df: DataFrame, y: str, key: str, k: int = 5) -> DataFrame:
    """Adds fold 0 to k - 1: sizes of a class differ by one row at most. Null is a class of its own."""
    return ranked(df, key, "_rank", [y]).withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank")


def permuted(df: DataFrame, column: str, key: str, seed: int = 1) -> DataFrame:
    """``df`` with ``column`` dealt anew: each value moves to another place once, by a join on two ranks."""
    a = ranked(df, key, "_rank")
    b = ranked(df.select(key, F.col(column).alias("_new")), key, "_rank", seed=seed).select("_rank", "_new")
    return a.join(b, "_rank").select(*[F.col("_new").alias(c) if c == column else F.col(c) for c in df.columns])


def permutation_importance(df: DataFrame, x: list[str], y: str, key: str, model: Column, repeats: int = 1) -> dict[str, float]:
    """Mean rise of the squared error of ``model`` (a column over x) when one feature at a time is dealt anew."""
    data = df.dropna(subset=[*x, y]).select(key, *x, y)
    error = F.avg(F.pow(F.col(y) - model, F.lit(2))).alias("e")
    base = data.agg(error).first()["e"]
    if base is None:
        return dict.fromkeys(x, 0.0)
    return {c: sum(permuted(data, c, key, s).agg(error).first()["e"] - base for s in range(1, repeats + 1)) / repeats for c in x}


def partial_dependence(df: DataFrame, x: str, grid: list[float], model: Column) -> DataFrame:
    """value, mean: the mean of ``model`` over all rows with x set to each value; one pass, partial sums a value."""
    rest = [c for c in df.columns if c != x]
    return df.select(*rest, F.explode(F.array(*[F.lit(float(v)) for v in grid])).alias(x)).groupBy(F.col(x).alias("value")).agg(F.avg(model).alias("mean"))


def total_variation(curve: DataFrame, t: str, value: str, by: list[str] | None = None) -> DataFrame:
    """total_variation, jumps (steps above 1e-3): summed absolute first differences in the order of t."""
    step = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(*(by or [])).orderBy(t)))
    rows = curve.select(*(by or []), step.alias("d"))
    return rows.groupBy(*(by or [])).agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("total_variation"), F.count_if(F.col("d") > 1e-3).alias("jumps"))


def segments(curve: DataFrame, t: str, value: str, tol: float = 0.01, by: list[str] | None = None) -> DataFrame:
    """Adds segment from 1: a new one starts where the value moves by more than ``tol``."""
    w = Window.partitionBy(*(by or [])).orderBy(t)
    jump = F.when(F.abs(F.col(value) - F.lag(value).over(w)) > tol, 1).otherwise(0)
    return curve.withColumn("_jump", jump).withColumn("segment", F.sum("_jump").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("_jump")


def active_intervals(curve: DataFrame, t: str, active: Column, by: list[str] | None = None) -> DataFrame:
    """start, end, n of each run of rows where ``active`` holds; null does not."""
    w = Window.partitionBy(*(by or [])).orderBy(t)
    on = F.coalesce(active, F.lit(False))
    rows = curve.withColumn("_on", on).withColumn("_off", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter("_on").groupBy(*(by or []), "_off").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("n")).drop("_off")
