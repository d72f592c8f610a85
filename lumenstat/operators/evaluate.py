"""Scores of predictions: aggregates and windows over one pass or one sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def regression_metrics(df: DataFrame, y: Column, fit: Column) -> DataFrame:
    r = y - fit
    return df.agg(F.avg(r * r).alias("mse"), F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(F.abs(r)).alias("mae"), (1 - F.sum(r * r) / (F.var_pop(y) * F.count(y))).alias("r2"))


def confusion(df: DataFrame, y: Column, predicted: Column) -> DataFrame:
    def n(a: int, b: int) -> Column:
        return F.sum(F.when((y == a) & (predicted == b), 1).otherwise(0)).cast("long")

    return df.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))


def rates(table: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return table.select(
        *table.columns, ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"), F.try_divide(tp, tp + fn).alias("sensitivity"),
        F.try_divide(tn, tn + fp).alias("specificity"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def auc(df: DataFrame, y: Column, score: Column) -> DataFrame:
    """By mean ranks of ties. Scores are first counted, so that the one ordered window sees distinct scores only."""
    by = df.groupBy(score.alias("s")).agg(F.sum(F.when(y == 1, 1).otherwise(0)).alias("p"), F.count("*").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = by.withColumn("rank", below + (F.col("n") + 1) / 2)
    return ranked.agg(((F.sum(F.col("p") * F.col("rank")) - F.sum("p") * (F.sum("p") + 1) / 2) / (F.sum("p") * (F.sum("n") - F.sum("p")))).alias("auc"))


def log_loss(y: Column, p: Column, eps: float = 1e-15) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -F.avg(F.when(y == 1, F.log(q)).otherwise(F.log(1 - q)))
