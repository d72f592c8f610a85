"""CSV scans and generated data. Draws are functions of (row id, seed, stream), so a lost task or another partitioning gives the same rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def csv(spark: SparkSession, path: str, schema: str, null_value: str = "?", header: bool = True) -> DataFrame:
    """A CSV file with a stated schema; ``null_value`` marks missing cells, malformed rows are errors."""
    return spark.read.schema(schema).csv(path, header=header, nullValue=null_value, mode="FAILFAST", enforceSchema=False)


def uniform(key: Column, seed: int, stream: int = 0) -> Column:
    """In (0, 1): 52 bits of a hash."""
    h = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), F.lit(stream)), 12)
    return (h.cast("double") + 0.5) / float(1 << 52)


def normal(key: Column, seed: int, stream: int = 0) -> Column:
    """Box-Muller on two uniforms of streams of their own."""
    return F.sqrt(-2 * F.log(uniform(key, seed, 2 * stream))) * F.cos(2 * math.pi * uniform(key, seed, 2 * stream + 1))


def bernoulli(key: Column, p: Column | float, seed: int, stream: int = 0) -> Column:
    return (uniform(key, seed, stream) < p).cast("int")


def exponential(key: Column, rate: float, seed: int, stream: int = 0) -> Column:
    return -F.log(uniform(key, seed, stream)) / rate


def gamma(key: Column, shape: int, rate: float, seed: int, stream: int = 0) -> Column:
    """Of whole-number shape: a sum of exponentials."""
    return sum((exponential(key, rate, seed, stream * shape + k) for k in range(shape)), F.lit(0.0))


def multivariate_normal(key: Column, mean: list[float], cov: list[list[float]], seed: int) -> list[Column]:
    """Columns of the Cholesky factor times independent normals."""
    low = np.linalg.cholesky(np.array(cov, float))
    z = [normal(key, seed, k) for k in range(len(mean))]
    return [sum((float(low[i, j]) * z[j] for j in range(i + 1)), F.lit(float(m))) for i, m in enumerate(mean)]


def grid(spark: SparkSession, **axes: list[float]) -> DataFrame:
    """Every combination of the axes' values, by arithmetic on one range; the first axis runs fastest."""
    total = math.prod(len(v) for v in axes.values())
    df, step = spark.range(total), 1
    for name, values in axes.items():
        df = df.withColumn(name, F.get(F.array(*[F.lit(float(v)) for v in values]), F.floor(F.col("id") / step).cast("int") % len(values)))
        step *= len(values)
    return df.drop("id")


def bit_vectors(spark: SparkSession, width: int) -> DataFrame:
    """id and bits b0.. of every vector of the width."""
    return spark.range(1 << width).select("id", *[F.shiftright("id", k).bitwiseAND(F.lit(1)).cast("int").alias(f"b{k}") for k in range(width)])
