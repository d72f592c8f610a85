"""Connected components by alternating star contractions; links never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lumenstat.llm.shared import Scratch


def _to_least(edges: DataFrame, out: str) -> DataFrame:
    """Edges (u, v) in both needed directions; every v of u, and u, point to the least of them. Least is found by
    partial aggregation and joined back, so that a node with many neighbours is no single task's work."""
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = edges.join(least, "u")
    if out == "large":
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``links`` has long columns u, v, repeats and loops allowed. Returns node, component (the least node), for nodes with links."""
    edges = scratch.write(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both, "large").filter("u <> v").distinct()
        # the lesser neighbours of each node
        small = _to_least(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "small").filter("u <> v").distinct()
        seen = Observation()
        edges = scratch.write(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "edges")
        now = (seen.get["n"], seen.get["sum"])
        if now == before or not now[0]:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
