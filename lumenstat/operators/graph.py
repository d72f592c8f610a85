"""PageRank by joins and aggregates: dangling mass follows the teleport vector, rank is renormalised each step.

Ranks that settle need no step for the dangling mass: it goes where the jumps go, so that they are in proportion to the sum of
what each jump hands on by links alone (``_settled``). That sum ends where the links end, after two terms if they lead one way.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pagerank(nodes: DataFrame, edges: DataFrame, steps: int, damping: float = 0.85, teleport: DataFrame | None = None, tol: float | None = None) -> DataFrame:
    """``nodes``: id; ``edges``: src, dst, distinct. ``teleport``: id, weight, for personal ranks (none: all alike). Returns id, rank after ``steps`` steps; with ``tol``, ranks that a further step moves by less than ``tol`` together (of ``steps`` terms at most). Lineage is cut by checkpoint()."""
    sc = nodes.sparkSession.sparkContext
    if not (nodes.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lumenstat-"))
    nodes = every_node = nodes.persist()
    n = nodes.count()
    degree = edges.groupBy("src").agg(F.count("*").alias("deg"))
    links = edges.join(degree, "src").select("src", "dst", "deg").persist()
    ranks = nodes.select("id", F.lit(1.0 / n).alias("rank"))
    if teleport is None:
        nodes = nodes.select("id", F.lit(1.0 / n).alias("jump"))
    else:
        every = teleport.join(nodes, "id", "left_semi").agg(F.sum("weight").alias("every"))
        nodes = nodes.join(teleport, "id", "left").crossJoin(F.broadcast(every)).select("id", (F.coalesce("weight", F.lit(0.0)) / F.col("every")).alias("jump"))  # one row
    if tol is not None and links.select("dst").distinct().join(nodes, F.col("dst") == nodes["id"], "left_anti").isEmpty():
        ranks = _settled(nodes, links, steps, damping, tol)  # holds checkpoints alone
        links.unpersist()
        every_node.unpersist()
        return ranks
    now = ranks
    for step in range(steps):
        sent = links.join(ranks, links["src"] == ranks["id"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
        loose = ranks.join(degree, ranks["id"] == degree["src"], "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        new = nodes.join(sent, nodes["id"] == sent["dst"], "left").crossJoin(F.broadcast(loose))  # one row
        raw = new.select("id", ((1 - damping) * F.col("jump") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") * F.col("jump"))).alias("raw"))
        total = raw.agg(F.sum("raw").alias("total"))
        ranks = raw.crossJoin(F.broadcast(total)).select("id", (F.col("raw") / F.col("total")).alias("rank"))
        if tol is not None:
            old, ranks = now, ranks.checkpoint()
            now = ranks
            moved = ranks.join(old.select("id", F.col("rank").alias("old")), "id").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
            if moved is None or moved < tol:
                break
        elif step + 1 < steps:  # each step reads the ranks four times, so the plan must not keep its past
            ranks = ranks.checkpoint()
    return ranks


def _settled(nodes: DataFrame, links: DataFrame, steps: int, damping: float, tol: float) -> DataFrame:
    """The ranks that no step moves, of links between ``nodes`` (id, jump): x = jump + damping * (what x sends), scaled to a sum of 1.

    A term of the sum is a join and an aggregation of the nodes that the last one reached. A step from x moves the ranks by twice
    the next term at most, in parts of x's sum.
    """
    now = nodes.select("id", F.col("jump").alias("x"), F.col("jump").alias("term")).checkpoint()
    for _ in range(steps):
        reached = now.filter("term <> 0").select("id", "term")
        sent = links.join(reached, links["src"] == reached["id"]).groupBy("dst").agg((damping * F.sum(F.col("term") / F.col("deg"))).alias("got"))
        got = F.coalesce("got", F.lit(0.0))
        now = now.select("id", "x").join(sent, F.col("id") == F.col("dst"), "left").select("id", (F.col("x") + got).alias("x"), got.alias("term")).checkpoint()
        moved, every = now.agg(F.sum(F.abs("term")), F.sum("x")).first()
        if moved is None or 2 * moved < tol * every:
            break
    return now.crossJoin(F.broadcast(now.agg(F.sum("x").alias("every")))).select("id", (F.col("x") / F.col("every")).alias("rank"))  # one row


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree, dangling (no edge leaves it)."""
    out, into = edges.groupBy("src").agg(F.count("*").alias("o")), edges.groupBy("dst").agg(F.count("*").alias("i"))
    both = nodes.join(out, nodes["id"] == out["src"], "left").join(into, nodes["id"] == into["dst"], "left")
    return both.select("id", F.coalesce("o", F.lit(0)).cast("long").alias("out_degree"), F.coalesce("i", F.lit(0)).cast("long").alias("in_degree"), F.col("o").isNull().alias("dangling"))


def transition(edges: DataFrame) -> DataFrame:
    """src, dst, probability: one over the out-degree."""
    return edges.join(edges.groupBy("src").agg(F.count("*").alias("d")), "src").select("src", "dst", (1 / F.col("d")).alias("probability"))


def google_matrix(nodes: DataFrame, edges: DataFrame, damping: float = 0.85) -> DataFrame:
    """src, dst, probability of every ordered pair: for a small graph (at most 5,000 nodes, counted), as a table to look at."""
    n = nodes.count()
    if n > 5_000:
        raise ValueError(f"{n} nodes: the whole matrix is formed of at most 5,000")
    deg = edges.groupBy("src").agg(F.count("*").alias("deg"))
    every = nodes.select(F.col("id").alias("src")).crossJoin(F.broadcast(nodes.select(F.col("id").alias("dst")))).join(deg, "src", "left")
    both = every.join(edges.withColumn("on", F.lit(1.0)), ["src", "dst"], "left")
    step = F.when(F.col("deg").isNull(), 1.0 / n).otherwise(F.coalesce("on", F.lit(0.0)) / F.col("deg"))
    return both.select("src", "dst", (damping * step + (1 - damping) / n).alias("probability"))


def pagerank_direct(nodes: DataFrame, edges: DataFrame, damping: float = 0.85) -> list[tuple[int, float]]:
    """(id, rank) of a small graph by solving the linear equations, not by steps."""
    import numpy as np

    rows = google_matrix(nodes, edges, 1.0).collect()
    ids = sorted({r["src"] for r in rows})
    at = {k: i for i, k in enumerate(ids)}
    p = np.zeros((len(ids), len(ids)))
    for r in rows:
        p[at[r["src"]], at[r["dst"]]] = r["probability"]
    rank = np.linalg.solve(np.eye(len(ids)) - damping * p.T, np.full(len(ids), (1 - damping) / len(ids)))
    return list(zip(ids, (rank / rank.sum()).tolist(), strict=True))


def contributions(edges: DataFrame, ranks: DataFrame, damping: float = 0.85) -> DataFrame:
    """src, dst, sent: the rank that each link hands on."""
    return transition(edges).join(ranks.select(F.col("id").alias("src"), "rank"), "src").select("src", "dst", (damping * F.col("rank") * F.col("probability")).alias("sent"))


def random_surfer(nodes: DataFrame, edges: DataFrame, steps: int = 20, surfers: int = 1000, damping: float = 0.85, seed: int = 1) -> DataFrame:
    """id, visits, share: many surfers walk ``steps`` steps side by side, each a join; the draws are digests of surfer and step."""
    from lumenstat.operators.order import placed
    from lumenstat.operators.resample import hashed

    spark, n = nodes.sparkSession, nodes.count()
    homes = placed(nodes.select("id"), "id", "at").select("id", "at")
    out = edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("to"))  # a node's own links
    now = spark.range(surfers).select(F.col("id").alias("surfer"), F.pmod(hashed("id", seed), F.lit(n)).alias("at")).join(homes, "at").select("surfer", "id")
    seen = now
    for step in range(1, steps + 1):
        key = F.concat_ws(":", F.col("surfer").cast("string"), F.lit(str(step)))
        u, v = hashed(key, seed) / float(1 << 32), hashed(key, seed + 1)
        moved = now.join(out, now["id"] == out["src"], "left").withColumn("jump", F.col("to").isNull() | (u >= damping))
        moved = moved.select("surfer", F.when(~F.col("jump"), F.element_at("to", (F.pmod(v, F.size("to")) + 1).cast("int"))).alias("next"), F.pmod(v, F.lit(n)).alias("at"))
        now = moved.join(homes, "at").select("surfer", F.coalesce("next", "id").alias("id"))
        if step % 5 == 0:
            now = now.checkpoint() if spark.sparkContext.getCheckpointDir() else now
        seen = seen.unionByName(now)
    return seen.groupBy("id").agg(F.count("*").alias("visits")).withColumn("share", F.col("visits") / float(surfers * (steps + 1)))
