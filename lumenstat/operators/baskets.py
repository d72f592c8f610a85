"""Itemsets and association rules: counts by self-joins within a basket, pruned by frequent subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def supports(items: DataFrame, size: int, least: float) -> DataFrame:
    """Frequent itemsets of up to ``size`` items of distinct (txn, item) rows: item1.., support, level by level."""
    total = items.select("txn").distinct().count()
    single = items.groupBy("item").agg(F.count("*").alias("n")).filter(F.col("n") >= least * total)
    # at most a basket's mean size / least of them; a join by item would bring all baskets of a frequent item to one task
    kept = items.join(F.broadcast(single.select("item")), "item", "left_semi")
    out, rows = single.select(F.array("item").alias("items"), "n"), kept.select("txn", F.array("item").alias("items"), F.col("item").alias("last"))
    for _ in range(size - 1):
        rows = rows.join(kept, "txn").filter(F.col("item") > F.col("last")).select("txn", F.array_append("items", F.col("item")).alias("items"), F.col("item").alias("last"))
        level = rows.groupBy("items").agg(F.count("*").alias("n")).filter(F.col("n") >= least * total)
        out, rows = out.unionByName(level), rows.join(level.select("items"), "items", "left_semi")
    return out.select(F.array_join("items", ",").alias("itemset"), F.size("items").alias("size"), F.col("n").cast("long").alias("n"), (F.col("n") / total).alias("support"))


def pair_rules(items: DataFrame, least: float) -> DataFrame:
    """Rules between two items with every usual measure; conviction is infinite at confidence 1."""
    total = items.select("txn").distinct().count()
    single = items.groupBy("item").agg(F.count("*").alias("n"))
    a, b = items.toDF("txn", "lhs"), items.toDF("txn", "rhs")
    pairs = a.join(b, "txn").filter("lhs <> rhs").groupBy("lhs", "rhs").agg(F.count("*").alias("n")).filter(F.col("n") >= least * total)
    joined = pairs.join(single.toDF("lhs", "nl"), "lhs").join(single.toDF("rhs", "nr"), "rhs")
    s, sl, sr = F.col("n") / total, F.col("nl") / total, F.col("nr") / total
    conf = F.col("n") / F.col("nl")
    return joined.select(
        "lhs", "rhs", s.alias("support"), conf.alias("confidence"), (conf / sr).alias("lift"), (s - sl * sr).alias("leverage"),
        F.when(F.col("n") == F.col("nl"), F.lit(float("inf"))).otherwise((1 - sr) / (1 - conf)).alias("conviction"),
        (F.col("n") / (F.col("nl") + F.col("nr") - F.col("n"))).alias("jaccard"), (F.col("n") / F.sqrt(F.col("nl").cast("double") * F.col("nr"))).alias("cosine"),
        ((conf + F.col("n") / F.col("nr")) / 2).alias("kulczynski"),
    )


def _larger(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Itemsets with the one-item-smaller subsets of every itemset: n_up is the count of the larger one."""
    own = found.withColumn("items", F.array_sort(F.split("itemset", ",")))
    subsets = own.select(F.explode("items").alias("out"), "items", F.col("n").alias("n_up")).select(F.array_remove("items", F.col("out")).alias("items"), "n_up")
    return own, subsets.groupBy("items").agg(F.max("n_up").alias("n_up"))


def closed(found: DataFrame) -> DataFrame:
    """Of ``supports`` (items without commas), those without a frequent superset of equal count: one more item is enough to look at."""
    own, up = _larger(found)
    return own.join(up, "items", "left").filter(F.col("n_up").isNull() | (F.col("n_up") < F.col("n"))).select(*found.columns)


def maximal(found: DataFrame) -> DataFrame:
    """Of ``supports``, those without any frequent superset."""
    own, up = _larger(found)
    return own.join(up, "items", "left_anti").select(*found.columns)


def rules(found: DataFrame, least: float = 0.0) -> DataFrame:
    """Of ``supports`` (items without commas): lhs (comma-joined), rhs (one item), n, support, confidence, lift; every subset of a frequent set is there to join."""
    sets = found.filter("size > 1").select(F.array_sort(F.split("itemset", ",")).alias("items"), "n", "support")
    split = sets.select(F.explode("items").alias("rhs"), "items", "n", "support").withColumn("lhs", F.array_join(F.array_remove("items", F.col("rhs")), ","))
    names = found.select(F.array_join(F.array_sort(F.split("itemset", ",")), ",").alias("name"), F.col("n").alias("k"), F.col("support").alias("s"))
    both = split.join(names.select(F.col("name").alias("lhs"), F.col("k").alias("nl")), "lhs").join(names.select(F.col("name").alias("rhs"), F.col("s").alias("sr")), "rhs")
    confidence = F.col("n") / F.col("nl")
    return both.filter(confidence >= least).select("lhs", "rhs", "n", "support", confidence.alias("confidence"), (confidence / F.col("sr")).alias("lift"))


def without_redundant(table: DataFrame, tol: float = 1e-12) -> DataFrame:
    """Of ``rules``, those for which no rule of the same rhs and a proper part of the lhs is as confident. Each lhs meets only its own subsets, by name."""
    items = F.split("lhs", ",")
    last = F.call_function("shiftleft", F.lit(1).cast("long"), F.size(items)) - 2
    masks = F.when(F.size(items) > 1, F.sequence(F.lit(1).cast("long"), last))
    part = F.array_join(F.filter(F.transform(F.sequence(F.lit(0), F.size(items) - 1), lambda i: F.when(F.col("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0, F.get(items, i))), lambda v: v.isNotNull()), ",")
    small = table.select("lhs", "rhs", "confidence", F.explode(masks).alias("mask")).select("lhs", "rhs", F.col("confidence").alias("own"), part.alias("part"))
    better = table.select(F.col("lhs").alias("part"), "rhs", F.col("confidence").alias("c"))
    gone = small.join(better, ["part", "rhs"]).filter(F.col("c") >= F.col("own") - tol).select("lhs", "rhs").distinct()
    return table.join(gone, ["lhs", "rhs"], "left_anti").select(*table.columns)


def set_rules(found: DataFrame, least: float = 0.0) -> DataFrame:
    """Of ``supports`` (items without commas): every rule between a set's nonempty proper parts, as lhs, rhs (comma-joined), n, support,
    confidence, lift, leverage, conviction. A set has two to the power of its size less two rules; sets are as small as ``supports`` was asked for."""
    one = F.lit(1).cast("long")
    own = found.filter("size > 1").select(F.array_sort(F.split("itemset", ",")).alias("items"), "n", "support")
    split = own.withColumn("mask", F.explode(F.sequence(one, F.call_function("shiftleft", one, F.size("items")) - 2)))

    def part(inside: bool):
        bit = lambda i: F.col("mask").bitwiseAND(F.call_function("shiftleft", one, i)) != 0
        return F.array_join(F.filter(F.col("items"), lambda _, i: bit(i) if inside else ~bit(i)), ",")

    named = found.select(F.array_join(F.array_sort(F.split("itemset", ",")), ",").alias("name"), F.col("n").alias("k"), F.col("support").alias("s"))
    rules_ = split.select(part(True).alias("lhs"), part(False).alias("rhs"), "n", "support")
    both = rules_.join(named.toDF("lhs", "nl", "sl"), "lhs").join(named.toDF("rhs", "nr", "sr"), "rhs")
    c = F.col("n") / F.col("nl")
    table = both.select("lhs", "rhs", "n", "support", c.alias("confidence"), (c / F.col("sr")).alias("lift"), (F.col("support") - F.col("sl") * F.col("sr")).alias("leverage"), F.when(F.col("n") == F.col("nl"), float("inf")).otherwise((1 - F.col("sr")) / (1 - c)).alias("conviction"))
    return table.filter(F.col("confidence") >= least)


def filtered(table: DataFrame, lhs: str | None = None, rhs: str | None = None, **least: float) -> DataFrame:
    """Rules whose sides hold an item, and whose measures reach ``least`` (as lift=1.2)."""
    for side, item in (("lhs", lhs), ("rhs", rhs)):
        if item is not None:
            table = table.filter(F.array_contains(F.split(side, ","), item))
    for name, low in least.items():
        table = table.filter(F.col(name) >= low)
    return table


def with_improvement(table: DataFrame) -> DataFrame:
    """Adds improvement: confidence less the greatest of rules with the same rhs and a part of the lhs, or less the rhs's share where lhs has one item."""
    one = F.lit(1).cast("long")
    items = F.split("lhs", ",")
    masks = F.when(F.size(items) > 1, F.sequence(one, F.call_function("shiftleft", one, F.size(items)) - 2))
    small = table.select("lhs", "rhs", items.alias("items"), F.explode(masks).alias("mask"))
    small = small.select("lhs", "rhs", F.array_join(F.filter("items", lambda _, i: F.col("mask").bitwiseAND(F.call_function("shiftleft", one, i)) != 0), ",").alias("part"))
    best = small.join(table.select(F.col("lhs").alias("part"), "rhs", F.col("confidence").alias("_c")), ["part", "rhs"]).groupBy("lhs", "rhs").agg(F.max("_c").alias("_best"))
    return table.join(best, ["lhs", "rhs"], "left").select(*[table[c] if c not in ("lhs", "rhs") else F.col(c) for c in table.columns], (F.col("confidence") - F.coalesce("_best", F.col("confidence") / F.col("lift"))).alias("improvement"))


def evaluated(table: DataFrame, items: DataFrame) -> DataFrame:
    """lhs, rhs, new_support, new_confidence: rules (lhs, rhs) counted in other baskets (txn, item). Baskets meet only the sides that share an item with them."""
    total = items.select("txn").distinct().count()

    def counted(sides: DataFrame, name: str) -> DataFrame:
        """``sides``: side, as comma-joined names. How many baskets hold all its items."""
        long = sides.distinct().select("side", F.size(F.split("side", ",")).alias("k"), F.explode(F.split("side", ",")).alias("item"))
        # rules are few: a join by item would bring all baskets of a frequent item to one task
        hold = items.distinct().join(F.broadcast(long), "item").groupBy("side", "k", "txn").agg(F.count("*").alias("h")).filter("h = k")
        return hold.groupBy("side").agg(F.count("*").alias(name))

    whole = table.select("lhs", "rhs", F.array_join(F.array_sort(F.concat(F.split("lhs", ","), F.split("rhs", ","))), ",").alias("side"))
    both = whole.join(counted(whole.select("side"), "_n"), "side", "left").drop("side").withColumn("side", F.col("lhs")).join(counted(table.select(F.col("lhs").alias("side")), "_l"), "side", "left")
    n = F.coalesce("_n", F.lit(0))
    return both.select("lhs", "rhs", (n / total).alias("new_support"), (n / F.col("_l")).alias("new_confidence"))
