"""Exact order statistics of groups of any size, under any number of row weights at once.

A long group is cut into ranges by an approximate sketch; the weights of the ranges tell in which range each wanted rank lies,
and only those ranges are kept, their equal values counted as one row, and cut again until they are short. These are sorted,
each in a task of its own. So no group is held, moved or sorted whole, and the result is exact whatever the sketch said. Weights may be counts of a bootstrap draw: the ranks are then those of the drawn rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenstat.functions.distributions import normal_cdf, quantile
from lumenstat.operators.resample import poisson_copies

RANGE_ROWS = 1_000_000  # distinct values of one range, as an aim
CUTS = 64  # ranges that one is cut into at a time, a power of two
FEW = 5_000  # ranges whose bounds are sent to every task


def _of(rows: DataFrame, table: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """``rows`` with the other columns of ``table`` (a row of each group or range); a table of few rows goes to every task."""
    named = table.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in table.columns if c not in keys])
    return rows.join(F.broadcast(named) if few else named, _same(keys)).drop(*[f"_k_{k}" for k in keys])


def _inside(before: Column, size: Column) -> Callable[[Column], Column]:
    """A rank of the whole, as one of the part that follows ``before`` rows; null if it is not there."""
    return lambda k: F.when((k >= before) & (k < before + size), k - before)


def _narrowed(rows: DataFrame, asked: DataFrame, by: list[str], w: list[str], range_rows: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (by, _range, _v, weights), equal values as one, of ranges with ``range_rows`` values as an aim, and the ranks wanted of each.

    Each turn cuts every longer range into CUTS, so that a row meets few bounds, and keeps those that hold a wanted rank.
    """
    keys, last, held = [*by, "_range"], math.inf, None
    wanted = F.exists("_want", lambda a: F.exists(a, lambda k: k.isNotNull()))
    count = rows.groupBy(*keys, "_v").agg(*[F.sum(n).alias(n) for n in w])
    while True:
        most, ranges = asked.agg(F.max("_n"), F.count("*")).first()
        if (most or 0) <= range_rows or most >= last:  # no shorter: one value may fill a range, which counting makes short
            return (count if held is None else held), asked.select(*keys, "_want")
        few, last = ranges <= FEW, most
        marks = F.percentile_approx("_v", F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)]), F.lit(20 * CUTS))
        inside = rows if held is None else held
        bounds = inside.groupBy(*keys).agg(marks.alias("_bounds"), F.count("*").alias("_rows")).select(*keys, F.when(F.col("_rows") > range_rows, F.col("_bounds")).alias("_bounds")).persist()
        halves = F.array(*[F.lit(CUTS >> i) for i in range(1, CUTS.bit_length())])
        below = F.aggregate(halves, F.lit(0), lambda at, step: at + F.when(F.get("_bounds", at + step - 1) < F.col("_v"), step).otherwise(0))  # how many bounds lie below
        dealt = _of(inside, bounds, keys, few).withColumn("_sub", below).drop("_bounds")
        before = Window.partitionBy(*keys).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
        sizes = dealt.groupBy(*keys, "_sub").agg(*[F.sum(n).alias(n) for n in w]).select(*keys, "_sub", *w, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_s{n}") for n in w])
        here = [F.transform(F.col("_want")[r], _inside(F.col(f"_s{n}"), F.col(n))) for r, n in enumerate(w)]
        kept = _of(sizes, asked.select(*keys, "_want"), keys, few).select(*keys, "_sub", F.array(*here).alias("_want")).filter(wanted).persist()
        deeper = (F.col("_range") * CUTS + F.col("_sub")).alias("_range")
        left = _of(dealt, kept.select(*keys, "_sub"), [*keys, "_sub"], few).select(*by, deeper, "_v", *w).groupBy(*keys, "_v").agg(*[F.sum(n).alias(n) for n in w]).persist()
        asked = _of(left.groupBy(*keys).agg(F.count("*").alias("_n")), kept.select(*by, deeper, "_want"), keys, few).persist()
        asked.count()  # holds ``left`` too: what it came from can go
        for t in (bounds, kept, *([held] if held is not None else [])):
            t.unpersist()
        held = left


def order_statistics(df: DataFrame, value: str, ranks: Callable[[Column], list[Column]], by: list[str] | None = None, weights: list[Column] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """by, _total, _at (arrays by weight; of _at by wanted rank): the values at the ranks (from 0) that ``ranks`` gives for a
    total weight; null where a total holds no such rank. Weights are whole numbers, rows with a null value are left out."""
    by, weights = by or [], weights or [F.lit(1)]
    w = [f"_w{r}" for r in range(len(weights))]
    keys, zero = [*by, "_range"], F.lit(0).cast("long")
    rows = df.filter(F.col(value).isNotNull()).select(*by, zero.alias("_range"), F.col(value).alias("_v"), *[c.cast("long").alias(n) for c, n in zip(weights, w, strict=True)])
    sums = rows.groupBy(*by).agg(*[F.sum(n).alias(n) for n in w], F.count("*").alias("_n"))
    wanted = [F.array(*[F.when((k >= 0) & (k < F.col(n)), k.cast("long")) for k in ranks(F.col(n))]) for n in w]
    asked = sums.select(*by, zero.alias("_range"), F.array(*w).alias("_total"), F.array(*wanted).alias("_want"), "_n").persist()
    total, count = asked.select(*by, "_total"), len(ranks(F.lit(1)))
    counted, want = _narrowed(rows, asked.drop("_total"), by, w, range_rows)
    inner = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    run = _of(counted, want, keys, False).select(*keys, "_v", "_want", *[F.sum(n).over(inner).alias(n) for n in w])
    found = run.groupBy(*keys).agg(*[F.min(F.when(F.col(n) > F.col("_want")[r][j], F.col("_v"))).alias(f"_f{r}_{j}") for r, n in enumerate(w) for j in range(count)])
    first = found.groupBy(*by).agg(*[F.max(f"_f{r}_{j}").alias(f"_f{r}_{j}") for r in range(len(w)) for j in range(count)])
    at = F.array(*[F.array(*[F.col(f"_f{r}_{j}") for j in range(count)]) for r in range(len(w))]).alias("_at")
    if not by:
        return total.crossJoin(F.broadcast(first)).select("_total", at)  # one row each
    keyed = first.select(*[F.col(k).alias(f"_k_{k}") for k in by], at)
    return total.join(keyed, _same(by), "left").select(*by, "_total", "_at")


def _same(keys: list[str]) -> Column:
    """Group keys may be null: null is a group of its own."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return out


def exact_quantiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """by, and a column for each named share: quantiles by linear interpolation between the two order statistics about (n - 1) share."""

    def ranks(total: Column) -> list[Column]:
        return [f((total - 1) * float(p)) for p in shares.values() for f in (F.floor, F.ceil)]

    found = order_statistics(df, value, ranks, by, None, range_rows)
    return found.select(*(by or []), *[_between(F.col("_at")[0], 2 * j, (F.col("_total")[0] - 1) * float(p)).alias(n) for j, (n, p) in enumerate(shares.items())])


def _between(at: Column, j: int, place: Column) -> Column:
    low, high = at[j].cast("double"), at[j + 1].cast("double")
    return low + (place - F.floor(place)) * (high - low)


def bootstrap_quantiles(df: DataFrame, key: str, value: str, share: float, replicates: int, by: list[str] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """by, replicate, n, quantile of the rows drawn in each replicate: one counted pass for all replicates, no row is repeated or sorted anew."""
    place = lambda total: (total - 1) * float(share)
    found = order_statistics(df.filter(F.col(key).isNotNull()), value, lambda t: [F.floor(place(t)), F.ceil(place(t))], by, [poisson_copies(key, r) for r in range(replicates)], range_rows)
    each = [F.struct(F.lit(r).cast("long").alias("replicate"), F.col("_total")[r].alias("n"), _between(F.col("_at")[r], 0, place(F.col("_total")[r])).alias("quantile")) for r in range(replicates)]
    return found.select(*(by or []), F.inline(F.array(*each)))


Statistic = Callable[[Column], Column]  # row weight: an aggregate


def bootstrap(df: DataFrame, key: str, statistics: dict[str, Statistic], replicates: int, by: list[str] | None = None) -> DataFrame:
    """by, replicate, and each statistic under the row weights of the replicate: any aggregate that takes weights, as weighted
    means, ratios, correlations or counts, for all replicates in one aggregation. Order statistics: ``bootstrap_quantiles``."""
    sums = [s(poisson_copies(key, r)).alias(f"{name}|{r}") for r in range(replicates) for name, s in statistics.items()]
    data = df.filter(F.col(key).isNotNull())
    row = (data.groupBy(*by) if by else data.groupBy()).agg(*sums)
    each = [F.struct(F.lit(r).cast("long").alias("replicate"), *[F.col(f"`{name}|{r}`").alias(name) for name in statistics]) for r in range(replicates)]
    return row.select(*(by or []), F.inline(F.array(*each)))


def bootstrap_report(draws: DataFrame, observed: DataFrame, statistic: str, level: float = 0.95) -> DataFrame:
    """observed, mean, se, bias, corrected, and percentile, basic and normal intervals. ``draws`` holds a replicate a row, ``observed`` one row."""
    a = (1 - level) / 2
    q = draws.agg(F.avg(statistic).alias("mean"), F.stddev_samp(statistic).alias("se"), F.percentile(statistic, a).alias("_l"), F.percentile(statistic, 1 - a).alias("_h"))
    z = quantile(normal_cdf, 1 - a)
    o = F.col("observed")
    both = q.crossJoin(F.broadcast(observed.select(F.col(statistic).cast("double").alias("observed"))))  # one row each
    return both.select("observed", "mean", "se", (F.col("mean") - o).alias("bias"), (2 * o - F.col("mean")).alias("corrected"), F.col("_l").alias("percentile_low"), F.col("_h").alias("percentile_high"),
                       (2 * o - F.col("_h")).alias("basic_low"), (2 * o - F.col("_l")).alias("basic_high"), (o - z * F.col("se")).alias("normal_low"), (o + z * F.col("se")).alias("normal_high"))

