"""Bump hunting: boxes with a high mean, by peeling off tails, pasting rows back, and covering one bump after another."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenstat.operators.quantiles import exact_quantiles, order_statistics

Box = dict[str, tuple[float, float]]


def inside(box: Box) -> Column:
    out = F.lit(True)
    for x, (lo, hi) in box.items():
        out = out & (F.col(x) >= lo) & (F.col(x) <= hi)
    return out


def box_statistics(df: DataFrame, y: str, box: Box) -> DataFrame:
    """n, support (share of all rows), mean and median of y inside; null where the box is empty."""
    y_in = F.when(inside(box), F.col(y))
    found = df.agg(F.count(y_in).alias("n"), (F.count(y_in) / F.count(y)).alias("support"), F.avg(y_in).alias("mean"))
    middle = exact_quantiles(df.select(y_in.alias("_y")), "_y", {"median": 0.5})
    return found.crossJoin(F.broadcast(middle.agg(F.first("median").alias("median"))))  # one row each


def peel(df: DataFrame, x: list[str], y: str, alpha: float = 0.05, least: float = 0.10, steps: int = 100) -> list[tuple[str, str, float, float, float]]:
    """(variable, side, cut, support, mean) of each peel: of all tails beyond the alpha quantile, the one that leaves the
    highest mean while support stays at ``least`` of all rows; ends when the mean does not rise. Two aggregations a step."""
    df = df.dropna(subset=[*x, y])
    first = df.agg(F.count("*").alias("n"), F.avg(y).alias("mean"), *[f(c).alias(f"{f.__name__}_{c}") for c in x for f in (F.min, F.max)]).first()
    box: Box = {c: (first[f"min_{c}"], first[f"max_{c}"]) for c in x}
    path, mean = [], first["mean"]
    for _ in range(steps if first["n"] else 0):
        now = df.filter(inside(box))
        q = now.agg(*[F.percentile(c, F.array(F.lit(alpha), F.lit(1 - alpha))).alias(c) for c in x]).first()
        tails = [(c, side, q[c][k], F.col(c) >= q[c][k] if side == "low" else F.col(c) <= q[c][k]) for c in x for k, side in enumerate(("low", "high"))]
        # a quantile that is the edge itself cuts nothing off: there the rows at the edge go
        tails = [(c, s, v, F.col(c) > v if s == "low" and v <= box[c][0] else F.col(c) < v if s == "high" and v >= box[c][1] else keep) for c, s, v, keep in tails]
        ends = [F.min(F.when(k, F.col(c))) if s == "low" else F.max(F.when(k, F.col(c))) for c, s, _, k in tails]
        got = now.agg(*[f.alias(f"{n}{i}") for i, (t, e) in enumerate(zip(tails, ends, strict=True)) for n, f in (("n", F.count_if(t[3])), ("m", F.avg(F.when(t[3], F.col(y)))), ("e", e))]).first()
        able = [i for i in range(len(tails)) if got[f"n{i}"] and got[f"n{i}"] >= least * first["n"]]
        if not able or max(got[f"m{i}"] for i in able) <= mean:
            break
        i = max(able, key=lambda k: (got[f"m{k}"], -k))
        c, side, _, _ = tails[i]
        lo, hi = box[c]
        box[c] = (got[f"e{i}"], hi) if side == "low" else (lo, got[f"e{i}"])
        mean = got[f"m{i}"]
        path.append((c, side, float(got[f"e{i}"]), got[f"n{i}"] / first["n"], float(mean)))
    return path


def whole_box(df: DataFrame, x: list[str]) -> Box:
    """Least and greatest value of every column."""
    row = df.agg(*[f(c).alias(f"{s}_{c}") for c in x for s, f in (("low", F.min), ("high", F.max))]).first()
    return {c: (row[f"low_{c}"], row[f"high_{c}"]) for c in x}


def boxes_along(start: Box, path: list[tuple]) -> list[Box]:
    """The box after each peel or paste of ``path`` (variable, side, cut, ...), the start first."""
    out = [dict(start)]
    for c, side, cut, *_ in path:
        low, high = out[-1][c]
        out.append({**out[-1], c: (cut, high) if side == "low" else (low, cut)})
    return out


def _beyond(box: Box, c: str, side: str) -> Column:
    """Rows outside one side of the box and inside all others."""
    low, high = box[c]
    return inside({k: v for k, v in box.items() if k != c}) & (F.col(c) < low if side == "low" else F.col(c) > high)


def paste_sides(df: DataFrame, x: list[str], y: str, box: Box, alpha: float = 0.05) -> list[tuple[str, str, float, int, float]]:
    """(variable, side, cut, n, mean) of the box grown on each side where rows lie beyond it: to the nearest value that takes in
    ``alpha`` of the box's rows, or to the last. The rows beyond are counted by value, ranked by exact order statistics."""
    df = df.dropna(subset=[*x, y])
    base = df.filter(inside(box)).agg(F.count("*").alias("n"), F.sum(y).alias("s")).first()
    need = max(1, math.ceil(alpha * base["n"] - 1e-9))
    near = [df.filter(_beyond(box, c, side)).select(F.lit(f"{side} {c}").alias("_side"), (F.col(c) if side == "high" else -F.col(c)).cast("double").alias("_at"), F.col(y).cast("double").alias("_y")) for c in x for side in ("low", "high")]
    rows = reduce(DataFrame.unionByName, near)
    cuts = order_statistics(rows, "_at", lambda total: [F.least(F.lit(need), total) - 1], ["_side"]).select(F.col("_side").alias("_s"), F.col("_at")[0][0].alias("_cut"))
    taken = rows.join(F.broadcast(cuts), (F.col("_side") == F.col("_s")) & (F.col("_at") <= F.col("_cut")))  # a row a side of the box
    out = []
    for r in taken.groupBy("_side").agg(F.first("_cut").alias("cut"), F.count("*").alias("n"), F.sum("_y").alias("s")).collect():
        side, c = r["_side"].split(" ", 1)
        n = base["n"] + r["n"]
        out.append((c, side, float(r["cut"] if side == "high" else -r["cut"]), int(n), float(((base["s"] or 0.0) + r["s"]) / n)))
    return sorted(out, key=lambda t: (x.index(t[0]), t[1] == "high"))


def paste(df: DataFrame, x: list[str], y: str, box: Box, alpha: float = 0.05, steps: int = 100) -> list[tuple[str, str, float, float, float]]:
    """(variable, side, cut, support, mean) of each paste: the side whose growth leaves the highest mean, while the mean rises."""
    df = df.dropna(subset=[*x, y])
    first = df.agg(F.count("*").alias("n"), F.avg(F.when(inside(box), F.col(y))).alias("mean")).first()
    path, mean, box = [], first["mean"], dict(box)
    for _ in range(steps if first["n"] else 0):
        able = paste_sides(df, x, y, box, alpha)
        if not able or mean is None or max(t[4] for t in able) <= mean:
            break
        c, side, cut, n, mean = max(able, key=lambda t: (t[4], t[3]))
        low, high = box[c]
        box[c] = (cut, high) if side == "low" else (low, cut)
        path.append((c, side, cut, n / first["n"], mean))
    return path


def chosen_box(valid: DataFrame, y: str, boxes: list[Box], least: float = 0.05) -> tuple[int, float, float]:
    """(place, support, mean) of the box with the highest mean on other rows, among those with a support of ``least``: one aggregation for all."""
    row = valid.filter(F.col(y).isNotNull()).agg(F.count("*").alias("n"), *[a.alias(f"{n}{i}") for i, b in enumerate(boxes) for n, a in (("c", F.count_if(inside(b))), ("m", F.avg(F.when(inside(b), F.col(y)))))]).first()
    able = [i for i in range(len(boxes)) if row["n"] and row[f"c{i}"] and row[f"c{i}"] >= least * row["n"]]
    if not able:
        return -1, 0.0, float("nan")
    i = max(able, key=lambda k: (row[f"m{k}"], row[f"c{k}"], -k))
    return i, row[f"c{i}"] / row["n"], float(row[f"m{i}"])


def cover(train: DataFrame, valid: DataFrame, x: list[str], y: str, bumps: int = 2, alpha: float = 0.05, least: float = 0.05) -> list[tuple[Box, float, float]]:
    """(box, support, mean on the validation rows) of one bump after another: peeled on the training rows, chosen on the validation
    rows, grown by pasting, and taken out of both before the next. Ends when no box beats the mean of the rows left."""
    out: list[tuple[Box, float, float]] = []
    for _ in range(bumps):
        start = whole_box(train.dropna(subset=[*x, y]), x)
        if any(v is None for v, _ in start.values()):
            break
        boxes = boxes_along(start, peel(train, x, y, alpha, least))
        at, _, _ = chosen_box(valid, y, boxes, least)
        if at < 1:
            break
        grown = boxes_along(boxes[at], paste(train, x, y, boxes[at], alpha))
        best, support, mean = chosen_box(valid, y, grown, least)
        box = grown[max(best, 0)]
        out.append((box, support, mean))
        train, valid = train.filter(~inside(box)), valid.filter(~inside(box))
    return out


def box_rules(box: Box, start: Box) -> list[str]:
    """The box in words: a condition for each side that cuts something off, by variable."""
    return [f"{c} {sign} {cut:g}" for c, (low, high) in box.items() for sign, cut, edge in ((">=", low, start[c][0]), ("<=", high, start[c][1])) if cut != edge]


def overlap(df: DataFrame, box: Box, truth: Column) -> DataFrame:
    """precision, recall, jaccard of the rows of a box against those where ``truth`` holds; null where there is nothing to divide by."""
    both, either = F.count_if(inside(box) & truth), F.count_if(inside(box) | truth)
    share = lambda a, b: F.when(b > 0, a / b)
    return df.agg(share(both, F.count_if(inside(box))).alias("precision"), share(both, F.count_if(truth)).alias("recall"), share(both, either).alias("jaccard"))


def best_threshold(df: DataFrame, x: list[str], y: str, least: float = 0.1) -> tuple[str, str, float, float, float] | None:
    """(variable, side, cut, support, mean) of the best one-sided box with a support of ``least``: counted by value, running sums over them."""
    found = []
    for c in x:
        data = df.dropna(subset=[c, y])
        by = data.groupBy(F.col(c).cast("double").alias("v")).agg(F.count("*").alias("n"), F.sum(y).alias("s"))
        total = by.agg(F.sum("n").alias("n")).first()["n"] or 0
        for side in ("low", "high"):
            ranges = _running(by, side == "low")
            row = ranges.filter(F.col("cn") >= least * total).orderBy(F.desc(F.col("cs") / F.col("cn")), F.desc("cn")).first() if total else None
            if row:
                found.append((c, side, float(row["v"]), row["cn"] / total, row["cs"] / row["cn"]))
    return max(found, key=lambda t: (t[4], t[3])) if found else None


def _running(by: DataFrame, down: bool, blocks: int = 64) -> DataFrame:
    """``by`` (v, n, s) with cn and cs, sums from the least value up, or from the greatest down: within ranges of values, and of ranges before."""
    marks = by.agg(F.percentile_approx("v", F.array(*[F.lit(i / blocks) for i in range(1, blocks)]), F.lit(1000)).alias("b")).first()["b"] or []
    cuts = F.array(*[F.lit(float(b)) for b in sorted(set(marks))])
    at = F.size(F.filter(cuts, lambda b: b < F.col("v")))
    dealt = by.withColumn("_b", -at if down else at)
    sizes = dealt.groupBy("_b").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # ``blocks`` rows
    starts = sizes.select("_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("_s"))
    inner = Window.partitionBy("_b").orderBy(F.desc("v") if down else "v").rowsBetween(Window.unboundedPreceding, 0)
    run = dealt.withColumns({"_rn": F.sum("n").over(inner), "_rs": F.sum("s").over(inner)})
    return run.join(F.broadcast(starts), "_b").select("v", (F.col("_n") + F.col("_rn")).alias("cn"), (F.col("_s") + F.col("_rs")).alias("cs"))
