"""Settings chosen by folds: models of every fold and setting are fitted together or in turn, and all are scored in one pass.

A fold's rows never teach the model that is scored on them. Errors are summed by fold, so that each table of settings has
its mean and standard error over folds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenstat.operators.inference import Logistic
from lumenstat.operators.margin import tube_loss
from lumenstat.operators.steps import with_numbers
from lumenstat.operators.trees import Tree, adaboost, grow
from lumenstat.operators.validate import Row, path_cv, quadratic


def folds_of(df: DataFrame, fold: str) -> list[int]:
    return sorted(r[0] for r in df.select(fold).distinct().dropna().collect())


def by_fold(df: DataFrame, fold: str, settings: list[float], models: dict[tuple[int, float], Column], loss: Callable[[Column], Column]) -> list[Row]:
    """(setting, mean loss over folds, standard error): ``models`` has a column for each fold and setting; one aggregation for all of them."""
    folds = sorted({f for f, _ in models})
    sums = []
    for i, s in enumerate(settings):
        model = F.lit(None)
        for f in folds:
            model = F.when(F.col(fold) == f, models[f, s]).otherwise(model)
        sums.append(F.avg(loss(model)).alias(f"e{i}"))
    rows = df.filter(F.col(fold).isin(folds)).groupBy(fold).agg(*sums).collect()
    e = np.array([[r[f"e{i}"] for i in range(len(settings))] for r in sorted(rows, key=lambda r: r[fold])], float)
    return [(float(s), float(e[:, i].mean()), float(e[:, i].std(ddof=1) / np.sqrt(len(e))) if len(e) > 1 else 0.0) for i, s in enumerate(settings)]


def truncated(tree: Tree, depth: int) -> Tree:
    """The tree cut off below ``depth`` levels of splits: grown level by level, it is the tree of that depth."""
    return Tree({i: s for i, s in tree.splits.items() if i.bit_length() <= depth}, tree.values)


def tree_depth_cv(df: DataFrame, cuts: dict[str, list[float]], y: str, fold: str, most: int = 4, min_leaf: float = 5) -> list[Row]:
    """Squared error by depth, 0 to ``most``: one tree a fold, of which each depth is a part."""
    data = df.dropna(subset=[*cuts, y])
    models = {}
    for f in folds_of(data, fold):
        tree = grow(data.filter(F.col(fold) != f), cuts, y, most, min_leaf)
        models |= {(f, float(d)): truncated(tree, d).predict() for d in range(most + 1)}
    return by_fold(data, fold, [float(d) for d in range(most + 1)], models, lambda m: F.pow(F.col(y) - m, F.lit(2)))


def boosting_cv(df: DataFrame, cuts: dict[str, list[float]], y: str, fold: str, rounds: int = 10, rate: float = 0.3, depth: int = 1, every: int = 4) -> list[Row]:
    """Squared error by round, 0 to ``rounds``. A fold's sum so far is a column, written anew every few rounds, so that no round
    evaluates all trees again; rows of the fold itself carry it too, and give its error at each round."""
    data = df.dropna(subset=[*cuts, y]).select(*cuts, F.col(y).cast("double").alias(y), fold)
    errors = []
    for f in folds_of(data, fold):
        mean = data.filter(F.col(fold) != f).agg(F.avg(y)).first()[0]
        own = data.withColumn("_s", F.lit(float(mean)))
        one = []
        for r in range(rounds + 1):
            one.append(own.filter(F.col(fold) == f).agg(F.avg(F.pow(F.col(y) - F.col("_s"), F.lit(2)))).first()[0])
            if r < rounds:
                tree = grow(own.filter(F.col(fold) != f).withColumn("_r", F.col(y) - F.col("_s")), cuts, "_r", depth)
                own = own.withColumn("_s", F.col("_s") + rate * tree.predict())
                if r % every == every - 1:
                    own = cut_lineage(own)
        errors.append(one)
    e = np.array(errors, float)
    return [(float(r), float(e[:, r].mean()), float(e[:, r].std(ddof=1) / np.sqrt(len(e)))) for r in range(rounds + 1)]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpointed where the session names a folder for it; else as it is."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() or df.sparkSession.conf.get("spark.checkpoint.dir", None) else df


def adaboost_cv(df: DataFrame, cuts: dict[str, list[float]], y: str, fold: str, rounds: int = 8) -> list[Row]:
    """Share of wrong signs by round, 1 to ``rounds``, y in {-1, 1}: one sequence a fold, of which each round's vote is a part."""
    data = df.dropna(subset=[*cuts, y])
    models = {}
    for f in folds_of(data, fold):
        stumps, _ = adaboost(data.filter(F.col(fold) != f), cuts, y, rounds)
        vote = F.lit(0.0)
        for r in range(rounds):
            if r < len(stumps):
                name, cut, sign, _, alpha = stumps[r]
                vote = vote + F.when(F.col(name) <= cut, alpha * sign).otherwise(-alpha * sign)
            models[f, float(r + 1)] = vote
    return by_fold(data, fold, [float(r + 1) for r in range(rounds)], models, lambda m: F.when(F.when(m >= 0, 1).otherwise(-1) == F.col(y), 0.0).otherwise(1.0))


def margin_cv(df: DataFrame, x: list[str], y: str, fold: str, costs: list[float], epsilon: float | None = None, rate: float = 0.01, steps: int = 100, decay: float = 1e-4) -> list[Row]:
    """(cost, mean error over folds, standard error) of linear support vector machines, all folds and costs in one aggregation a step.

    Without ``epsilon``: classification, y in {-1, 1}, share of wrong signs. With it: regression, mean loss outside the tube.
    The objective is half of |w|^2 plus cost times the mean loss, lowered by batch subgradients from zero (regression: from the mean of y)."""
    data = df.dropna(subset=[*x, y, fold]).select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(x)], F.col(y).cast("double").alias("_y"), F.col(fold).cast("int").alias("_f"))
    sizes = {r["_f"]: (r["n"], r["m"]) for r in data.groupBy("_f").agg(F.count("*").alias("n"), F.avg("_y").alias("m")).collect()}
    folds, k = sorted(sizes), len(x) + 1
    total, grand = sum(n for n, _ in sizes.values()), sum(n * m for n, m in sizes.values())
    pairs = [(f, c) for f in folds for c in costs]
    w = np.zeros((len(pairs), k))
    if epsilon is not None:
        w[:, -1] = [(grand - sizes[f][0] * sizes[f][1]) / max(total - sizes[f][0], 1) for f, _ in pairs]

    def score(p: int) -> Column:
        return sum((F.col("_p")[p * k + i] * F.col(f"_x{i}") for i in range(len(x))), F.col("_p")[p * k + k - 1])

    sums = []
    for p, (f, _) in enumerate(pairs):
        if epsilon is None:
            side = F.when(F.col("_y") * score(p) < 1, F.col("_y")).otherwise(0.0)
        else:
            r = F.col("_y") - score(p)
            side = F.when(r > epsilon, 1.0).when(r < -epsilon, -1.0).otherwise(0.0)
        side = F.when(F.col("_f") == f, 0.0).otherwise(side)
        sums += [F.sum(side * F.col(f"_x{i}")).alias(f"g{p}_{i}") for i in range(len(x))] + [F.sum(side).alias(f"g{p}_{k - 1}")]
    for t in range(steps if folds else 0):
        row, step = with_numbers(data, w.ravel()).agg(*sums).first(), rate / (1 + decay * t)
        for p, (f, c) in enumerate(pairs):
            pull = np.array([row[f"g{p}_{i}"] or 0.0 for i in range(k)]) * c / max(total - sizes[f][0], 1)
            w[p, :-1] += step * (pull[:-1] - w[p, :-1])
            w[p, -1] += step * pull[-1]
    wrong = lambda p: F.when(F.when(score(p) >= 0, 1.0).otherwise(-1.0) == F.col("_y"), 0.0).otherwise(1.0) if epsilon is None else tube_loss(F.col("_y") - score(p), epsilon)
    got = with_numbers(data, w.ravel()).agg(*[F.avg(F.when(F.col("_f") == f, wrong(p))).alias(f"e{p}") for p, (f, _) in enumerate(pairs)]).first() if pairs else None
    out = []
    for j, c in enumerate(costs):
        e = np.array([got[f"e{i * len(costs) + j}"] for i in range(len(folds))], float) if folds else np.zeros(0)
        out.append((float(c), float(e.mean()) if len(e) else float("nan"), float(e.std(ddof=1) / np.sqrt(len(e))) if len(e) > 1 else 0.0))
    return out


def _centroids(cells: dict, folds: list, labels: list, left_out: object, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, means and centred squares of each class, (classes), (classes, dim) twice, of all folds but one."""
    n, total, square = np.zeros(len(labels)), np.zeros((len(labels), dim)), np.zeros((len(labels), dim))
    for (f, label), (m, s, q) in cells.items():
        if f != left_out:
            k = labels.index(label)
            n[k], total[k], square[k] = n[k] + m, total[k] + s, square[k] + q
    mean = total / np.maximum(n, 1)[:, None]
    return n, mean, np.maximum(square - n[:, None] * mean**2, 0)


def shrunken_cv(df: DataFrame, label: str, vec: str, fold: str, thresholds: list[float], offset: bool = True) -> list[tuple[float, int, int, float]]:
    """(threshold, rows, rows wrong, components in use on average over folds) of nearest shrunken centroids; threshold 0 without the
    offset of the deviations is the diagonal discriminant. One aggregation by fold and class, one to score all folds and thresholds.

    The centroids of all folds reach each row as one small array by fold: folds x thresholds x classes x components numbers.
    Vectors of the commonest length take part."""
    data = df.select(F.col(label).alias("_l"), F.col(vec).cast("array<double>").alias("_v"), F.col(fold).cast("int").alias("_f")).dropna()
    dims = data.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return [(float(t), 0, 0, 0.0) for t in thresholds]
    dim = dims["d"]
    data = data.filter(F.size("_v") == dim)
    parts = data.select("_f", "_l", F.posexplode("_v").alias("i", "x")).groupBy("_f", "_l", "i").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    cells: dict = {}
    for r in parts.collect():  # folds x classes x components rows
        at = cells.setdefault((r["_f"], r["_l"]), [0.0, np.zeros(dim), np.zeros(dim)])
        at[0], at[1][r["i"]], at[2][r["i"]] = float(r["n"]), r["s"], r["q"]
    folds, labels = sorted({f for f, _ in cells}), sorted({c for _, c in cells})
    rows, active = [], np.zeros((len(folds), len(thresholds)))
    for a, f in enumerate(folds):
        n, mean, square = _centroids(cells, folds, labels, f, dim)
        some = n > 0
        total = n.sum()
        if not total:
            continue
        middle = (n[:, None] * mean).sum(0) / total
        s = np.sqrt(square.sum(0) / max(total - some.sum(), 1))
        spread = s + (np.median(s) if offset else 0.0)
        scale = np.sqrt(np.maximum(1 / np.maximum(n, 1) - 1 / total, 1e-300))[:, None] * spread
        d = (mean - middle) / np.where(scale > 0, scale, 1.0)
        for b, t in enumerate(thresholds):
            less = np.sign(d) * np.maximum(np.abs(d) - t, 0)
            active[a, b] = (less[some] != 0).any(0).sum()
            for k, c in enumerate(labels):
                if some[k]:
                    centre = middle + scale[k] * less[k]
                    rows.append((f, b, c, centre.tolist(), (1 / np.maximum(spread, 1e-300) ** 2).tolist(), float(-2 * np.log(n[k] / total))))
    kind = data.schema["_l"].dataType.simpleString()
    model = data.sparkSession.createDataFrame(rows, f"_f int, t int, l {kind}, c array<double>, w array<double>, shift double")
    model = model.groupBy("_f").agg(F.collect_list(F.struct("t", "l", "c", "w", "shift")).alias("_m"))
    joined = data.join(F.broadcast(model), "_f")  # a row a fold

    def predicted(t: int) -> Column:
        own = F.filter("_m", lambda m: m["t"] == t)
        far = F.transform(own, lambda m: F.struct(F.round(m["shift"] + F.aggregate(F.zip_with(F.zip_with("_v", m["c"], lambda x, c: (x - c) * (x - c)), m["w"], lambda e, w: e * w), F.lit(0.0), lambda acc, e: acc + e), 9).alias("d"), m["l"].alias("l")))
        return F.array_min(far)["l"]

    got = joined.agg(F.count("*").alias("n"), *[F.sum(F.when(predicted(b) == F.col("_l"), 0).otherwise(1)).alias(f"w{b}") for b in range(len(thresholds))]).first()
    return [(float(t), int(got["n"]), int(got[f"w{b}"] or 0), float(active[:, b].mean())) for b, t in enumerate(thresholds)]


def basis_cv(df: DataFrame, bases: dict[float, list[Column]], y: str, fold: str, lam: float = 0.0, penalty: Callable[[int], np.ndarray] | None = None) -> list[Row]:
    """Squared error by setting, where each setting has a basis of its own (knots, degree): products of a basis by fold, one aggregation a setting."""
    out = []
    for s, basis in bases.items():
        names = [f"_b{i}" for i in range(len(basis))]
        data = df.select(F.col(y).cast("double").alias("_y"), F.col(fold).alias("_fold"), *[b.alias(n) for b, n in zip(basis, names, strict=True)]).dropna()
        out += [(float(s), e, se) for _, e, se in path_cv(data, names, "_y", "_fold", [lam], quadratic(penalty(len(basis)) if penalty else np.eye(len(basis))), scale=False)]
    return out


def logistic_basis_cv(df: DataFrame, bases: dict[float, list[Column]], y: str, fold: str, penalty: float = 1e-4) -> list[Row]:
    """Deviance a row by setting of logistic regressions on bases (the first column of each is the constant's), all folds scored in one pass."""
    folds, settings, models, data = folds_of(df, fold), [float(s) for s in bases], {}, df.dropna(subset=[y, fold])
    for s, basis in bases.items():
        names = [f"_s{float(s):g}_{i}".replace(".", "_").replace("-", "m") for i in range(1, len(basis))]
        data = data.withColumns(dict(zip(names, basis[1:], strict=True)))
        for f in folds:
            models[f, float(s)] = Logistic(data.filter(F.col(fold) != f), names, y, penalty=penalty).probability()
    clipped = lambda p: F.greatest(F.least(p, F.lit(1 - 1e-12)), F.lit(1e-12))
    return by_fold(data, fold, settings, models, lambda p: -2 * (F.col(y) * F.log(clipped(p)) + (1 - F.col(y)) * F.log(1 - clipped(p))))
