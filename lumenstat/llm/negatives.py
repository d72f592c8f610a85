"""Operator 12: hard-negative mining by product quantisation with residual norms.

Vectors become whole numbers, floor(256 x). Each is cut into short subspaces and coded by its nearest centres; the
length of what the centres leave, the residual norm, is stored with the code. An anchor's table of inner products with
the centres gives every row's score by looking up its codes, and by Cauchy and Schwarz the true score lies within the
anchor's length times the residual norm of that. The bounds filter rigorously: a row is left out only where they show
that it cannot be among the first, or cannot lie in the window. All that remain are ranked by exact whole numbers.

There are two passes over blocks of rows, each block meeting sets of anchors. The first gives each anchor its first
POSITIVES rows of the same label. The second gives each anchor and positive the first NEGATIVES rows of other labels
whose score lies between LOW and HIGH hundredths of the positive's. A block yields its own first rows, which are
merged by exact score. Every anchor meets every block: with anchors a fixed share of the rows the work grows with the
square of the table.

The centres are fitted on a bounded sample (FIT_ROWS rows, by hash of the id); they change the work alone, never the
result. Rows with a null id, label or vector, or with null or non-finite components, take no part, nor do empty vectors
and those of another length than the commonest. Rows that repeat an id are rows of their own, anchors and positives
too; ties go to the smaller id. Vectors of zeros take part. Scores are exact in 64 bits; those
beyond count as the largest or least long. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenstat.llm.shared import Scratch, mapped

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # hundredths of the positive's score
FIT_ROWS = 4096
CENTRES, WIDTH = 256, 4  # of a subspace
BLOCK_ROWS, ANCHOR_ROWS = 8192, 2048
TOGETHER = 32  # anchors whose tables are scanned at once
EXACT = float(1 << 53)
SLACK = 1e-9  # of the lengths, for rounding in the bounds


def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 x), as doubles that hold whole numbers."""
    with np.errstate(over="ignore"):
        return np.floor(256 * x)


class Quantiser:
    """Centres of each subspace, (subspaces, CENTRES, WIDTH)."""

    def __init__(self, dim: int) -> None:
        self.dim, self.parts = dim, -(-dim // WIDTH)

    def cut(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.parts * WIDTH - self.dim))).reshape(len(x), self.parts, WIDTH)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Nearest centres of cut vectors, (rows, subspaces)."""
        out = np.empty((len(x), self.parts), np.uint8)
        for s in range(self.parts):
            c = self.centres[s]
            out[:, s] = ((c**2).sum(1) - 2 * x[:, s] @ c.T).argmin(1)
        return out

    def fit(self, vectors: np.ndarray, rounds: int = 8) -> Quantiser:
        """Plain k-means in each subspace; distinct starts where there are so many."""
        x, rng = self.cut(vectors), np.random.default_rng(12)
        self.centres = np.zeros((self.parts, CENTRES, WIDTH))
        for s in range(self.parts):
            seen = np.unique(x[:, s], axis=0)
            self.centres[s] = seen[rng.choice(len(seen), CENTRES, replace=len(seen) < CENTRES)]
        for _ in range(rounds):
            code = self.codes(x)
            for s in range(self.parts):
                n = np.bincount(code[:, s], minlength=CENTRES)
                for j in range(WIDTH):
                    total = np.bincount(code[:, s], x[:, s, j], CENTRES)
                    self.centres[s, :, j] = np.where(n > 0, total / np.maximum(n, 1), self.centres[s, :, j])
        return self

    def coded(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and residual norms."""
        x = self.cut(vectors)
        code = self.codes(x)
        left = x - self.centres[np.arange(self.parts), code]
        with np.errstate(over="ignore"):
            return code, np.sqrt((left**2).sum((1, 2)))

    def bounds(self, anchors: np.ndarray, code: np.ndarray, residual: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of each anchor with each row, (anchors, rows)."""
        with np.errstate(over="ignore", invalid="ignore"):
            tables = np.einsum("qsw,scw->qsc", self.cut(anchors), self.centres)
            near = np.zeros((len(anchors), len(code)))
            for s in range(self.parts):
                near += tables[:, s][:, code[:, s]]
            length = np.sqrt((anchors**2).sum(1))[:, None]
            room = length * (residual + SLACK * (norm + residual)) + SLACK
            return np.nan_to_num(near - room, nan=-np.inf, posinf=np.inf, neginf=-np.inf), np.nan_to_num(near + room, nan=np.inf, posinf=np.inf, neginf=-np.inf)


def _integer(x: float) -> int:
    return 256 * int(x) if abs(x) >= EXACT else math.floor(256 * x)


class Block:
    """Rows of a block in order of id, with exact scores."""

    def __init__(self, t: pa.Table, dim: int) -> None:
        t = t.sort_by([("vec_id", "ascending"), ("row", "ascending")]).combine_chunks()
        self.raw = t["vec"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, dim)
        self.row, self.ids, self.label = (t[c].to_numpy() for c in ("row", "vec_id", "label"))
        self.vec = whole(self.raw)
        self.code = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
        self.residual, self.norm = t["residual"].to_numpy(), t["norm"].to_numpy()
        self.top = np.abs(self.vec).max(initial=0)

    def scores(self, anchor: np.ndarray, raw: np.ndarray, at: np.ndarray) -> list[int] | np.ndarray:
        """Inner products of rows ``at`` with an anchor, in whole numbers."""
        with np.errstate(over="ignore"):
            plain = np.abs(anchor).max(initial=0) * self.top * len(anchor) < EXACT  # every sum on the way is exact
        if plain:
            return (self.vec[at] @ anchor).astype(np.int64)
        q = [_integer(x) for x in raw.tolist()]
        return np.array([sum(a * b for a, b in zip(q, map(_integer, self.raw[i].tolist()), strict=True)) for i in at.tolist()], object)


def _best(score: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties in the order of ``at``."""
    return np.array(sorted(range(len(at)), key=lambda i: (-score[i], at[i]))[:k] if score.dtype == object else np.argsort(-score, kind="stable")[:k], int)


def _kth(lower: np.ndarray, k: int) -> float:
    return float(np.partition(lower, len(lower) - k)[len(lower) - k]) if len(lower) >= k else -np.inf


def first_positives(block: Block, book: Quantiser, row: np.ndarray, label: np.ndarray, raw: np.ndarray, k: int = POSITIVES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the anchor, places in the block, scores): the first ``k`` other rows of its label."""
    for lo in range(0, len(row), TOGETHER):
        own = whole(raw[lo : lo + TOGETHER])
        low, high = book.bounds(own, block.code, block.residual, block.norm)
        for i in range(len(own)):
            at = np.flatnonzero((block.label == label[lo + i]) & (block.row != row[lo + i]))
            at = at[high[i, at] >= _kth(low[i, at], k)]
            score = block.scores(own[i], raw[lo + i], at)
            best = _best(score, at, k)
            if len(best):
                yield lo + i, at[best], score[best]


def first_negatives(block: Block, book: Quantiser, label: np.ndarray, raw: np.ndarray, positives: list[list[int]], k: int = NEGATIVES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(place of the anchor, of its positive, places in the block, scores): the first ``k`` rows of other labels in the window."""
    for lo in range(0, len(label), TOGETHER):
        own = whole(raw[lo : lo + TOGETHER])
        low, high = book.bounds(own, block.code, block.residual, block.norm)
        for i in range(len(own)):
            other = np.flatnonzero(block.label != label[lo + i])
            least, most = low[i, other], high[i, other]
            wanted = np.zeros(len(other), bool)
            windows = [(LOW * p, HIGH * p) for p in positives[lo + i]]
            for a, b in windows:
                inside = (100 * least >= a) & (100 * most <= b)
                floor = _kth(least[inside], k)
                wanted |= (100 * most >= a) & (100 * least <= b) & (most >= floor)
            at = other[wanted]
            score = block.scores(own[i], raw[lo + i], at)
            for j, (a, b) in enumerate(windows):
                fit = np.flatnonzero(((100 * score >= a) & (100 * score <= b)).astype(bool))
                best = fit[_best(score[fit], at[fit], k)]
                if len(best):
                    yield lo + i, j, at[best], score[best]


def _long(score: np.ndarray) -> np.ndarray:
    return np.array([max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in score], np.int64)


def usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """vec_id, label (shifted where the id is divisible by 7), vec, of the rows that take part."""
    label = F.col(label_col).cast("long")
    found = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vec_col).cast("array<double>").alias("vec")).dropna()
    found = found.filter((F.size("vec") > 0) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return found.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def mined(vectors: DataFrame, scratch: Scratch, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Anchors are rows whose id ``every`` divides: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    sc = scratch.spark.sparkContext
    data = usable(vectors, id_col, vec_col, label_col)
    dims = data.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return scratch.spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    dim, total = dims["d"], dims["count"]
    data = scratch.write(data.filter(F.size("vec") == dim).withColumn("row", F.monotonically_increasing_id()), "rows")
    sample = data.orderBy(F.xxhash64("vec_id", F.lit(12)), "vec_id").limit(FIT_ROWS).select("vec").toArrow()
    fitted = whole(np.array(sample["vec"].combine_chunks().flatten()).reshape(-1, dim))
    book = sc.broadcast(Quantiser(dim).fit(np.clip(np.nan_to_num(fitted), -1e100, 1e100)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                x = whole(part.column(0).flatten().to_numpy().reshape(-1, dim))
                with np.errstate(over="ignore", invalid="ignore"):
                    code, residual = book.value.coded(x)
                    norm = np.sqrt((x**2).sum(1))
                extra = [pa.array([c.tobytes() for c in code], pa.binary()), pa.array(np.nan_to_num(residual, nan=np.inf)), pa.array(np.nan_to_num(norm, nan=np.inf))]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], ["vec", "vec_id", "label", "row", "code", "residual", "norm"])

    blocks = math.ceil(total / BLOCK_ROWS)
    index = mapped(data.select("vec", "vec_id", "label", "row"), encode, "vec array<double>, vec_id bigint, label bigint, row bigint, code binary, residual double, norm double")
    index = scratch.write(index.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")), "index")
    anchors = data.filter(F.col("vec_id") % every == 0).select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "vec")
    sets = max(1, math.ceil(anchors.count() / ANCHOR_ROWS))
    rows = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(sets - 1)))).groupBy("part", "block")

    def met(some: DataFrame) -> object:
        """Anchors, once for each block."""
        return some.withColumns({"part": F.pmod(F.xxhash64("anchor", F.lit(5)), F.lit(sets)).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))}).groupBy("part", "block").cogroup(rows)

    def opened(q: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return q["label"].to_numpy(), q["vec"].combine_chunks().flatten().to_numpy().reshape(q.num_rows, dim)

    def positives(q: pa.Table, d: pa.Table) -> pa.Table:
        out: dict[str, list] = {"anchor": [], "row": [], "positive_id": [], "positive_score": []}
        if q.num_rows and d.num_rows:
            block, own = Block(d, dim), q["anchor"].to_numpy()
            for i, at, score in first_positives(block, book.value, own, *opened(q)):
                out["anchor"].append(np.full(len(at), own[i]))
                out["row"].append(block.row[at])
                out["positive_id"].append(block.ids[at])
                out["positive_score"].append(_long(score))
        return pa.table({c: pa.array(np.concatenate(x) if x else [], pa.int64()) for c, x in out.items()})

    def negatives(q: pa.Table, d: pa.Table) -> pa.Table:
        out: dict[str, list] = {"anchor": [], "place": [], "negative_id": [], "negative_score": []}
        if q.num_rows and d.num_rows:
            block, own = Block(d, dim), q["anchor"].to_numpy()
            for i, j, at, score in first_negatives(block, book.value, *opened(q), q["scores"].to_pylist()):
                out["anchor"].append(np.full(len(at), own[i]))
                out["place"].append(np.full(len(at), j))
                out["negative_id"].append(block.ids[at])
                out["negative_score"].append(_long(score))
        return pa.table({c: pa.array(np.concatenate(x) if x else [], pa.int64()) for c, x in out.items()})

    first = met(anchors).applyInArrow(positives, "anchor bigint, row bigint, positive_id bigint, positive_score bigint")
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "row")
    first = first.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < POSITIVES)
    lists = first.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("found"))  # POSITIVES at most
    known = scratch.write(anchors.join(lists, "anchor").select("anchor", "anchor_id", "label", "vec", F.col("found.positive_id").alias("ids"), F.col("found.positive_score").alias("scores")), "positives")
    second = met(known.select("anchor", "label", "vec", "scores")).applyInArrow(negatives, "anchor bigint, place bigint, negative_id bigint, negative_score bigint")
    rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")).cast("int")
    second = second.withColumn("rank", rank).filter(F.col("rank") <= NEGATIVES)
    at = F.col("place").cast("int") + 1
    both = second.join(known.select("anchor", "anchor_id", "ids", "scores"), "anchor")
    return both.select("anchor_id", F.element_at("ids", at).alias("positive_id"), "rank", "negative_id", F.element_at("scores", at).alias("positive_score"), "negative_score")
