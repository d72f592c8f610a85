"""Operator 9: approximate nearest neighbours by score-aware anisotropic quantisation.

Vectors are scaled to length one and cut into short subspaces of sixteen centres each (4 bits). Centres
and codes minimise |r|^2 + (eta - 1) (r . x)^2 for the residual r, so that error along the vector, which
changes large inner products most, costs eta times as much. A query's table of inner products with the
centres is read by packed codes, two subspaces to a byte; in each block of vectors the best candidates, with
all that tie with the last of them, are ranked exactly, in double precision on the original vectors. A block
gives its k nearest, and these are merged by exact score, so that candidates grow with the number of blocks
and neither equal vectors nor near copies of one code are cut by anything but score and id.

The centres are fitted on a bounded sample (FIT_ROWS rows, by hash of the id); every row is indexed. Vectors
null, empty, zero or holding null or non-finite components take no part, nor do those of another length than
the commonest. Repeated rows are vectors of their own, and queries of their own; ties go to the smaller id. Rows of
the query's own id are not its neighbours. An empty table gives an empty result.

Every query meets every block: with queries a fixed share of the rows the scan grows with the square of the table,
as an exact search does, at half a byte a component instead of eight. Coarse partitions that a query probes in part
save little on vectors without clusters (on those of the tests half of 64 partitions hold 0.90 of the true five
nearest), so there are none. Each vector is sent once for QUERY_ROWS queries, each query once for BLOCK_ROWS vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenstat.llm.shared import Scratch, mapped

FIT_ROWS = 4096
CENTRES = 16
THRESHOLD = 0.2  # cosine above which errors matter: gives the weight eta
BLOCK_ROWS = 8_192  # vectors scanned together
QUERY_ROWS = 4_096  # queries that meet a block together: each vector is sent once for so many
CANDIDATES = 200  # ranked exactly in each block, and all that tie with the last
PAIRS = 1 << 18  # query and candidate pairs ranked together


def weight(dim: int, threshold: float = THRESHOLD) -> float:
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


class Codebook:
    """Centres of each subspace: (subspaces, CENTRES, width)."""

    def __init__(self, dim: int, width: int = 2) -> None:
        self.dim, self.width = dim, width
        self.parts = -(-dim // width)
        self.parts += self.parts % 2  # two to a byte
        self.eta = weight(dim)
        self.centres = np.zeros((self.parts, CENTRES, width))

    def cut(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors as (rows, subspaces, width), zeros after the last component."""
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        pad = self.parts * self.width - self.dim
        return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), self.parts, self.width)

    def codes(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes of cut vectors, by coordinate descent on the anisotropic loss."""
        plain = ((x[:, :, None, :] - self.centres[None]) ** 2).sum(-1)
        along = (x[:, :, None, :] * (x[:, :, None, :] - self.centres[None])).sum(-1)
        code = plain.argmin(2)
        rows = np.arange(len(x))
        part = np.take_along_axis(along, code[:, :, None], 2)[:, :, 0]
        total = part.sum(1)
        for _ in range(sweeps):
            for s in range(self.parts):
                rest = total - part[:, s]
                best = (plain[:, s] + (self.eta - 1) * (rest[:, None] + along[:, s]) ** 2).argmin(1)
                code[:, s], part[:, s] = best, along[rows, s, best]
                total = rest + part[:, s]
        return code

    def fit(self, vectors: np.ndarray, rounds: int = 8) -> Codebook:
        """Alternate codes and centres; centres solve the weighted least squares of all subspaces together."""
        x = self.cut(vectors)
        n, k = len(x), self.parts * CENTRES
        rng = np.random.default_rng(7)
        for s in range(self.parts):
            self.centres[s] = x[rng.choice(n, CENTRES, replace=n < CENTRES), s]
        for _ in range(rounds):
            code = self.codes(x) + np.arange(self.parts) * CENTRES
            slots = np.zeros((n, k, self.width))
            np.put_along_axis(slots, code[:, :, None], x, 1)
            flat = slots.reshape(n, -1)
            counts = np.repeat(np.bincount(code.ravel(), minlength=k), self.width)
            left = (self.eta - 1) * flat.T @ flat
            left[np.diag_indices_from(left)] += counts + 1e-6
            right = flat.sum(0) * self.eta + 1e-6 * self.centres.ravel()
            self.centres = np.linalg.solve(left, right).reshape(self.centres.shape)
        return self

    def pack(self, code: np.ndarray) -> np.ndarray:
        return (code[:, 0::2] | code[:, 1::2] << 4).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, pairs of subspaces, 256): inner products by packed code."""
        t = np.einsum("qsw,scw->qsc", self.cut(queries), self.centres).astype(np.float32)
        return (t[:, 1::2, :, None] + t[:, 0::2, None, :]).reshape(len(queries), self.parts // 2, 256)


def scan(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Approximate cosines, (queries, vectors)."""
    out = np.zeros((len(tables), len(packed)), np.float32)
    for s in range(packed.shape[1]):
        out += tables[:, s][:, packed[:, s]]
    return out


def usable(vectors: DataFrame, id_col: str, vec_col: str, label: str) -> DataFrame:
    """id, vec (double), of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    found = vectors.select(F.col(id_col).cast("long").alias(label), v.alias("vec")).filter(F.col("vec").isNotNull() & (F.size("vec") > 0))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return found.filter(F.col(label).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("vec", lambda x: x != 0))


def total(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component on, so that equal rows tie wherever they are."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def nearest(near: np.ndarray, k: int, q: np.ndarray, vec: np.ndarray, candidates: int = CANDIDATES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of approximate scores ``near`` (-inf: not to be taken) the ``k`` best by exact cosine, then by place in ``vec``: rows, places, cosines."""
    m = min(max(candidates, k), near.shape[1])
    floor = np.partition(near, near.shape[1] - m, axis=1)[:, near.shape[1] - m]
    took = (near >= floor[:, None]) & np.isfinite(near)
    norm_q, norm_v = np.sqrt(total(q, q)), np.sqrt(total(vec, vec))
    found: list[tuple[np.ndarray, ...]] = []
    for row in range(len(near)):
        at = np.flatnonzero(took[row])
        score = np.concatenate([total(np.broadcast_to(q[row], (len(c), q.shape[1])), vec[c]) / (norm_q[row] * norm_v[c]) for c in np.split(at, range(PAIRS, len(at), PAIRS))])
        best = np.argsort(-score, kind="stable")[:k]
        found.append((np.full(len(best), row), at[best], score[best]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def neighbours(vectors: DataFrame, queries: DataFrame, scratch: Scratch, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` to each row of ``queries``, but the query's own id: query_id, rank, vec_id, score."""
    sc = scratch.spark.sparkContext
    data = usable(vectors, id_col, vec_col, "vec_id")
    dims = data.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return scratch.spark.createDataFrame([], schema)
    dim, total = dims["d"], dims["count"]
    data = scratch.write(data.filter(F.size("vec") == dim), "vectors")
    asked = usable(queries, id_col, vec_col, "query_id").filter(F.size("vec") == dim)
    asked = scratch.write(asked.withColumn("row", F.monotonically_increasing_id()), "queries")  # rows that repeat an id are queries of their own
    sample = data.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(FIT_ROWS).select("vec").toPandas()
    book = sc.broadcast(Codebook(dim).fit(np.array(sample["vec"].tolist(), float).reshape(-1, dim)))
    blocks, sets = math.ceil(total / BLOCK_ROWS), max(1, math.ceil(asked.count() / QUERY_ROWS))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = book.value
        for batch in batches:
            ids, vec = batch.column(0), batch.column(1)
            for lo in range(0, len(ids), 2048):
                x = vec.slice(lo, 2048).flatten().to_numpy().reshape(-1, dim)
                packed = b.pack(b.codes(b.cut(x)))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, 2048), vec.slice(lo, 2048), pa.array([p.tobytes() for p in packed], pa.binary())], ["vec_id", "vec", "code"])

    index = mapped(data, encode, "vec_id bigint, vec array<double>, code binary").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    index = scratch.write(index, "index")
    left = asked.withColumns({"part": F.pmod(F.xxhash64("row", F.lit(5)), F.lit(sets)).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    right = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))

    def search(q: pa.Table, d: pa.Table) -> pa.Table:
        b = book.value
        found = {"row": [], "query_id": [], "vec_id": [], "score": []}
        if d.num_rows and q.num_rows:
            d = d.select(["vec_id", "code", "vec"]).sort_by("vec_id").combine_chunks()
            ids = d["vec_id"].to_numpy()
            packed = np.frombuffer(b"".join(d["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
            vec = d["vec"].combine_chunks().flatten().to_numpy().reshape(len(ids), dim)
            qid, qrow, qv = q["query_id"].to_numpy(), q["row"].to_numpy(), q["vec"].combine_chunks().flatten().to_numpy().reshape(q.num_rows, dim)
            for lo in range(0, len(qid), 64):
                near = scan(b.tables(qv[lo : lo + 64]), packed)
                near[(qid[lo : lo + 64, None] == ids[None, :]) | np.isnan(near)] = -np.inf
                row, at, score = nearest(near, k, qv[lo : lo + 64], vec)
                found["row"].append(qrow[lo : lo + 64][row])
                found["query_id"].append(qid[lo : lo + 64][row])
                found["vec_id"].append(ids[at])
                found["score"].append(score)
        kinds = (("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()))
        return pa.table({n: pa.array(np.concatenate(found[n]) if found[n] else [], t) for n, t in kinds})

    ranked = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(search, "row bigint, query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")).cast("int")
    return ranked.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
