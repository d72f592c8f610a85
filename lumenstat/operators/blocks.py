"""Nearest rows of a stated set of queries, exactly: blocks of rows meet parts of the queries, a task each.

Chunks of a block meet a strip of queries in one matrix product in single precision, of centred and scaled vectors, which gives
lower bounds of all squared distances by the rounding error of each pair. Pairs whose lower bound is above the k-th upper bound of
their query so far are done with; what is left is computed component by component in double precision, and ranked; k rows a query and
block then move on. Rows times queries are compared, as an exact search must; memory holds one block, one part and a chunk of bounds.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

BLOCK_ROWS, PART_ROWS, STRIP, CHUNK = 131_072, 65_536, 512, 1024
#: Most components of a block or part, fewer rows if these are long; most pairs that wait for their distances; components compared at once.
MOST_NUMBERS, MOST_PAIRS, AT_ONCE = 2**23, 2**19, 2**22
#: Where cores would be idle, blocks and parts are cut down to so many rows and queries.
LEAST_ROWS, LEAST_QUERIES = 65_536, STRIP


def _vectors(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of ``width`` components without nulls, and their components."""
    one = column.combine_chunks()
    one = one.combine_chunks() if isinstance(one, pa.ChunkedArray) else one
    at = np.flatnonzero(pc.fill_null(pc.list_value_length(one), -1).to_numpy(zero_copy_only=False) == width)
    flat = pc.cast(one.take(pa.array(at)).flatten(), pa.float64())
    whole = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(len(at), width).any(1)
    return at[whole], flat.to_numpy(zero_copy_only=False).reshape(len(at), width)[whole]


def _distances(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of paired rows or of a strip, summed component by component in order; ``x`` and ``q`` hold components first."""
    total = 0.0
    for a, b in zip(x, q, strict=True):
        total = total + (np.abs(a - b) if metric == "manhattan" else (a - b) * (a - b))
    return total if metric == "manhattan" else np.sqrt(total)


def _bounds(metric: str, x: np.ndarray):
    """A function of a strip of queries, which gives a function of a slice of rows: lower bounds of the pairs (squared, in units of its
    own), and by how much more the upper bounds are, as a column of queries and a row of rows. What is no number is of unknown distance."""
    if metric == "manhattan":

        def exact(q: np.ndarray):
            return lambda s: (_distances(metric, x[s].T[:, None, :], q.T[:, :, None]), np.zeros((len(q), 1)), np.zeros((1, 1)))

        return exact
    some = x[np.isfinite(x).all(1)]
    some = some[:: max(1, len(some) // 1024)]
    middle = np.median(some, axis=0) if len(some) else np.zeros(x.shape[1])
    size = float(np.median(np.abs(some - middle).max(1))) if len(some) else 0.0
    unit = size if np.isfinite(size) and size > 1e-290 else 1.0
    share = (2 * x.shape[1] + 16) * float(np.finfo(np.float32).eps)  # twice the rounding error of a pair, by its squares

    def ready(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = (v - middle) / unit
        sq = (z * z).sum(1)
        odd = ~(sq < 1e30)
        z[odd], sq[odd] = 0, np.nan
        return z.astype(np.float32), sq

    z, zz = ready(x)
    more = (2.5 * share * zz + 1e-30).astype(np.float32)[None, :]
    right = np.ascontiguousarray(np.column_stack([z, (zz * (1 - share) - 1e-30).astype(np.float32), np.ones(len(x), np.float32)]).T)

    def strip(q: np.ndarray):
        y, yy = ready(q)
        left = np.column_stack([-2 * y, np.ones(len(q), np.float32), (yy * (1 - share)).astype(np.float32)])
        far = (2.5 * share * yy).astype(np.float32)[:, None]
        return lambda s: (left @ right[:, s], far, more[:, s])

    return strip


def _first(at: np.ndarray, row: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the ``k`` nearest, nearest first, earlier rows first at ties."""
    order = np.lexsort((row, dist, at))
    at, row, dist = at[order], row[order], dist[order]
    first = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[first], row[first], dist[first]


def _near(x: np.ndarray, q: np.ndarray, own: np.ndarray, mine: np.ndarray, k: int, metric: str, bounds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of each query's k nearest rows, nearest first, earlier rows first at ties; a pair of one group is left out.

    ``bounds`` is that of ``_bounds`` for ``x``; ``own`` and ``mine`` number the groups of rows and queries."""
    bound = bounds(q)
    top, limit = np.full((len(q), k), np.inf), np.full(len(q), np.inf)
    best = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    wait, waiting = [], 0

    def settle() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, row, low = (np.concatenate([w[i] for w in wait]) for i in range(3))
        left = ~(low > limit[at])
        at, row = at[left], row[left]
        n = max(1, AT_ONCE // x.shape[1])
        dist = [_distances(metric, x[row[i : i + n]].T, q[at[i : i + n]].T) for i in range(0, len(at), n)]
        return _first(*(np.concatenate([b, *new]) for b, new in zip(best, ([at], [row], dist), strict=True)), k)

    for start in range(0, len(x), CHUNK):
        s = slice(start, start + CHUNK)
        low, far, more = bound(s)
        hit = np.flatnonzero(~(low.min(1) > limit))
        if not len(hit):
            continue
        low, far, more = low[hit], far[hit], np.broadcast_to(more, (1, low.shape[1]))
        same = np.flatnonzero(np.isin(mine[hit], own[s]))
        out = mine[hit[same], None] == own[None, s]
        if start == 0:  # no limit yet: all upper bounds of the chunk give one
            high = low + far + more
            high[same] = np.where(out, np.inf, high[same])
            high[np.isnan(high)] = np.inf
            top[hit, : high.shape[1]] = np.partition(high, min(k, high.shape[1]) - 1, axis=1)[:, :k]
            limit[hit] = top[hit].max(1)
        near = ~(low > limit[hit, None])
        near[same] &= ~out
        i, j = np.divmod(np.flatnonzero(near), near.shape[1])
        if not len(i):
            continue
        at, lows = hit[i], low[i, j].astype(float)
        if start:
            place = np.arange(len(i)) - np.searchsorted(i, i)
            new = np.full((len(hit), place.max() + 1), np.inf)
            new[i, place] = lows + far[i, 0] + more[0, j]
            top[hit] = np.partition(np.concatenate([top[hit], new], axis=1), k - 1, axis=1)[:, :k]
            limit[hit] = top[hit].max(1)
        left = ~(lows > limit[at])
        wait.append((at[left], j[left] + start, lows[left]))
        waiting += int(left.sum())
        if waiting > MOST_PAIRS:
            best, wait, waiting = settle(), [], 0
    return settle() if wait else best


def _meet(k: int, id_col: str, vec: str, apart: str, metric: str, names: list[str]):
    def search(asked: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(id_col, "ascending")]))  # ties go to the least id
        group = pc.unique(rows[apart].combine_chunks())
        own = pc.index_in(rows[apart], value_set=group).to_numpy(zero_copy_only=False)
        mine = pc.fill_null(pc.index_in(asked["_apart"], value_set=group), -1).to_numpy(zero_copy_only=False)
        widths = pc.list_value_length(asked["_qv"])
        found = []
        with np.errstate(all="ignore"):
            for w in pc.unique(widths).drop_null().to_pylist():
                (qs, q), (xs, x) = _vectors(asked["_qv"], w), _vectors(rows[vec], w)
                bounds = _bounds(metric, x) if w and len(xs) and len(qs) else None
                for i in range(0, len(qs) if bounds else 0, STRIP):
                    s = slice(i, i + STRIP)
                    at, row, dist = _near(x, q[s], own[xs], mine[qs[s]], k, metric, bounds)
                    found.append((qs[s][at], xs[row], dist))
        at, row, dist = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, int if i < 2 else float) for i in range(3))
        # fewer than k: rows at no distance follow, by id
        more = []
        for i in np.flatnonzero(np.bincount(at, minlength=asked.num_rows) < k):
            have = row[at == i]
            rest = np.flatnonzero(own != mine[i]) if len(have) < (own != mine[i]).sum() else have[:0]
            more += [(i, r) for r in rest[~np.isin(rest, have)][: k - len(have)]]
        at, row = np.concatenate([at, np.array([m[0] for m in more], int)]), np.concatenate([row, np.array([m[1] for m in more], int)])
        dist = pa.array(np.concatenate([dist, np.zeros(len(more))]), mask=np.arange(len(at)) >= len(dist))
        taken = rows.take(pa.array(row, pa.int64()))
        cols = {"query_id": asked["query_id"].take(pa.array(at, pa.int64())), "dist": dist}
        return pa.table([cols[n] if n in cols else taken[n] for n in names], names=names)

    return search


def nearest_blocks(queries: DataFrame, data: DataFrame, k: int, id_col: str, vec: str, metric: str, apart: str, carry: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, dist, ``carry`` (columns of ``data``) and rank: each query's ``k`` nearest rows of another ``apart``; the least id wins ties.

    Distances are those of the formula in double precision, summed in the order of components. A pair of which a vector is null, holds
    nulls or is of another length has a null distance and ranks last. Rows whose id or ``apart`` is null take no part.
    """
    kept = list(dict.fromkeys([id_col, vec, apart, *carry]))
    rows, q = data.dropna(subset=[id_col, apart]).select(*kept), queries.dropna(subset=[id_col, apart]).select(F.col(id_col).alias("query_id"), F.col(vec).alias("_qv"), F.col(apart).alias("_apart"))
    held, asked = rows.agg(F.count("*").alias("n"), F.max(F.size(vec)).alias("w")).first(), q.agg(F.count("*").alias("n"), F.max(F.size("_qv")).alias("w")).first()
    parts = max(1, math.ceil(asked["n"] / min(PART_ROWS, max(1, MOST_NUMBERS // max(1, asked["w"] or 1)))))
    blocks = max(1, math.ceil(held["n"] / min(block_rows, max(1, MOST_NUMBERS // max(1, held["w"] or 1)))))
    cores = data.sparkSession.sparkContext.defaultParallelism
    blocks = max(blocks, min(math.ceil(held["n"] / LEAST_ROWS), math.ceil(3 * cores / parts)))
    parts = max(parts, min(math.ceil(asked["n"] / LEAST_QUERIES), math.ceil(3 * cores / blocks)))
    tasks = max(parts * blocks, min(4 * parts * blocks, 1000))  # more than groups, so that few of them share a task

    def dealt(df: DataFrame, key: str, name: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumns({name: F.pmod(F.xxhash64(key), F.lit(n)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))}).repartition(tasks, "_part", "_block").groupBy("_part", "_block")

    schema = StructType([q.schema["query_id"], StructField("dist", DoubleType()), *data.select(*carry).schema.fields])
    met = dealt(q, "query_id", "_part", parts, "_block", blocks).cogroup(dealt(rows, id_col, "_block", blocks, "_part", parts))
    found = met.applyInArrow(_meet(k, id_col, vec, apart, metric, schema.names), schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("dist").asc_nulls_last(), id_col))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)
