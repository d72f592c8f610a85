"""Nearest rows by blocks: against the formula row by row, with ties, odd rows and more queries than one part."""

import math

import numpy as np
import pyarrow as pa
import pytest

from lumenstat.operators import blocks, cluster, nearby
from lumenstat.plans import points


def brute(rows, asked, k, metric):
    def far(a, b):
        if a is None or b is None or len(a) != len(b) or any(x is None for x in (*a, *b)):
            return None
        s = 0.0
        for x, y in zip(a, b):
            s += abs(x - y) if metric == "manhattan" else (x - y) * (x - y)
        return s if metric == "manhattan" else math.sqrt(s)

    out = {}
    for q in asked:
        d = [(far(v, rows[q]), i) for i, v in rows.items() if i != q]
        d.sort(key=lambda p: (p[0] is None, p[0] is not None and math.isnan(p[0]), 0.0 if p[0] is None or math.isnan(p[0]) else p[0], p[1]))
        out[q] = [(i, x) for x, i in d[:k]]
    return out


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_blocks_equal_brute_force(spark, monkeypatch, metric):
    monkeypatch.setattr(blocks, "PART_ROWS", 7)
    rng = np.random.default_rng(5)
    rows = {i: [float(x) for x in rng.integers(0, 3, 4) * 0.1 + 1e3] for i in range(120)}  # many ties, far from the origin
    rows.update({200: None, 201: [None, 1.0, 1.0, 1.0], 202: [1.0], 203: [float("nan")] * 4, 204: [1e200] * 4, 205: [float("inf")] * 4, 206: []})
    df = spark.createDataFrame(list(rows.items()), "id long, v array<double>")
    asked = [*range(0, 120, 5), 200, 202, 203, 204, 205, 206]
    for size in (10, 50, 1000):
        got = {}
        near = blocks.nearest_blocks(df.filter(df.id.isin(asked)), df, 6, "id", "v", metric, "id", ["id"], size)
        for r in near.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r["id"], r["dist"]))
        assert repr(got) == repr(brute(rows, asked, 6, metric))


def test_few_rows_and_other_ids(spark):
    df = spark.createDataFrame([("b", [0.0]), ("a", [1.0]), ("c", [-1.0]), ("d", None), (None, [0.0])], "id string, v array<double>")
    got = nearby.nearest_rows(df.filter("id = 'b'"), df, 9, "id", "v").orderBy("rank").collect()
    assert [(r["id"], r["dist"], r["rank"]) for r in got] == [("a", 1.0, 1), ("c", 1.0, 2), ("d", None, 3)]
    assert cluster.neighbours(df.limit(0), df, 3, "id", "v").count() == 0
    assert cluster.neighbours(df, df.limit(0), 3, "id", "v").columns == ["id", "query_id", "dist", "rank"]


def test_any_number_of_queries(spark):
    """More than 100,000 queries were refused."""
    df = spark.range(100_001).selectExpr("id", "array(CAST(id AS DOUBLE)) AS v")
    near = cluster.neighbours(df, df.filter("id % 20000 = 0"), 1, "id", "v")
    assert near.count() == 100_001 and near.filter("dist > 20000 OR dist = 0").count() == 0


def test_means_of_any_number_of_queries(spark):
    df = spark.range(100_001).selectExpr("id", "array(CAST(id AS DOUBLE)) AS v", "CAST(id AS DOUBLE) AS y")
    got = nearby.knn_regress(nearby.nearest_rows(df, df.filter("id % 20000 = 0"), 1, "id", "v"), "y")
    assert got.count() == 100_001 and got.filter("abs(predicted - query_id) > 20000").count() == 0


def test_a_null_vector_is_nobodys_nearest(spark, tmp_path):
    """Its null distance ranked first."""
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    none = spark.createDataFrame([(10**6 + 1, None, 77)], df.schema)
    df.write.parquet(str(tmp_path / "a" / "embeddings.parquet"))
    df.unionByName(none).write.parquet(str(tmp_path / "b" / "embeddings.parquet"))
    a, b = (sorted(points.knn_class(spark, str(tmp_path / d)).collect()) for d in "ab")
    assert a == b and len(a) > 0


def met(rows, asked, k, metric="euclidean", group=None):
    """The search of one block by one part, without Spark: {query: [(id, dist)]}."""
    kind = pa.list_(pa.float64())
    ids = list(rows)
    group = group or (lambda i: i)
    table = pa.table({"id": pa.array(ids, pa.int64()), "v": pa.array([rows[i] for i in ids], kind), "g": pa.array([group(i) for i in ids], pa.int64())})
    part = pa.table({"query_id": pa.array(asked, pa.int64()), "_qv": pa.array([rows[i] for i in asked], kind), "_apart": pa.array([group(i) for i in asked], pa.int64())})
    got = blocks._meet(k, "id", "v", "g", metric, ["query_id", "dist", "id"])(part, table).to_pylist()
    out = {q: [] for q in asked}
    for r in got:
        out[r["query_id"]].append((r["id"], r["dist"]))
    return {q: sorted(found, key=lambda p: (p[1] is None, p[1] is not None and math.isnan(p[1]), 0.0 if p[1] is None or math.isnan(p[1]) else p[1], p[0])) for q, found in out.items()}


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_chunks_equal_brute_force(monkeypatch, metric):
    """Chunks, strips and flushes far smaller than the block, ties across chunks, odd rows among the first."""
    for name, value in {"CHUNK": 9, "STRIP": 7, "MOST_PAIRS": 40, "AT_ONCE": 12}.items():
        monkeypatch.setattr(blocks, name, value, raising=False)
    rng = np.random.default_rng(7)
    rows = {i: [float(x) for x in rng.integers(0, 4, 3) * s + 1e4] for i, s in zip(range(160), np.resize([0.1, 1e-7, 1.0], 160))}
    rows.update({3: None, 4: [float("nan")] * 3, 5: [1e200] * 3, 6: [float("inf"), 0.0, 0.0], 7: [1e160] * 3, 8: [-1e-200] * 3, 9: [1e38] * 3, 10: [1e-40] * 3})
    asked = [i for i in range(0, 160, 4)] + [3, 5, 6, 7, 9, 10]
    assert repr(met(rows, sorted(set(asked)), 5, metric)) == repr(brute(rows, sorted(set(asked)), 5, metric))
    fold = {i: i % 3 for i in rows}
    want = {q: brute({i: v for i, v in rows.items() if i == q or fold[i] != fold[q]}, [q], 5, metric)[q] for q in asked}
    assert repr(met(rows, asked, 5, metric, fold.get)) == repr(want)


@pytest.mark.parametrize("shift, odd", [(1e6, None), (0.0, 1e150)])
def test_few_pairs_are_compared_in_full(monkeypatch, shift, odd):
    """Vectors far from the origin, or one of great length, made every pair of a block a near one, to be held and compared in full."""
    pairs, plain = [], blocks._distances
    monkeypatch.setattr(blocks, "_distances", lambda metric, x, q: (pairs.append(np.broadcast(x[0], q[0]).size), plain(metric, x, q))[1])
    rows = {i: list(map(float, v)) for i, v in enumerate(np.random.default_rng(3).normal(0, 0.05, (4000, 8)) + shift)}
    if odd:
        rows[4000] = [odd] * 8
    asked = list(range(0, 4000, 40))
    got = met(rows, asked, 5)
    assert sum(pairs) < 0.02 * len(rows) * len(asked)
    assert got[80] == brute(rows, [80], 5, "euclidean")[80]


def test_found_rows_hold_no_vectors(spark):
    """Five whole vectors of each query and block went through the ranking, and all vectors as doubles."""
    assert set(points._near(spark, "/root/testdata/sf0.001").columns) == {"vec_id", "label", "query_id", "dist", "rank"}
