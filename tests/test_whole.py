"""Queries over whole tables: no id subset, against SQL or brute force."""

import duckdb
import numpy as np
import pytest

from lumenstat.operators import chains, order
from lumenstat.operators.graph import pagerank, pagerank_direct
from lumenstat.plans import registry

SF = "/root/testdata/sf0.001"


def same(spark, name, sf=SF):
    got = registry.queries()[name](spark, sf).toPandas()
    db = duckdb.connect()
    for t in ("events", "lineitem", "part", "supplier"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = db.execute(registry.oracle_sql()[name]).df()
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    keys = [c for c in got.columns if got[c].dtype.kind in "iOb"] or list(got.columns)
    got, want = (x.sort_values(keys).reset_index(drop=True) for x in (got, want))
    for c in got.columns:
        if got[c].dtype.kind == "f":
            assert np.allclose(got[c], want[c].astype(float), atol=2e-3 if c == "energy" else 2e-6, rtol=1e-9, equal_nan=True), c
        else:
            assert (got[c] == want[c]).all(), c
    return got


@pytest.mark.parametrize("name", ["haar_level1_all", "haar_energy_all", "moving_average_all", "autocorrelation_all"])
def test_series_over_all_events_equal_sql(spark, name):
    same(spark, name)


def test_series_reads_every_event(spark):
    n, v = 1000, spark.read.parquet(f"{SF}/events.parquet").toPandas()["value"].to_numpy()
    assert registry.queries()["moving_average_all"](spark, SF).count() == n
    assert registry.queries()["haar_level1_all"](spark, SF).count() == n / 2
    e = registry.queries()["haar_energy_all"](spark, SF).toPandas()
    assert set(e.level) == set(range(1, 11))
    assert e.energy.sum() + v.sum() ** 2 / 1024 == pytest.approx((v**2).sum(), abs=0.01)


def test_placed_ranks_in_order_of_a_gappy_key(spark):
    ids = sorted(np.random.default_rng(1).choice(10**12, 500, replace=False).tolist()) + [10**15]
    got = order.placed(spark.createDataFrame([(i - 10**6,) for i in ids], "id long"), "id", "i", 7).orderBy("id").collect()
    assert [r["i"] for r in got] == list(range(501))


@pytest.mark.parametrize("name", ["graph_degrees_all", "graph_transition_all"])
def test_graph_of_all_lineitems_equals_sql(spark, name):
    same(spark, name)


def test_pagerank_to_tolerance_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    n, edges = 40, {(int(a), int(b)) for a, b in rng.integers(0, 40, (90, 2)) if a not in (3, 7)}
    step = np.zeros((n, n))
    for a, b in edges:
        step[a, b] = 1
    out = step.sum(1, keepdims=True)
    step = np.where(out > 0, step / np.maximum(out, 1), 1 / n)
    want = np.linalg.solve(np.eye(n) - 0.85 * step.T, np.full(n, 0.15 / n))
    got = pagerank(spark.range(n), spark.createDataFrame(sorted(edges), "src long, dst long"), 10_000, tol=1e-9).orderBy("id").collect()
    assert np.abs(np.array([r["rank"] for r in got]) - want).sum() < 1e-8


def test_links_that_end_settle_in_as_many_terms(spark):
    rng = np.random.default_rng(4)
    links = sorted({(int(a), 30 + int(b)) for a, b in zip(rng.integers(0, 28, 80), rng.integers(0, 6, 80))})
    nodes, edges = spark.range(36), spark.createDataFrame(links, "src long, dst long")
    want = dict(pagerank_direct(nodes, edges))
    got = {r["id"]: r["rank"] for r in pagerank(nodes, edges, 3, tol=1e-12).collect()}
    assert max(abs(got[k] - want[k]) for k in want) < 1e-14 and sum(got.values()) == pytest.approx(1, abs=1e-14)
    home = spark.createDataFrame([(0, 3.0), (33, 1.0)], "id long, weight double")
    a, b = (dict(pagerank(nodes, edges, k, teleport=home, tol=t).collect()) for k, t in ((3, 1e-12), (40, None)))
    assert max(abs(a[k] - b[k]) for k in want) < 0.85**40


@pytest.mark.parametrize("name", ["chain_rhat_all", "chain_autocorrelation_all", "credible_interval_all"])
def test_chains_of_all_events_equal_sql(spark, name):
    same(spark, name)


def test_effective_size_goes_on_past_eight_lags(spark):
    rng = np.random.default_rng(6)
    v = np.convolve(rng.normal(size=1300), np.ones(60), "valid")
    df = spark.createDataFrame([(0, t, float(x)) for t, x in enumerate(v)], "chain long, step long, value double")
    c, s, lag = v - v.mean(), 0.0, 1
    while (rho := c[lag:] @ c[:-lag] / (c @ c)) >= 0:
        s, lag = s + rho, lag + 1
    assert lag > 9 and chains.effective_size(df).first()["ess"] == pytest.approx(len(v) / (1 + 2 * s))
    sizes = registry.queries()["chain_effective_size_all"](spark, SF).toPandas()
    assert sizes.n.sum() == 1000


def test_best_subset_has_every_model(spark):
    d = spark.read.parquet(f"{SF}/lineitem.parquet").toPandas()
    got = registry.queries()["best_subset_all"](spark, SF).toPandas()
    assert len(got) == 8 and got.best.sum() == 4 and got.loc[got.mse.idxmin(), "size"] == 3
    for r in got.itertuples():
        x = np.column_stack([np.ones(len(d)), *[d[c] for c in r.model.split(",") if c]])
        y = d.l_extendedprice.to_numpy()
        b, *_ = np.linalg.lstsq(x, y, rcond=None)
        assert r.mse == pytest.approx(((y - x @ b) ** 2).mean(), abs=0.02)
