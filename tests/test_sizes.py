"""Queries on larger or longer tables than the given ones: their work and their SQL must go with the size."""

import numpy as np
import pytest

from perdura.plans import catalogue

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", ["outliers_random", "heavy_tail_noise"])
def test_strengths_of_perturbations_are_aggregates_of_points(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # A mean within a lambda is found again for each value of the array.
    assert "lambda" not in plan.split("MapInArrow")[0] and "stddev_pop" in plan.lower()


def test_points_are_those_of_the_packed_perturbation(spark):
    from perdura.operators import simulate

    x = np.random.default_rng(4).standard_normal(simulate.POINTS + 10)
    rows = spark.createDataFrame([("a", len(x), x.tolist(), 5), ("b", 3, [1.0, 2.0, 4.0], 6)], "series_id string, n long, values array<double>, seed long")
    params = {"rate": 0.02, "amplitude": 4.0}
    want = {r.series_id: r.contaminated for r in simulate.contaminate(rows, "outliers", params).collect()}
    got = {}
    for r in simulate.contaminated_points(rows, "outliers", params).orderBy("series_id", "t").collect():
        assert r.t == len(got.setdefault(r.series_id, []))
        got[r.series_id].append(r.contaminated)
    assert got == want


def test_sql_has_the_scales_and_levels_of_long_series():
    import duckdb
    import pandas as pd

    from perdura.kernels.estimators import KERNELS

    n = 700_000
    x = np.round(np.random.default_rng(11).standard_normal(n).cumsum() * 0.01 + np.random.default_rng(12).standard_normal(n), 3)
    con = duckdb.connect()
    con.register("numbers", pd.DataFrame({"ts": np.arange(n), "value": x}))
    con.sql("CREATE TABLE events AS SELECT 'a' AS event_type, ts, ts AS event_id, value FROM numbers")
    haar = {"wavelet": "haar"}
    for name, kernel, params in (("dfa_order0", "DFA", {"detrend_order": 0}), ("dma_hurst", "DMA", {}), ("wavelet_haar_abry_veitch", "WaveletAbryVeitch", haar), ("wavelet_haar_jensen", "WaveletJensen", haar), ("wavelet_haar_ols", "WaveletOLS", haar)):
        point = con.sql(f"SELECT point FROM ({SQL[name]})").fetchall()[0][0]
        assert point == pytest.approx(float(KERNELS[kernel](x[None, :], params)[0]), abs=2e-6), name


def test_copies_of_rows_come_without_lags(spark):
    from pyspark.sql import functions as F

    from perdura.operators import blocks

    rows = blocks.even_blocks(spark.createDataFrame([("a", t, 1.0) for t in range(40)], "series_id string, t long, v double"), 8)
    got = blocks.with_halo(rows, F.array(F.lit(1).cast("long"), F.lit(9).cast("long")), 8).collect()
    assert all((r.lags is None) == (not r.own) for r in got) and sum(r.own for r in got) == 40
    assert len({(r.t, r.block) for r in got}) == len(got) > 60


def test_blocks_of_the_registered_queries_go_with_the_table(spark, tmp_path):
    from perdura.plans import series_queries

    spark.range(300 * 1000).write.parquet(str(tmp_path / "events.parquet"))
    assert series_queries.block_of(spark, str(tmp_path)) == 300_000 // 256 and series_queries.block_of(spark, SF) == 256


@pytest.mark.parametrize("wavelet", ["haar", "db4"])
def test_wavelet_levels_take_a_shuffle_for_several(spark, wavelet):
    from perdura.kernels.numeric import details
    from perdura.operators import blocks

    rng = np.random.default_rng(9)
    series = {f"s{n}": rng.standard_normal(n).cumsum() for n in (100, 128, 1025, 5000, 5119)}
    rows = spark.createDataFrame([(k, t, float(v)) for k, x in series.items() for t, v in enumerate(x)], "series_id string, t long, v double").repartition(3)
    for size in (10, 1024):
        found = blocks.wavelet_levels(rows, wavelet, size)
        got = {(r.series_id, r.j): (r.c, r.v) for r in found.collect()}
        want = {}
        for k, x in series.items():
            d = details((x - x.mean())[None, :], wavelet)[::-1] if len(x) >= 128 else []
            want |= {(k, j): (c.shape[1], c.var(ddof=1)) for j, c in enumerate(d, 1) if c.shape[1] >= 2}
        assert set(got) == set(want)
        for k, (c, v) in want.items():
            assert got[k][0] == c and got[k][1] == pytest.approx(v, rel=1e-9)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 2


def test_table_function_takes_series_by_batches(spark):
    from pyspark.util import PythonEvalType

    from perdura.functions import sql
    from perdura.kernels.estimators import KERNELS

    assert sql.table_function(KERNELS).evalType == PythonEvalType.SQL_ARROW_UDTF
    series = {k: np.random.default_rng(i).standard_normal(n) for i, (k, n) in enumerate({"a": 25_000, "b": 300, "c": 11_000}.items())}
    spark.udtf.register("two_estimates", sql.table_function({k: KERNELS[k] for k in ("RS", "GPH")}))
    rows = spark.createDataFrame([(k, t, float(v)) for k, x in series.items() for t, v in enumerate(x)][::-1], "series_id string, t long, v double")
    got = {(r.series_id, r.estimator_name): (r.n, r.point) for r in spark.sql("SELECT * FROM two_estimates(TABLE({df}) PARTITION BY series_id ORDER BY t)", df=rows.repartition(1)).collect()}
    want = {(k, e): (len(x), pytest.approx(float(KERNELS[e](x[None, :], {})[0]))) for k, x in series.items() for e in ("RS", "GPH")}
    assert got == want


@pytest.mark.parametrize("size", [2500, 1 << 16])
def test_lags_take_chunks_of_places_and_few_passes(spark, monkeypatch, size):
    from perdura.kernels.estimators import KERNELS
    from perdura.operators import blocks

    rng = np.random.default_rng(21)
    series = {f"s{n}": 1e4 + rng.standard_normal(n).cumsum() * 0.2 + rng.standard_normal(n) for n in (1024, 1025, 7501, 12_289)}
    rows = spark.createDataFrame([(k, t, float(v)) for k, x in series.items() for t, v in enumerate(x)][::-1], "series_id string, t long, v double").repartition(3)
    given, with_halo = [], blocks.with_halo
    monkeypatch.setattr(blocks, "with_halo", lambda rows, *rest: given.append(rows) or with_halo(rows, *rest))
    for name, f in (("DMA", blocks.dma), ("GHE", blocks.ghe), ("Higuchi", blocks.higuchi)):
        found = f(rows, size)
        assert {r.series_id: r.point for r in found.collect()} == {k: pytest.approx(float(KERNELS[name](x[None, :], {})[0]), abs=1e-9) for k, x in series.items()}
        assert given.pop().count() <= 4 * 4 + sum(map(len, series.values())) // 1000
        assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 3


def test_block_bootstrap_takes_every_estimator(spark):
    from perdura.kernels.estimators import KERNELS
    from perdura.operators.estimate import fit_one
    from perdura.sources.series import VIEWS, pack

    series = {r.series_id: np.array(r["values"]) for r in pack(VIEWS["E5"](spark, SF)).collect()}
    found = QUERIES["block_bootstrap"](spark, SF).collect()
    assert len(found) == len(series) * len(KERNELS)
    got = {(r.record_id, r.estimator_name): r for r in found}
    assert set(got) == {(i, name) for i in series for name in KERNELS}
    for (i, name), r in got.items():
        want = fit_one(KERNELS[name], {"n_bootstrap": 200}, series[i], 7, None)
        assert (r.valid, r.bootstrap_used) == (want["valid"], want["bootstrap_used"])
        for c in ("point", "ci_low", "ci_high"):
            assert r[c] == (None if want[c] is None else pytest.approx(want[c], abs=1e-6)), (i, name, c)
    assert {r.valid for r in found} == {True, False}


def test_jobs_of_a_record_are_dealt_to_few_rows(spark):
    from perdura.kernels.estimators import KERNELS
    from perdura.operators import estimate
    from perdura.plans.registry import EstimatorSpec

    rng = np.random.default_rng(17)
    series = {"long": rng.standard_normal(25_000), "short": rng.standard_normal(300), "flat": np.ones(300), "empty": np.empty(0), "none": None}
    rows = spark.createDataFrame([(k, i, None if x is None else x.tolist()) for i, (k, x) in enumerate(series.items())], "record_id string, seed long, values array<double>")
    specs = [EstimatorSpec(n, params={"n_bootstrap": b}) for n, b in (("RS", 120), ("GPH", 8), ("WaveletOLS", 61))]
    for workers in (1, 3, 50):
        found = estimate.estimate(rows, specs, max_workers=workers)
        got = {(r.record_id, r.estimator_name): r for r in found.collect()}
        assert len(got) == len(series) * len(specs)
        for i, (k, x) in enumerate(series.items()):
            for s in specs:
                want, r = estimate.fit_one(KERNELS[s.name], s.params, np.empty(0) if x is None else x, i, None), got[k, s.name]
                assert (r.valid, r.failure_reason, r.bootstrap_used) == (want["valid"], want["failure_reason"], want["bootstrap_used"])
                assert (r.point, r.ci_low, r.bootstrap_std) == tuple(None if want[c] is None else pytest.approx(want[c], abs=1e-12) for c in ("point", "ci_low", "bootstrap_std"))
        # A series is copied once, for the rows of its jobs, and not by estimator before.
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
