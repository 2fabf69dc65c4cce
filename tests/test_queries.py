"""Every registered query with SQL against DuckDB, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from perdura.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()
#: Queries that stand for many alike, for a run of the tests in short time; TEST_ALL=1 runs all.
SOME = ["series_profile_l3", "packed_round_trip", "rs_hurst", "rs_validity", "rs_hurst_blocks", "dfa_order1", "dfa_order1_blocks", "dma_hurst", "dma_hurst_blocks", "gph_blocks", "higuchi_slope", "whittle_mle", "wavelet_db4_bardet", "wavelet_db4_whittle", "ghe", "ghe_native_lags", "gph", "whittle_grid", "local_whittle_grid", "wavelet_haar_bardet", "wavelet_haar_jensen", "variance_ratio_plugin", "sql_gph", "sql_estimates", "wavelet_db4_ols_blocks", "modified_local_whittle_blocks", "polynomial_trend", "outliers_fixed", "metric_coverage", "metric_family_level_disagreement", "metric_coverage_collapse", "metric_max_variant_drift", "aggregate_strata_and_global", "leaderboard_weighted_rank", "failures", "bench_uncertainty_paired", "generator_grid", "contamination_grid", "rolling_hurst"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(df):
    cells = lambda r: tuple("None" if pd.isna(v) else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r)
    return sorted(cells(r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL) if os.environ.get("TEST_ALL") else SOME)
def test_same_rows_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_estimators_in_sql_leave_out_nulls_and_keep_order(spark):
    import numpy as np

    from perdura.functions import sql
    from perdura.kernels.estimators import KERNELS

    assert "lrd_rs" in sql.register(spark)
    x = np.random.default_rng(1).standard_normal(200)
    rows = [("a", t, float(v)) for t, v in enumerate(x)] + [("a", 500, None), ("b", 0, 1.0), ("c", 0, None)]
    df = spark.createDataFrame(rows[::-1], "series_id string, t long, v double").repartition(4)
    got = {r[0]: r[1] for r in spark.sql("SELECT series_id, lrd_rs(t, v) FROM {df} GROUP BY series_id", df=df).collect()}
    assert got["a"] == pytest.approx(KERNELS["RS"](x[None, :], {})[0]) and got["b"] is None and got["c"] is None
    many = spark.sql("SELECT * FROM lrd_estimates(TABLE({df}) PARTITION BY series_id ORDER BY t)", df=df).collect()
    assert len(many) == 3 * len(KERNELS) and {r.n for r in many if r.series_id == "a"} == {200} and {r.n for r in many if r.series_id == "c"} == {0}
    assert next(r.point for r in many if r.series_id == "a" and r.estimator_name == "RS") == pytest.approx(got["a"])


def test_blocks_give_the_same_series(spark):
    from perdura.sources.series import VIEWS, events_in_blocks

    plain = {(r.series_id, r.t): r.v for r in VIEWS["E5"](spark, SF).collect()}
    cut = events_in_blocks(spark, SF, 7).collect()
    assert {(r.series_id, r.t): r.v for r in cut} == plain and len(cut) == len(plain) and len({r.block for r in cut}) == 7


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())


def test_scans_read_what_they_need(spark):
    plan = QUERIES["rs_hurst"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string,value:double>" in plan
    assert plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1


def test_summaries_of_runs_merge_to_that_of_the_whole():
    import numpy as np

    from perdura.streaming import rolling

    rng = np.random.default_rng(8)
    for n in (1, 2, 17, 5000):
        x = rng.standard_normal(n) + 3
        cuts = sorted({0, n, *rng.integers(0, n + 1, 6).tolist()})
        whole, parts = rolling.summarised(x), rolling.merged([rolling.summarised(x[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])
        assert parts[0] == n and parts[1:3] == pytest.approx(whole[1:3])
        y = np.cumsum(x - x.mean())
        want = np.log((y.max() - y.min()) / x.std()) / np.log(n) if n >= 16 else None
        assert rolling.range_point(whole) == (want if want is None else pytest.approx(want)) and rolling.range_point(parts) == (want if want is None else pytest.approx(want))
        assert len(whole[3]) + len(whole[5]) <= 12 * np.log2(n + 2)  # a few points, not the values
    assert rolling.range_point(rolling.summarised(np.full(50, 2.0))) is None


@pytest.mark.parametrize("slot", [None, "12 hours"])
def test_stream_closes_windows(spark, tmp_path, slot):
    from perdura.streaming import rolling

    src = tmp_path / "events"
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(str(src))
    q = rolling.start_stream(spark, str(src), "rolled" if slot is None else "rolled_slots", slot=slot)
    q.awaitTermination(120)
    rows = spark.sql("select * from " + ("rolled" if slot is None else "rolled_slots")).collect()
    assert rows
    batch = {(r.event_type, r.window_start): r.h for r in rolling.rescaled_range(rolling.windowed(spark.read.parquet(str(src)), "7 days")).collect()}
    assert all(batch[r.event_type, r.window_start] == pytest.approx(r.h) for r in rows if r.h is not None)
