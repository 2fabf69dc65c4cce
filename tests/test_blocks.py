"""Estimators on series in blocks against the kernels on whole series, for several block sizes."""

import numpy as np
import pytest

from perdura.kernels.numeric import zoomed_dft
from perdura.operators import blocks, native
from perdura.operators.estimate import kernel_points
from perdura.sources.series import pack


@pytest.fixture(scope="module")
def series(spark):
    """Lengths around the limits of the estimators, a constant series, a long one; rows in no order."""
    rng = np.random.default_rng(12)
    made = {f"s{n}": rng.standard_normal(n).cumsum() * 0.3 + rng.standard_normal(n) for n in (1, 2, 15, 31, 32, 63, 64, 127, 128, 300, 1500)}
    made["flat"] = np.full(400, 3.0)
    rows = [(k, t, float(v)) for k, x in made.items() for t, v in enumerate(x)]
    rng.shuffle(rows)
    return spark.createDataFrame([(k, int(t), float(v)) for k, t, v in rows], "series_id string, t long, v double").repartition(3).cache()


def points(df):
    return {r.series_id: (r.n, r.point, r.valid, r.failure_reason) for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for k, (n, point, *rest) in want.items():
        assert got[k][0] == n and list(got[k][2:]) == rest
        assert point is None and got[k][1] is None or got[k][1] == pytest.approx(point, abs=1e-9), (k, got[k], point)


@pytest.mark.parametrize("size", [7, 1000])
@pytest.mark.parametrize(("name", "f"), [("GHE", blocks.ghe), ("Higuchi", blocks.higuchi), ("DMA", blocks.dma), ("GPH", blocks.gph), ("Periodogram", blocks.log_periodogram)])
def test_blocks_of_any_size_give_the_kernels_points(series, name, f, size):
    usable = series.filter("series_id <> 'flat'")
    same(points(f(usable, size)), points(kernel_points(pack(usable), name)))


def test_blocks_of_a_constant_series(series):
    flat = series.filter("series_id = 'flat'")
    for name, f in (("DMA", blocks.dma), ("GHE", blocks.ghe), ("Higuchi", blocks.higuchi)):
        same(points(f(flat, 64)), points(kernel_points(pack(flat), name)))
    assert points(blocks.variance_ratio(flat, 64))["flat"][1] is None


@pytest.mark.parametrize("size", [7, 1000])
def test_native_twins(series, size):
    same(points(blocks.variance_ratio(series, size)), points(native.variance_ratio(series)))
    got = {(r.series_id, r.t): r.v for r in blocks.polynomial_trend(series, 2, 0.7, size).collect()}
    for r in native.polynomial_trend(series, 2, 0.7).collect():
        assert got[r.series_id, r.t] == pytest.approx(r.v, abs=1e-7)


def test_rows_copied_for_lags_do_not_grow_with_the_lag(series):
    """A row goes to its own block and to one more for each lag at most, however many blocks lie between."""
    from pyspark.sql import functions as F

    rows = blocks.even_blocks(series, 16)
    lags = [1, 2, 3, 40, 700]
    copied = blocks.with_halo(rows, F.array(*[F.lit(h).cast("long") for h in lags]), 16)
    most = copied.groupBy("series_id", "t").count().agg(F.max("count")).first()[0]
    assert most <= 1 + len(lags)
    per_block = copied.groupBy("series_id", "block").count().agg(F.max("count")).first()[0]
    assert per_block <= 16 * (1 + len(lags))
    assert copied.filter("own").count() == rows.count()


def test_boxes_of_all_scales_from_cumulated_sums(series):
    """Every box sum against a plain one, also where boxes span chunks."""
    from pyspark.sql import functions as F

    rows = native.profile(series.filter("series_id in ('s1500', 's300')"))
    y = {}
    for r in rows.collect():
        y.setdefault(r.series_id, {})[r.t] = r.y
    got = native.box_sums(rows, F.array(*[F.lit(s).cast("long") for s in (3, 16, 149, 700, 1100)])).collect()
    assert {(r.series_id, r.s): 0 for r in got}.keys() == {(k, s) for k in y for s in (3, 16, 149, 700, 1100) if len(y[k]) >= s}
    for r in got:
        x = np.array([y[r.series_id][r.box * r.s + u] for u in range(r.s)])
        assert [r.sy, r.syy, r.suy] == pytest.approx([x.sum(), (x * x).sum(), (np.arange(r.s) * x).sum()], rel=1e-8, abs=1e-5)
    assert sum(r.series_id == "s1500" and r.s == 16 for r in got) == 1500 // 16


def test_zoomed_transform_equals_the_fft():
    rng = np.random.default_rng(3)
    for n, cuts, m in ((1000, [0, 1, 300, 1000], 31), (4097, [0, 4097], 2048), (50, [0, 7, 50], 24)):
        x = rng.standard_normal(n)
        parts = sum(zoomed_dft(x[a:b], a, n, m) for a, b in zip(cuts, cuts[1:], strict=False))
        assert np.abs(parts - np.fft.fft(x)[1 : m + 1]).max() < 1e-9
    far = zoomed_dft(np.array([1.0]), 10**12 + 7, 3 * 10**12 + 1, 5)  # the angle stays exact far out
    assert np.allclose(far, np.exp(-2j * np.pi * np.array([(j * (10**12 + 7)) % (3 * 10**12 + 1) / (3 * 10**12 + 1) for j in range(1, 6)])), atol=1e-9)
